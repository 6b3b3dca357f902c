"""JSON kinds of leaves, judged by the record's text.

To look at a leaf's kind costs a search in the record's VARIANT, and below the unrolled levels a step is built anew for each. Most records
are right, which one search of the text shows: a quoted name before a colon is a key wherever it stands, so it is enough that every
key with the name of a field is followed by a value of that field's kind. A name that is used elsewhere too, or a list longer than
``LISTED``, merely leaves the question open. The text must be free of escapes in keys, as ``plain_sql`` gives it.
"""

from __future__ import annotations

from tamis.functions.text import any_of, quote
from tamis.plans.ruleset import Field, RuleSet

_SPACE = r"[ \t\r\n]*+"
_END = r"[ \t\r\n,}\]]"
_STRING = r'"[^"\\]*+"'
LISTED = 16
_ITEM = f"(?:{_STRING}|null){_SPACE}"
_STRINGS = rf"\[{_SPACE}(?:\]|{_ITEM}(?:,{_SPACE}{_ITEM}){{0,{LISTED - 1}}}+\])"

# what follows the colon when a leaf's kind is right, and when all is right that a typed decode would refuse
_LEAF = {
    "text": '"|null', "time": '"|null', "real": '[^"]', "integer": f"-?[0-9]{{1,18}}{_END}|null", "duration": f"-?[0-9]{{1,18}}{_END}|null",
    "natural": f"[0-9]{{1,18}}{_END}|null", "texts": f"null|{_STRINGS}", "text_map": rf"null|\{{{_SPACE}\}}",
}
_TYPED = _LEAF | {
    "time": "null", "real": rf"-?[0-9]{{1,18}}(?:[.][0-9]{{1,18}})?{_END}|null", "flag": "true|false|null", "values": r"\[|null", "value_map": r"\{|null",
    "record": r"\{|null", "records": rf"\[{_SPACE}\]|null",
}


def plain_sql(text: str, variant: str) -> str:
    """SQL of the JSON ``text`` with its keys as they read; the same record as VARIANT writes those that hold escapes."""
    return f"if(contains({text}, {quote(chr(92))}), to_json({variant}), {text})"


def _one_of(names: set[str]) -> str:
    heads: dict[str, list[str]] = {}
    for n in sorted(names):
        heads.setdefault(n[:1], []).append(n[1:])
    return "(?:" + "|".join(f"{h}(?:{'|'.join(tails)})" for h, tails in heads.items()) + ")"


def _nest(f: Field) -> str:
    return rf"\[{_SPACE}(?:[{{\]]|null)|null" if f.many else r"\{|null"


def _expect(rs: RuleSet, kinds: dict[str, str], into: dict[str, set[str]]) -> None:
    """Names of fields by what may follow them."""
    for f in rs.fields:
        if f.kind in kinds:
            into.setdefault(kinds[f.kind], set()).add(f.name)
        if f.kind == "deep":
            into.setdefault(_nest(f), set()).add(f.name)
            _expect(f.of, _TYPED, into)
        elif f.kind in ("record", "records"):
            _expect(f.of, kinds, into)


def _broken(expected: dict[str, set[str]], text: str) -> str:
    cases = "|".join(f'{_one_of(names)}"{_SPACE}:{_SPACE}(?!{ok})' for ok, names in expected.items())
    return f"regexp_like({text}, {quote(f'{chr(34)}(?:{cases})')})"


def _odd_elements(text: str) -> str:
    """True unless objects and nulls are followed by objects, nulls and keys only, so that an array that begins with one holds no else."""
    after = rf",{_SPACE}(?![{{]|null|{_STRING}{_SPACE}:)"
    return any_of([f"regexp_like({text}, {quote(before + _SPACE + after)})" for before in ("[}]", "null")])


def deep_fields(rs: RuleSet) -> list[Field]:
    out = [f for f in rs.fields if f.kind == "deep"]
    for f in rs.fields:
        if f.kind in ("record", "records"):
            out += deep_fields(f.of)
    return out


def suspect_sql(rules: RuleSet, text: str) -> str:
    """True unless the ``text`` shows that all leaves of the record have the JSON kind of their field."""
    expected: dict[str, set[str]] = {}
    _expect(rules, _LEAF, expected)
    many = any(f.many for f in deep_fields(rules))
    return any_of([_broken(expected, text), *([_odd_elements(text)] if many else [])])


def suspect_below_sql(f: Field, text: str) -> str:
    """The same for what is nested under ``f``, given its ``text``."""
    expected: dict[str, set[str]] = {_nest(f): {f.name}}
    _expect(f.of, _TYPED, expected)
    # the text of an array has no key of its own
    first = [f"NOT regexp_like({text}, {quote(f'^(?:{_nest(f)})')})"]
    return any_of([*first, _broken(expected, text), *([_odd_elements(text)] if f.many else [])])


def wrong_below_sql(f: Field, text: str) -> str:
    """True when a leaf nested under ``f`` is surely of the wrong kind, given its ``text`` as written from a VARIANT.

    There the keys of steps are all that hold objects or arrays, but for lists of texts, so a field's name stands in a step."""
    known = _one_of({f.name, *(g.name for g in f.of.fields if g.kind == "texts")})
    texts = {g.name for g in f.of.fields if g.kind in ("text", "time")}
    numbers = {g.name for g in f.of.fields if g.kind in ("integer", "duration", "natural", "real")}
    cases = [f'{_one_of(names)}":{wrong}' for names, wrong in ((texts, '(?!"|null)'), (numbers, '"')) if names]
    if not cases:
        return "false"
    other = quote(rf'[{{,]"(?!{known}":)[^"]*+":[{{\[]')
    wrong = quote(f"[{{,]\"(?:{'|'.join(cases)})")
    return f"(NOT contains({text}, {quote(chr(92))}) AND NOT regexp_like({text}, {other}) AND regexp_like({text}, {wrong}))"


__all__ = ["deep_fields", "plain_sql", "suspect_below_sql", "suspect_sql", "wrong_below_sql"]
