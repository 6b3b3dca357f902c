"""Keys of JSON objects in other case than their fields are declared in.

A key belongs to the field of its exact name, else to the one whose name differs in case only. Of several keys of one field
the last counts, in the order of their bytes, so the declared lower-case name before any other spelling. Only records with such
keys are rewritten, level by level along the declared structures; keys of free maps and values stay as they are, and so do those below the
unrolled levels of structures that nest in themselves, and keys written with escapes.
"""

from __future__ import annotations

from tamis.functions.text import quote
from tamis.plans.ruleset import Field, RuleSet

BEYOND = r"A-Zſ\x{212A}"


def _fold(key: str) -> str:
    # beyond A-Z two characters fold to ASCII letters: the Kelvin sign, which lower() knows, and the long s
    return f"translate(lower({key}), 'ſ', 's')"


def _names(rs: RuleSet, into: set[str]) -> set[str]:
    for f in rs.fields:
        into.add(f.name)
        if f.kind in ("record", "records"):
            _names(f.of, into)
    return into


def _array(words: list[str]) -> str:
    return f"array({', '.join(quote(w) for w in words)})"


def odd_sql(rules: RuleSet, text: str) -> str:
    """True when a key of the JSON ``text`` is, in other case, the name of a field."""
    names = sorted(_names(rules, set()))
    if not names:
        return "false"
    lower = all(n == n.lower() for n in names)
    folded = _array(sorted({n.lower() for n in names}))
    wrong = "" if lower else f"NOT array_contains({_array(names)}, k) AND "

    def found(key: str) -> str:
        keys = f"regexp_extract_all({text}, {quote(key)}, 1)"
        return f"coalesce(exists({keys}, k -> {wrong}array_contains({folded}, {_fold('k')})), false)"

    if not lower:
        return found(r'"([^"\\]*+)"[ \t\r\n]*+:')
    # if all names are lower case, the keys that are not; nothing is tried twice, however long the text. The two characters beyond A-Z make
    # the search some ten times slower, so only texts that hold them pay for it, and texts without capitals for none
    key = r'"([^"A-Z\\]*+[A-Z][^"\\]*+)"[ \t\r\n]*+:'
    beyond = " OR ".join(f"contains({text}, '{c}')" for c in "ſ\u212a")
    beyond = f"octet_length({text}) <> char_length({text}) AND ({beyond})"
    return (f"CASE WHEN {beyond} THEN {found(key.replace('A-Z', BEYOND))} WHEN {text} = lower({text}) THEN false"
            f" ELSE {found(key)} END")


def _value(f: Field, v: str, level: int) -> str:
    if f.kind == "record":
        return _object(f.of, v, level + 1)
    e = f"ke{level}"
    items = f"try_variant_get({v}, '$', 'array<variant>')"
    return f"coalesce(concat('[', array_join(transform({items}, {e} -> {_object(f.of, e, level + 1)}), ','), ']'), to_json({v}))"


def _object(rs: RuleSet, v: str, level: int, exact_only: bool = False) -> str:
    """SQL of the JSON text of VARIANT ``v`` with the declared keys of ``rs`` only; what is no object stays as it is."""
    m, k, n = f"km{level}", f"kk{level}", f"kn{level}"
    exact = {f.name: f.name for f in rs.fields}
    folded = {f.name.lower(): f.name for f in rs.fields} | {f.name: f.name for f in rs.fields if f.name == f.name.lower()}
    pairs = ", ".join(f"{quote(a)}, {quote(b)}" for a, b in folded.items())
    name = f"map({pairs})[{_fold(k)}]"
    if any(a != b for a, b in folded.items()):
        name = f"if(array_contains({_array(list(exact))}, {k}), {k}, {name})"
    if exact_only:
        name = f"if(array_contains({_array(list(exact))}, {k}), {k}, NULL)"
    nested = [f for f in rs.fields if f.kind in ("record", "records")]
    plain = f"coalesce(to_json({m}[{k}]), 'null')"
    value = plain
    if nested:
        whens = " ".join(f"WHEN {quote(f.name)} THEN {_value(f, f'{m}[{k}]', level)}" for f in nested)
        value = f"CASE {n} {whens} ELSE {plain} END"
    item = f"transform(array({name}), {n} -> concat('\"', {n}, '\":', {value}))[0]"
    items = f"filter(transform(array_sort(map_keys({m})), {k} -> {item}), {k} -> {k} IS NOT NULL)"
    whole = f"concat('{{', array_join({items}, ','), '}}')"
    as_map = f"try_variant_get({v}, '$', 'map<string, variant>')"
    return f"coalesce(get(transform(filter(array({as_map}), {m} -> {m} IS NOT NULL), {m} -> {whole}), 0), to_json({v}))"


def folded_sql(rules: RuleSet, text: str, top: bool = True) -> str:
    """SQL of the record's JSON ``text`` with the keys as declared. Without ``top`` the record's own keys must be exact, and those of
    the structures in it need not."""
    return f"CASE WHEN {odd_sql(rules, text)} THEN {_object(rules, f'try_parse_json({text})', 0, not top)} ELSE {text} END"


__all__ = ["folded_sql", "odd_sql"]
