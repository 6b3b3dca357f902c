"""Structures that nest in themselves to any depth: their steps as one flat array.

The unrolled levels of such a structure are ordinary nested structs. What lies below them is kept as JSON text and
flattened here, inside the row: a frontier of steps is replaced by their children, level by level, so the expression does not
grow with the depth and only records that are nested that deeply pay for it. The texts are decoded ``UNROLLED`` levels at once, all
siblings together, and what lies below these stays text for the next round.
"""

from __future__ import annotations

from collections.abc import Callable

from tamis.functions.text import ident, quote
from tamis.plans.ruleset import Field, RuleSet

LAST = 2147483647  # sorts behind all children
FEW = 64
# levels that are decoded at once, of steps with one step below them and of steps with many, where a level takes more code
UNROLLED = {False: 8, True: 3}
CORRUPT = "__corrupt"


def depth_sql(text: str, opened: str = "") -> str:
    """SQL of how many objects of the JSON ``text`` lie in one another, at most.

    Where little opens, by default brackets, that is their number; strings and siblings are told apart from depth only where much does."""
    # without strings, then without the innermost objects, which leaves few brackets of a wide record
    plain = f"regexp_replace(replace(replace({text}, '\\\\\\\\', ''), '\\\\\"', ''), '\"[^\"]*\"', '')"
    brackets = f"regexp_extract_all(regexp_replace({plain}, '[{{][^{{}}]*[}}]', ''), '[{{}}]', 0)"
    now = "b.d + if(c = '{', 1, -1)"
    step = f"named_struct('d', {now}, 'm', greatest(b.m, {now}))"
    exact = f"aggregate({brackets}, named_struct('d', 0, 'm', 0), (b, c) -> {step}, b -> b.m + 1)"
    opened = opened or f"regexp_count({text}, '[{{]')"
    return f"CASE WHEN {opened} <= {FEW} THEN {opened} + 1 ELSE {exact} END"


def levels_sql(start: str, below: Callable[[str], str], element: str, rounds: str, level: int) -> str:
    """SQL of all elements that are reached from the array ``start``; ``below`` gives SQL of the array under one of them.

    A level costs the elements on it and what lies below them; the levels are collected as they are and put together at the end."""
    acc, n = f"acc{level}", f"n{level}"
    zero = f"named_struct('f', {start}, 'a', cast(array() AS ARRAY<ARRAY<{element}>>))"
    merge = f"named_struct('f', flatten(transform({acc}.f, {n} -> {below(n)})), 'a', concat({acc}.a, array({acc}.f)))"
    merge = f"if(size({acc}.f) = 0, {acc}, {merge})"
    return (f"aggregate(sequence(1, {rounds}), {zero}, ({acc}, r{level}) -> {merge},"
            f" {acc} -> flatten(concat({acc}.a, array({acc}.f))))")


def judged_fields(rs: RuleSet) -> tuple[Field, ...]:
    """The fields that rules look at; the others need not be decoded once the record's kinds are known to be right."""
    others = {r.param[0] if r.name == "required_if" else r.param for f in rs.fields for r in f.rules if r.name in ("required_if", "gtefield")}
    return tuple(f for f in rs.fields if f.rules or f.each or f.of or f.name in others)


def _unrolled_type(f: Field, own: str, levels: int) -> str:
    """Type of ``levels`` of steps in one another, of the struct type ``own``; what nests in the last stays text."""
    if not levels:
        return "STRING"
    step = f"{own[:-1]}, {ident(f.name)}: {_unrolled_type(f, own, levels - 1)}>"
    return f"ARRAY<{step}>" if f.many else step


def _map(options: dict[str, str]) -> str:
    return f"map({', '.join(quote(v) for item in options.items() for v in item)})"


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body``, in which ``name`` is ``value``; unlike ``transform``, ``aggregate`` copies neither."""
    return f"aggregate(cast(array() AS ARRAY<INT>), {value}, ({name}, {name}_) -> {name}, {name} -> {body})"


def steps_sql(f: Field, text: str, prefix: str, level: int, options: dict[str, str]) -> str:
    """SQL of all steps below: path prefix ``p``, sort key ``k`` and ``x``, a struct of the fields that rules look at. ``text`` is SQL of
    the field's JSON text, ``options`` are those of the decode.

    Each round decodes ``UNROLLED`` levels at once, so that a text is read again once per so many levels. Where a value does not fit
    its type, which voids what lies in the same decode, every step is decoded by itself."""
    own = RuleSet(f.of.name, judged_fields(f.of))
    x = own.struct_type
    step = f"STRUCT<p: STRING, k: ARRAY<INT>, x: {x}>"
    unrolled = UNROLLED[f.many]
    waiting = "STRUCT<p: STRING, k: ARRAY<INT>, t: STRING>"
    nest = ident(f.name)
    acc, w, d, m, c, i, e = (f"{v}{level}" for v in ("acc", "w", "d", "m", "c", "i", "e"))

    def kept(steps: str, texts: str) -> str:
        return f"named_struct('a', {steps}, 'f', filter({texts}, {c} -> {c}.t IS NOT NULL))"

    # several levels at once: the steps of a level as they were decoded, beside their places
    def steps(n: int) -> str:
        return f"x{level}_{n}"

    def places(n: int) -> str:
        return f"q{level}_{n}"

    def here(n: int, at: str) -> str:
        if not f.many:
            return f"'p', concat({w}.p, {quote((f.label + '.') * (n + 1))}), 'k', concat({w}.k, array({', '.join('0' * (n + 1))}))"
        return f"'p', get({places(n)}, {at}).p, 'k', get({places(n)}, {at}).k"

    def levels(n: int) -> str:
        if n == unrolled:
            fields = ", ".join(f"{quote(g.name)}, {c}.{ident(g.name)}" for g in own.fields)
            shed = [f"transform({steps(j)}, ({c}, {i}) -> named_struct({here(j, i)}, 'x', named_struct({fields})))" for j in range(n)]
            return kept(f"concat({', '.join(shed)})", f"transform({steps(n - 1)}, ({c}, {i}) -> named_struct({here(n - 1, i)}, 't', {c}.{nest}))")
        nested = f"{steps(n - 1)}.{nest}" if n else f"array({d}.c)"
        found = f"filter({nested}, {c} -> {c} IS NOT NULL)"
        if not f.many:
            return _let(steps(n), found, levels(n + 1))
        p, k = (f"get({places(n - 1)}, {i}).p", f"get({places(n - 1)}, {i}).k") if n else (f"{w}.p", f"{w}.k")
        place = f"named_struct('p', concat({p}, {quote(f.label + '[')}, cast({e}i AS STRING), '].'), 'k', concat({k}, array({e}i)))"
        each = f"transform(filter(array({c}), {e} -> {e} IS NOT NULL), {e} -> transform({e}, ({e}x, {e}i) -> {place}))"
        at = f"flatten(flatten(transform({nested}, ({c}, {i}) -> {each})))"
        return _let(steps(n), f"flatten({found})", _let(places(n), at, levels(n + 1)))

    items = _unrolled_type(f, x, unrolled)
    corrupt = {"columnNameOfCorruptRecord": CORRUPT}
    whole = f"from_json(concat('{{\"c\":', {w}.t, '}}'), {quote(f'c {items}, {CORRUPT} STRING')}, {_map(options | corrupt)})"

    decoded = _let(d, whole, f"CASE WHEN {d}.{CORRUPT} IS NULL THEN {levels(0)} END")
    first = f"array(named_struct('p', {prefix}, 'k', cast(array() AS ARRAY<INT>), 't', {text}))"
    zero = f"named_struct('a', cast(array() AS ARRAY<ARRAY<{step}>>), 'f', cast({first} AS ARRAY<{waiting}>))"
    # a null among the arrays makes the flat one null
    merged = _let(m, f"transform({acc}.f, {w} -> {decoded})",
                  f"named_struct('a', concat({acc}.a, {m}.a), 'f', coalesce(flatten({m}.f), cast(array() AS ARRAY<{waiting}>)))")
    # every round copies what is found, so there are no more than the field's keys call for; keys with escapes are not told apart
    named = f"regexp_count({text}, {quote(f'{chr(34)}{f.name}{chr(34)}')})"
    keys = f"if(contains({text}, {quote(chr(92))}), regexp_count({text}, '[{{]'), {named})"
    rounds = f"cast((({depth_sql(text, keys)}) + {unrolled - 1}) div {unrolled} AS INT)"
    found = f"aggregate(sequence(1, {rounds}), {zero}, ({acc}, r{level}) -> if(size({acc}.f) = 0, {acc}, {merged}), {acc} -> flatten({acc}.a))"
    singly = _steps_singly_sql(f, own, text, prefix, level, options)
    return f"CASE WHEN {text} IS NULL THEN cast(array() AS ARRAY<{step}>) ELSE coalesce({found}, {singly}) END"


def _steps_singly_sql(f: Field, own: RuleSet, text: str, prefix: str, level: int, options: dict[str, str]) -> str:
    """The same, where every step is decoded by itself and a level per round."""
    nest = ident(f.name)
    nested = "ARRAY<STRING>" if f.many else "STRING"
    element = f"STRUCT<p: STRING, k: ARRAY<INT>, x: {own.struct_type[:-1]}, {nest}: {nested}>>"
    none = f"cast(array() AS ARRAY<{element}>)"
    c, i = f"c{level}", f"ci{level}"
    decoded = f"from_json({c}, {quote(f'{own.ddl}, {nest} {nested}')}, {_map(options)})"

    def below(items: str, p: str, k: str) -> str:
        if f.many:
            place = f"concat({p}, {quote(f.label + '[')}, cast({i} AS STRING), '].')"
            return f"coalesce(transform({items}, ({c}, {i}) -> named_struct('p', {place}, 'k', concat({k}, array({i})), 'x', {decoded})), {none})"
        step = f"named_struct('p', concat({p}, {quote(f.label + '.')}), 'k', concat({k}, array(0)), 'x', {decoded})"
        return f"transform(filter(array({items}), {c} -> {c} IS NOT NULL), {c} -> {step})"

    first = f"from_json({text}, 'array<string>')" if f.many else text
    start = below(first, prefix, "cast(array() AS ARRAY<INT>)")
    found = levels_sql(start, lambda n: below(f"{n}.x.{nest}", n + ".p", n + ".k"), element, depth_sql(text), level)
    fields = ", ".join(f"{quote(g.name)}, {c}.x.{ident(g.name)}" for g in own.fields)
    return f"transform({found}, {c} -> named_struct('p', {c}.p, 'k', {c}.k, 'x', named_struct({fields})))"
