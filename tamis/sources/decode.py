"""Typed decoding of JSON records.

Strict decoding rejects a record as a whole when any value has the wrong JSON type. ``from_json`` alone is
more forgiving (a number becomes a text, a bare date a time), so a second look at the record as VARIANT
checks the JSON type of text, time, number and map leaves.

Of keys that occur twice the last counts, and keys may differ in case from the fields' names (see ``keys``). Integers may be written as ``3.0`` or ``1e1``: only records that fail as they are get
a second decode with decimal leaves.

Lenient decoding converts top-level scalars and collections where that is possible.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.scalars import json_text_sql
from tamis.functions.text import any_of, ident, quote
from tamis.plans import nesting
from tamis.plans.compiler import TIME_FORMAT
from tamis.plans.ruleset import Field, RuleSet, type_of
from tamis.sources import keys, kinds

CORRUPT = nesting.CORRUPT
_OPTIONS = f"map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '{CORRUPT}', 'timestampFormat', {quote(TIME_FORMAT)})"

# kinds whose JSON value must be a string / must not be a string
_STRINGS = {"text", "time"}
_NUMBERS = {"integer", "duration", "natural"}


@contextmanager
def last_key_wins(spark: SparkSession) -> Iterator[None]:
    """Expressions made inside accept repeated keys in JSON objects, of which the last counts."""
    setting = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _json_kind(v: str) -> str:
    return f"schema_of_variant({v})"


def _at(v: str, path: str) -> str:
    return f"try_variant_get({v}, {quote(path)}, 'variant')"


def _step(path: str, name: str) -> str:
    return f"{path}.{name}"


def _wrong_leaf(f: Field, v: str, path: str, level: int) -> list[str]:
    at = _at(v, _step(path, f.name))
    if f.kind in _STRINGS:
        return [f"coalesce({_json_kind(at)} NOT IN ('STRING', 'VOID'), false)"]
    if f.kind == "real":
        return [f"coalesce({_json_kind(at)} = 'STRING', false)"]
    if f.kind in _NUMBERS:
        # written with a point or an exponent: whole, and within 64 bits
        number = f"try_variant_get({at}, '$', 'double')"
        odd = f"({_json_kind(at)} NOT IN ('BIGINT', 'VOID') AND ({number} % 1 != 0 OR abs({number}) >= 9.223372036854775807E18D))"
        negative = f" OR {number} < 0" if f.kind == "natural" else ""
        return [f"coalesce({_json_kind(at)} = 'STRING' OR {odd}{negative}, false)"]
    if f.kind in ("texts", "text_map"):
        to = "array<variant>" if f.kind == "texts" else "map<string, variant>"
        items = f"try_variant_get({v}, {quote(_step(path, f.name))}, '{to}')"
        items = items if f.kind == "texts" else f"map_values({items})"
        e = f"w{level}"
        return [f"coalesce(exists({items}, {e} -> {_json_kind(e)} NOT IN ('STRING', 'VOID')), false)"]
    return []


def _wrong(rs: RuleSet, v: str, path: str, level: int, places: dict | None) -> list[str]:
    """SQL conditions, one per leaf, that are true for a value of the wrong JSON type."""
    out: list[str] = []
    for f in rs.fields:
        if f.kind == "record":
            if places is not None and f.of.name in places:
                places[f.of.name][1].append((v, _step(path, f.name)))
            else:
                out += _wrong(f.of, v, _step(path, f.name), level, places)
        elif f.kind == "records":
            e = f"w{level}"
            inner = any_of(_wrong(f.of, e, "$", level + 1, None))
            if inner != "false":
                items = f"try_variant_get({v}, {quote(_step(path, f.name))}, 'array<variant>')"
                out.append(f"coalesce(exists({items}, {e} -> {inner}), false)")
        elif f.kind == "deep":
            out.append(_wrong_below(f, v, _step(path, f.name), level))
        else:
            out += _wrong_leaf(f, v, path, level)
    return out


def _wrong_below(f: Field, v: str, path: str, level: int) -> str:
    """True when what is nested below ``path`` holds, at any depth, a value of the wrong JSON type.

    To take a part out of a VARIANT builds it anew with all that lies in it, so a step is taken out once, for the next level; its kind
    is looked at in place."""
    s = f"ws{level}"
    own = ", ".join(f"{quote(g.name)}, {_at(s, _step('$', g.name))}" for g in f.of.fields)
    # the step without what nests in it
    typed = f"from_json(to_json(named_struct({own})), {quote(f'{f.of.ddl}, `{CORRUPT}` STRING')}, {_OPTIONS})"
    leaf = any_of(_wrong(f.of, s, "$", level + 1, None))
    bad = (f"{_present(s)} AND (NOT {_holds(s, '$', many=False)} OR {leaf} OR {_misplaced(f, s, _step('$', f.name))}"
           f" OR {typed}.`{CORRUPT}` IS NOT NULL)")
    none = "cast(array() AS ARRAY<VARIANT>)"

    def below(v: str, path: str) -> str:
        if f.many:
            return f"coalesce(try_variant_get({v}, {quote(path)}, 'array<variant>'), {none})"
        return f"filter(array({_at(v, path)}), x -> {_present('x')})"

    t = f"wt{level}"
    steps = nesting.levels_sql(below(v, path), lambda n: below(n, _step("$", f.name)), "VARIANT", nesting.depth_sql(t), level + 30)
    looked = f"coalesce(exists({steps}, {s} -> {bad}), false)"
    # the text is judged first, as most of what is nested is right, and what is wrong is mostly so for all to see
    judged = f"CASE WHEN NOT {kinds.suspect_below_sql(f, t)} THEN false WHEN {kinds.wrong_below_sql(f, t)} THEN true ELSE {looked} END"
    at = _at(v, path)
    once = f"get(transform(array(to_json({at})), {t} -> {judged}), 0)"
    return f"CASE WHEN {_holds(v, path, f.many)} THEN {once} ELSE {_present(at)} END"


# the schema of a VARIANT is that of all it holds; these look at the value itself only
def _present(v: str) -> str:
    return f"({v} IS NOT NULL AND NOT is_variant_null({v}))"


def _holds(v: str, path: str, many: bool) -> str:
    """True for a JSON array at ``path``, or else for an object; a struct without fields takes nothing out."""
    return f"(try_variant_get({v}, {quote(path)}, '{'array<struct<>>' if many else 'struct<>'}') IS NOT NULL)"


def _misplaced(f: Field, v: str, path: str) -> str:
    return f"(NOT {_holds(v, path, f.many)} AND {_present(_at(v, path))})"


def _repeated(rs: RuleSet, counts: dict[str, list]) -> None:
    for f in rs.fields:
        if f.kind == "record":
            seen = counts.setdefault(f.of.name, [f.of, [], 0])
            seen[2] += 1
            if seen[2] == 1:
                _repeated(f.of, counts)


def type_clash_sql(rules: RuleSet, v: str) -> str:
    """True when a leaf of the VARIANT ``v`` has a JSON type its field does not accept."""
    counts: dict[str, list] = {}
    _repeated(rules, counts)
    places = {n: c for n, c in counts.items() if c[2] > 1}
    out = _wrong(rules, v, "$", 0, places)
    # structures found at several places are checked once, over an array of those places
    for rs, spots, _ in places.values():
        inner = any_of(_wrong(rs, "o", "$", 50, None))
        items = ", ".join(_at(v, path) for v, path in spots)
        out.append(f"coalesce(exists(array({items}), o -> {inner}), false)")
    return any_of(out)


def decode(df: DataFrame, rules: RuleSet, column: str = "value", *, mode: str = "strict",
           into: str = "record", failed: str = "undecodable") -> DataFrame:
    """Add the typed struct ``into`` and the boolean ``failed``, decoded from JSON text in ``column``."""
    if mode == "lenient":
        return _decode_lenient(df, rules, column, into, failed)
    if mode != "strict":
        raise ValueError(f"mode must be 'strict' or 'lenient', not {mode!r}")
    record, bad = strict_sql(rules, "`__text`", ident("__variant"), ident("__first"), ident("__decoded"))
    with last_key_wins(df.sparkSession):
        out = df.select("*", F.expr(keys.folded_sql(rules, ident(column))).alias("__text"))
        out = out.select("*", F.expr("try_parse_json(`__text`)").alias("__variant"), F.expr(record).alias("__first"))
        out = out.select("*", F.expr(second_look_sql(rules, "`__text`", ident("__first"))).alias("__decoded"))
        out = out.select("*", F.expr(bad).alias(failed))
    return _shape(out, rules, into, failed).drop("__first", "__text")


def _typed(rules: RuleSet) -> str:
    return ", ".join(filter(None, [rules.ddl, f"`{CORRUPT}` STRING"]))


def second_look_sql(rules: RuleSet, text: str, decoded: str) -> str:
    """SQL of the typed decode; a record that fails is decoded again with decimals in place of integers."""
    if "BIGINT" not in _typed(rules):
        return decoded
    again = f"from_json({text}, {quote(_typed(rules).replace('BIGINT', 'DECIMAL(38, 9)'))}, {_OPTIONS})"
    cast = f"try_cast({again} AS STRUCT<{_struct(rules)}>)"
    return f"CASE WHEN {decoded}.`{CORRUPT}` IS NOT NULL THEN {cast} ELSE {decoded} END"


def _struct(rules: RuleSet) -> str:
    return ", ".join([*(f"`{f.name}`: {type_of(f)}" for f in rules.fields), f"`{CORRUPT}`: STRING"])


def strict_sql(rules: RuleSet, text: str, variant: str, first: str, decoded: str) -> tuple[str, str]:
    """SQL of the first typed decode and of the failure flag, given the names of the helper columns: the record as VARIANT, its first
    decode and, by ``second_look_sql``, its last."""
    record = f"from_json({text}, {quote(_typed(rules))}, {_OPTIONS})"
    clash = type_clash_sql(rules, variant)
    if kinds.deep_fields(rules):
        clash = f"CASE WHEN {kinds.suspect_sql(rules, kinds.plain_sql(text, variant))} THEN {clash} ELSE false END"
    bad = (
        f"{first} IS NULL OR {decoded} IS NULL OR {decoded}.`{CORRUPT}` IS NOT NULL"
        f" OR ({variant} IS NOT NULL AND NOT startswith(ltrim(' \\\\t\\\\n\\\\r', {text}), '{{'))"
        f" OR {clash}"
    )
    return record, bad


def record_sql(rules: RuleSet, decoded: str, failed: str) -> str:
    """SQL that drops the helper field and nulls the record when decoding failed."""
    items = ", ".join(f"{quote(f.name)}, {decoded}.{ident(f.name)}" for f in rules.fields)
    return f"CASE WHEN NOT {failed} THEN named_struct({items}) END"


def _shape(out: DataFrame, rules: RuleSet, into: str, failed: str) -> DataFrame:
    record = F.expr(record_sql(rules, ident("__decoded"), ident(failed))).alias(into)
    return out.select("*", record).drop("__decoded", "__variant")


# -- lenient ---------------------------------------------------------------------------------------


def _as_text(v: str) -> str:
    # the lambda names the value once, which keeps the generated code small
    return f"transform(array({v}), t -> if(is_variant_null(t), '', {json_text_sql('t')}))[0]"


def _number_kind(v: str) -> str:
    return f"({_json_kind(v)} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({_json_kind(v)}, 'DECIMAL'))"


def is_strict(f: Field) -> bool:
    """Nullable fields, times and nested structures are decoded strictly in lenient mode too."""
    return f.nullable or f.kind in ("time", "record", "records")


def strict_part(rules: RuleSet) -> RuleSet:
    return RuleSet(rules.name, tuple(f for f in rules.fields if is_strict(f)))


def lenient_field(f: Field, v: str) -> tuple[str, str]:
    """SQL of the converted value of VARIANT ``v`` and of the condition under which conversion fails."""
    kind = _json_kind(v)
    present = f"({v} IS NOT NULL AND {kind} != 'VOID')"
    if f.kind == "text":
        return f"CASE WHEN {present} THEN {_as_text(v)} END", "false"
    if f.kind in ("integer", "duration"):
        # a number is cut to an integer, a text is read up to the first character that is no digit
        prefix = f"nullif(regexp_extract(try_variant_get({v}, '$', 'string'), '^[ \\\\t]*([+-]?[0-9]+)', 1), '')"
        value = (f"CASE WHEN {_number_kind(v)} THEN coalesce(try_variant_get({v}, '$', 'bigint'),"
                 f" try_cast(try_variant_get({v}, '$', 'double') AS BIGINT))"
                 f" WHEN {kind} = 'STRING' THEN try_cast({prefix} AS BIGINT) END")
        return value, f"{present} AND ({value}) IS NULL"
    if f.kind == "natural":
        number = f"try_variant_get({v}, '$', 'double')"
        value = f"CASE WHEN {_number_kind(v)} AND {number} >= 0 THEN try_cast({number} AS BIGINT) END"
        return value, f"{present} AND ({value}) IS NULL"
    if f.kind == "real":
        prefix = (f"nullif(regexp_extract(try_variant_get({v}, '$', 'string'),"
                  f" '^[ \\\\t]*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)', 1), '')")
        value = (f"CASE WHEN {_number_kind(v)} THEN try_variant_get({v}, '$', 'double')"
                 f" WHEN {kind} = 'STRING' THEN try_cast({prefix} AS DOUBLE) END")
        return value, f"{present} AND ({value}) IS NULL"
    if f.kind == "flag":
        return f"CASE WHEN {kind} = 'BOOLEAN' THEN variant_get({v}, '$', 'boolean') END", f"{present} AND {kind} != 'BOOLEAN'"
    if f.kind == "texts":
        items = f"try_variant_get({v}, '$', 'array<variant>')"
        return f"transform({items}, x -> {_as_text('x')})", f"{present} AND NOT startswith({kind}, 'ARRAY')"
    if f.kind == "values":
        items = f"try_variant_get({v}, '$', 'array<variant>')"
        return f"transform({items}, x -> to_json(x))", f"{present} AND NOT startswith({kind}, 'ARRAY')"
    if f.kind in ("text_map", "value_map"):
        items = f"try_variant_get({v}, '$', 'map<string, variant>')"
        text = _as_text("x") if f.kind == "text_map" else "to_json(x)"
        return f"transform_values({items}, (k, x) -> {text})", f"{present} AND NOT startswith({kind}, 'OBJECT')"
    return f"CASE WHEN {present} THEN try_variant_get({v}, '$', 'string') END", "false"  # any


def lenient_sql(rules: RuleSet, text: str, variant: str, decoded: str) -> tuple[str, str, str]:
    """SQL of the strict part's decode (a helper column), of the converted struct and of the failure flag."""
    part, strict_bad = strict_sql(strict_part(rules), text, variant, decoded, decoded)
    values, fails = [], []
    for f in rules.fields:
        if is_strict(f):
            values.append(f"{quote(f.name)}, {decoded}.{ident(f.name)}")
            continue
        value, bad = lenient_field(f, _at(variant, f"$.{f.name}"))
        values.append(f"{quote(f.name)}, cast({value} AS {type_of(f)})")
        if bad != "false":
            fails.append(bad)
    failed = f"{variant} IS NULL OR {strict_bad} OR {any_of(fails)}"
    return part, f"named_struct({', '.join(values)})", failed


def _decode_lenient(df: DataFrame, rules: RuleSet, column: str, into: str, failed: str) -> DataFrame:
    part, record, bad = lenient_sql(rules, "`__text`", "`__variant`", "`__part`")
    with last_key_wins(df.sparkSession):
        out = df.select("*", F.expr(keys.folded_sql(rules, ident(column), top=False)).alias("__text"))
        out = out.select("*", F.expr("try_parse_json(`__text`)").alias("__variant"), F.expr(part).alias("__part"))
        out = out.select("*", F.expr(bad).alias(failed))
    record = f"CASE WHEN NOT {ident(failed)} THEN {record} END"
    return out.select("*", F.expr(record).alias(into)).drop("__variant", "__part", "__text")
