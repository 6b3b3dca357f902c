"""Validation of a table whose rows carry different record types."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import ident, quote
from tamis.operators.validate import decode_failure_sql, test_name_sql
from tamis.plans.compiler import NO_ERRORS, NO_WARNINGS, Compiler, error_struct
from tamis.plans.ruleset import RuleSet, title_case
from tamis.sources import keys
from tamis.sources.decode import last_key_wins, lenient_sql, record_sql, second_look_sql, strict_sql


UNKNOWN_MODEL_TYPE = "UNKNOWN_MODEL_TYPE"


def unknown_types(df: DataFrame, catalog: dict[str, RuleSet], type_column: str = "model_type") -> DataFrame:
    """Rows whose type has no rule set."""
    known = F.col(ident(type_column)).isin(*catalog)
    return df.filter(~F.coalesce(known, F.lit(False)))


def route(
    df: DataFrame,
    catalog: dict[str, RuleSet],
    *,
    type_column: str = "model_type",
    column: str = "value",
    lenient: str | None = None,
    as_of: dt.datetime | str | None = None,
) -> DataFrame:
    """Decode and validate raw JSON records of several types in one pass.

    Every type is a branch of a CASE inside the same chain of projections. The table is read once however many
    types there are, and nothing is shuffled. A row of unknown type is invalid with the one error ``UNKNOWN_MODEL_TYPE``, so
    as many rows come out as went in. ``lenient`` names a boolean column that selects lenient decoding per row.
    """
    with last_key_wins(df.sparkSession):
        return _route(df, catalog, type_column, column, lenient, as_of)


def _route(df: DataFrame, catalog: dict[str, RuleSet], type_column: str, column: str, lenient: str | None,
           as_of: dt.datetime | str | None) -> DataFrame:
    mt = ident(type_column)
    keep = df.columns

    def branches(parts: dict[str, str], otherwise: str) -> str:
        return f"CASE {' '.join(f'WHEN {mt} = {quote(t)} THEN {s}' for t, s in parts.items())} ELSE {otherwise} END"

    # 1 decode, 2 failure flag, 3 record, 4 errors, 5 verdict and warnings, 6 test name
    names = {t: f"__{i}" for i, t in enumerate(catalog)}
    soft = ident(lenient) if lenient else "false"
    folded = {t: keys.folded_sql(rs, ident(column)) for t, rs in catalog.items()}
    if lenient:
        folded = {t: f"CASE WHEN {soft} THEN {keys.folded_sql(rs, ident(column), top=False)} ELSE {folded[t]} END" for t, rs in catalog.items()}
    out = df.select("*", F.expr(branches(folded, ident(column))).alias("__text"))
    out = out.select("*", F.expr("try_parse_json(`__text`)").alias("__v"))
    text = "`__text`"
    decoded, second, failed, records = [], [], {}, []
    for t, rs in catalog.items():
        d = ident(names[t] + "d")
        first = ident(names[t] + "f")
        strict, bad = strict_sql(rs, text, "`__v`", first, d)
        decoded.append(F.expr(f"CASE WHEN {mt} = {quote(t)} AND NOT {soft} THEN {strict} END").alias(names[t] + "f"))
        second.append(F.expr(second_look_sql(rs, text, first)).alias(names[t] + "d"))
        record = record_sql(rs, d, "undecodable")
        if lenient:
            p = ident(names[t] + "p")
            part, value, soft_bad = lenient_sql(rs, text, "`__v`", p)
            decoded.append(F.expr(f"CASE WHEN {mt} = {quote(t)} AND {soft} THEN {part} END").alias(names[t] + "p"))
            bad = f"CASE WHEN {soft} THEN {soft_bad} ELSE {bad} END"
            record = f"CASE WHEN {soft} THEN if(undecodable, NULL, {value}) ELSE {record} END"
        failed[t] = bad
        records.append(F.expr(f"CASE WHEN {mt} = {quote(t)} THEN {record} END").alias(names[t]))
    out = out.select("*", *decoded)
    out = out.select("*", *second)
    out = out.select("*", F.expr(branches(failed, "false")).alias("undecodable"))
    out = out.select(*keep, "undecodable", *records)

    compiled = {t: Compiler(rs, ident(names[t]), as_of, tag=f"{i}_") for i, (t, rs) in enumerate(catalog.items())}
    stages: dict[int, list] = {}
    for t, c in compiled.items():
        for i, stage in enumerate(c.helpers()):
            stages.setdefault(i, []).extend(
                F.expr(f"CASE WHEN {mt} = {quote(t)} AND NOT undecodable THEN {sql} END").alias(name)
                for name, sql in stage)
    for i in sorted(stages):
        out = out.select("*", *stages[i])
    message = f"concat({quote("Model type '")}, coalesce({mt}, ''), {quote("' is not registered")})"
    unknown = f"array({error_struct(quote('model_type'), message, quote(UNKNOWN_MODEL_TYPE))})"
    errors = branches({t: c.errors() for t, c in compiled.items()}, unknown)
    out = out.select("*", F.expr(f"CASE WHEN undecodable THEN {decode_failure_sql()} ELSE {errors} END").alias("errors"))
    lets = [F.expr(f"CASE WHEN {mt} = {quote(t)} AND NOT undecodable THEN {sql} END").alias(name)
            for t, c in compiled.items() for name, sql in c.lets()]
    if lets:
        out = out.select("*", *lets)
    warnings = {}
    for t, c in compiled.items():
        found, any_found = c.warnings()
        rs = catalog[t]
        when = any_found if rs.checks_when_invalid else f"size(errors) = 0 AND {any_found}"
        warnings[t] = f"CASE WHEN {when} THEN {found} ELSE {NO_WARNINGS} END"
    out = out.select(
        "*",
        F.expr("size(errors) = 0").alias("is_valid"),
        F.expr(f"CASE WHEN undecodable THEN {NO_WARNINGS} ELSE {branches(warnings, NO_WARNINGS)} END").alias("warnings"),
    )
    titles = {t: title_case(t) + "Validator" for t in catalog}
    title = branches({t: quote(x) for t, x in titles.items()}, "''")
    named = branches({t: test_name_sql(x) for t, x in titles.items()}, "''")
    name = f"CASE WHEN undecodable THEN {title} ELSE {named} END"
    return out.select(*keep, "undecodable", "is_valid", "errors", "warnings", F.expr(name).alias("test_name"))
