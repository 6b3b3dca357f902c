"""Row validation: a table in, the same rows with verdict, errors, warnings and test name out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import ident, quote
from tamis.plans.compiler import NO_ERRORS, NO_WARNINGS, Compiler, error_struct
from tamis.plans.messages import JSON_UNMARSHAL_ERROR
from tamis.plans.ruleset import Check, RuleSet

RESULT_COLUMNS = ("errors", "is_valid", "warnings", "test_name")


def test_name_sql(title: str) -> str:
    """Test name: the title, then the first error code of a bad row or the first warning code."""
    return (
        f"CASE WHEN NOT is_valid AND size(errors) > 0 THEN concat({quote(title + ':')}, get(errors, 0).code)"
        f" WHEN size(warnings) > 0 THEN concat({quote(title + ':')}, get(warnings, 0).code)"
        f" ELSE {quote(title)} END"
    )


def validate(
    df: DataFrame,
    rules: RuleSet,
    *,
    as_of: dt.datetime | str | None = None,
    root: str | None = None,
    checks: tuple[Check, ...] | list[Check] = (),
    undecodable: str | None = None,
    labels: bool = False,
    field_count: bool = False,
) -> DataFrame:
    """Validate every row of ``df``.

    The record is read from the top-level columns, or from the struct column ``root``. ``checks`` adds
    business checks to those of the rule set. ``undecodable`` names a boolean column that marks rows whose
    record could not be decoded (see ``tamis.sources.decode``). Everything is one chain of projections:
    no shuffle, usable on batch tables and on streams alike.
    """
    taken = [c for c in RESULT_COLUMNS if c in df.columns]
    if taken:
        raise ValueError(f"columns {taken} are result names; pack the record into a struct and pass root=")
    c = Compiler(rules, ident(root) if root else "", as_of)
    helpers = c.helpers()
    out = df
    for stage in helpers:
        out = out.select("*", *[F.expr(sql).alias(name) for name, sql in stage])
    errors = c.errors()
    if undecodable:
        bad = ident(undecodable)
        errors = f"CASE WHEN {bad} THEN {decode_failure_sql()} ELSE {errors} END"
    out = out.select("*", F.expr(errors).alias("errors"))
    lets = c.lets()
    if lets:
        out = out.select("*", *[F.expr(sql).alias(name) for name, sql in lets])
    found, any_found = c.warnings(tuple(checks))
    gate = any_found if rules.checks_when_invalid else f"size(errors) = 0 AND {any_found}"
    if undecodable:
        gate = f"NOT {ident(undecodable)} AND {gate}"
    out = out.select(
        "*",
        F.expr("size(errors) = 0").alias("is_valid"),
        F.expr(f"CASE WHEN {gate} THEN {found} ELSE {NO_WARNINGS} END").alias("warnings"),
    )
    name = test_name_sql(rules.title or rules.name)
    if undecodable:
        name = f"CASE WHEN {ident(undecodable)} THEN {quote(rules.title or rules.name)} ELSE {name} END"
    extra = []
    if labels:
        extra += [F.lit(rules.model_type or rules.name).alias("model_type"), F.lit(rules.provider).alias("provider")]
    if field_count and rules.field_count:
        extra.append(F.expr(c.resolve(rules.field_count)).cast("bigint").alias("field_count"))
    out = out.select("*", F.expr(name).alias("test_name"), *extra)
    return out.drop(*[name for stage in [*helpers, lets] for name, _ in stage])


def decode_failure_sql(message: str = "Failed to unmarshal record") -> str:
    return f"array({error_struct(quote('record'), quote(message), quote(JSON_UNMARSHAL_ERROR))})"


def codes(column: str) -> F.Column:
    """The codes of an errors or warnings column, joined with ','."""
    return F.expr(f"array_join(transform({ident(column)}, x -> x.code), ',')")


__all__ = ["validate", "codes", "NO_ERRORS", "NO_WARNINGS", "RESULT_COLUMNS"]
