"""Counts, success rates, quality gates and breakdowns of a validated table.

All of them first reduce the rows to one partial count per (group, verdict, test name) with a plain hash
aggregate, on the map side as well, so a group that holds most of the table is no burden to any one task;
names are collected only from those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import ident

SLOW_MS = 100  # fixed value: a validation that takes longer is reported
MAX_PAYLOADS = 100  # fixed value: payloads one batch request may carry


def success_rate(valid: str | Column = "valid_records", total: str | Column = "total_records") -> Column:
    """Percentage of valid records, 0 for none. Division comes first, as the order decides the last bit."""
    v = F.col(valid) if isinstance(valid, str) else valid
    t = F.col(total) if isinstance(total, str) else total
    rate = F.try_divide(v.cast("double"), t.cast("double")) * F.lit(100.0)
    return F.coalesce(rate, F.lit(0.0))


def gate(threshold: float | str | Column | None = None) -> Column:
    """'success' or 'failed'.

    With a threshold: failed when the success rate is below it; equal passes. Without one: failed only when
    the input is a single invalid record. A threshold column may be null per row.
    """
    if isinstance(threshold, str):
        threshold = F.col(threshold)
    t = threshold if isinstance(threshold, Column) else F.lit(threshold).cast("double")
    lone = (F.col("total_records") == 1) & (F.col("invalid_records") > 0)
    failed = F.when(t.isNotNull(), F.col("success_rate") < t).otherwise(lone)
    return F.when(failed, "failed").otherwise("success")


def counts(validated: DataFrame, by: list[str | Column] | tuple = ()) -> DataFrame:
    """Total, valid, invalid and warning records; errors and warnings; per group if ``by`` is given."""
    return validated.groupBy(*by).agg(*counters())


def counters() -> list[Column]:
    valid = F.col("is_valid")
    return [
        F.count("*").alias("total_records"),
        F.count_if(valid).alias("valid_records"),
        F.count_if(~valid).alias("invalid_records"),
        F.count_if(valid & (F.size("warnings") > 0)).alias("warning_records"),
        F.coalesce(F.sum(F.size("errors").cast("bigint")), F.lit(0)).alias("validation_errors"),
        F.coalesce(F.sum(F.size("warnings").cast("bigint")), F.lit(0)).alias("validation_warnings"),
    ]


def summarize(validated: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The summary: counts, success rate and the distinct names of passing and failing tests."""
    return combine(partial_counts(validated, by), by)


def partial_counts(validated: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row of counts per (group, verdict, test name). Partial counts of parts of a table add up to those of the whole."""
    return validated.groupBy(*by, "is_valid", "test_name").agg(*counters())


def combine(partial: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The summary, made of rows of ``partial_counts`` of one or several parts."""
    names = {True: "successful_test_names", False: "failed_test_names"}
    totals = ["total_records", "valid_records", "invalid_records", "warning_records", "validation_errors",
              "validation_warnings"]
    out = partial.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in totals],
        *[F.array_sort(F.collect_set(F.when(F.col("is_valid") == ok, F.col("test_name")))).alias(n)
          for ok, n in names.items()],
    )
    return out.withColumn("total_records_processed", F.col("total_records")).withColumn(
        "success_rate", success_rate()).withColumn(
        "total_tests_ran", F.size(F.array_union(*names.values())).cast("bigint"))


def report(validated: DataFrame, threshold: float | str | Column | None = None,
           by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The full report: summary plus the gate's ``status``; one row, or one per group."""
    return with_gate(summarize(validated, by), threshold)


def with_gate(summary: DataFrame, threshold: float | str | Column | None) -> DataFrame:
    out = summary.withColumn("status", gate(threshold))
    shown = F.lit(threshold).cast("double") if not isinstance(threshold, (str, Column)) else (
        F.col(threshold) if isinstance(threshold, str) else threshold)
    return out.withColumn("threshold", shown)


def flatten_findings(validated: DataFrame, column: str, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per error or warning (``column``), with the columns to ``keep``."""
    return validated.filter(F.size(ident(column)) > 0).select(*keep, F.explode(ident(column)).alias("f")).select(
        *keep, "f.*")


def by_code(validated: DataFrame, column: str = "errors", by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """How often each error or warning code occurs."""
    found = validated.select(*by, F.explode(F.transform(F.col(ident(column)), lambda e: e["code"])).alias("code"))
    return found.groupBy(*by, "code").agg(F.count("*").alias("n"))


def by_code_map(validated: DataFrame, column: str = "errors") -> DataFrame:
    """The counts of ``by_code`` as one row with a map; the codes are few."""
    entries = F.array_sort(F.collect_list(F.struct("code", "n")))
    return by_code(validated, column).agg(F.map_from_entries(entries).alias(f"{column}_by_code"))


def common_errors(validated: DataFrame, n: int = 10, column: str = "errors") -> DataFrame:
    """The ``n`` most frequent codes; ties in code order."""
    return by_code(validated, column).orderBy(F.desc("n"), "code").limit(n)


def by_field(validated: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Errors per field and code. Positions in arrays are left out of the field name."""
    plain = F.regexp_replace("e.field", r"\[\d+\]", "")
    found = validated.select(*by, F.explode("errors").alias("e")).select(
        *by, plain.alias("field"), F.col("e.code").alias("code"))
    return found.groupBy(*by, "field", "code").agg(F.count("*").alias("n"))


def rollup(validated: DataFrame, *by: str, cube: bool = False) -> DataFrame:
    """Counts and success rate per group, subtotal and grand total."""
    # reduce to one row per full group first, then expand that small table into the grouping sets
    base = counts(validated, by)
    grouped = base.cube(*by) if cube else base.rollup(*by)
    totals = [c for c in base.columns if c not in by]
    out = grouped.agg(*[F.sum(c).cast("bigint").alias(c) for c in totals],
                      F.grouping_id().cast("bigint").alias("grouping_level"))
    return out.withColumn("success_rate", success_rate())


def first_failure(validated: DataFrame, *order: str) -> DataFrame:
    """The first invalid row in the given order (stop on first error); empty if all rows are valid."""
    return validated.filter(~F.col("is_valid")).orderBy(*order).limit(1)


def has_failure(validated: DataFrame) -> bool:
    """Fail fast: reads only until an invalid row is found."""
    return not validated.filter(~F.col("is_valid")).isEmpty()


def batch_response(validated: DataFrame, request: str) -> DataFrame:
    """Counts per request of a batch of payloads, and whether it exceeds the allowed number of payloads."""
    out = validated.groupBy(request).agg(
        F.count("*").alias("total_count"),
        F.count_if("is_valid").alias("valid_count"),
        F.count_if(~F.col("is_valid")).alias("invalid_count"),
    )
    return out.withColumn("oversized", F.col("total_count") > MAX_PAYLOADS)


def flag_slow(validated: DataFrame, duration_ms: str) -> DataFrame:
    """Append a warning to rows whose measured duration exceeds the slow threshold."""
    warning = F.expr(
        "array(named_struct('field', 'performance', 'message',"
        f" concat('Validation took ', cast({ident(duration_ms)} AS STRING), 'ms (longer than expected)'),"
        " 'code', 'VALIDATION_FAILED', 'value', cast(NULL AS STRING),"
        " 'suggestion', 'Consider optimizing validation logic or payload size', 'category', ''))")
    slow = F.coalesce(F.col(ident(duration_ms)) > SLOW_MS, F.lit(False))
    return validated.withColumn("is_slow", slow).withColumn(
        "warnings", F.when(slow, F.concat("warnings", warning)).otherwise(F.col("warnings")))
