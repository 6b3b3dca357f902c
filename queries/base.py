"""Shared pieces of the registered queries.

A seed is a list of (column, expression) pairs over one table. The expressions are plain SQL that Spark and
the checking database read alike, so both sides see the same input; the rules themselves are evaluated by the
library on one side and by separately written SQL on the other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tamis.sources.spread import spread

AS_OF = "2024-02-01T00:00:00Z"
AS_OF_SQL = "TIMESTAMP '2024-02-01 00:00:00'"


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seed(spark: SparkSession, sf: str, name: str, columns: dict[str, str], dealt: bool = True) -> DataFrame:
    """The columns over the table, whose rows are dealt to all cores if its file is too small to be split."""
    rows = table(spark, sf, name)
    return (spread(rows) if dealt else rows).selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])


def seed_sql(name: str, columns: dict[str, str]) -> str:
    items = ",\n  ".join(f'{e} AS "{c}"' for c, e in columns.items())
    return f"SELECT {items}\nFROM {name}"


def utc(expr: str) -> str:
    """Spark only: a time without zone, read as UTC whatever the session's zone is."""
    return f"from_utc_timestamp(cast({expr} AS TIMESTAMP), current_timezone())"


def joined(cases: list[tuple[str, str]]) -> str:
    """Checking SQL: the codes whose condition holds, joined with ','."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{code}' END" for c, code in cases) + ")"


def first(cases: list[tuple[str, str]]) -> str:
    """Checking SQL: the code of the first condition that holds, else NULL."""
    return "CASE " + " ".join(f"WHEN {c} THEN '{code}'" for c, code in cases) + " END"
