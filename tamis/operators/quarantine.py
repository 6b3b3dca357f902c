"""Splitting a validated table into good and bad rows, and writing both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.operators.report import report
from tamis.operators.validate import RESULT_COLUMNS


def good_rows(validated: DataFrame, with_warnings: bool = True) -> DataFrame:
    good = validated.filter("is_valid")
    return good if with_warnings else good.filter(F.size("warnings") == 0)


def bad_rows(validated: DataFrame, include_warnings: bool = False) -> DataFrame:
    """Invalid rows; with ``include_warnings`` also valid rows that carry warnings."""
    bad = ~F.col("is_valid")
    return validated.filter(bad | (F.size("warnings") > 0) if include_warnings else bad)


def write_split(validated: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> DataFrame:
    """Write the validated table once, partitioned by verdict, and return it as read back.

    The rules run once; good rows, quarantine and report are then cheap reads of the written table, and a lost
    executor costs a re-read, not a re-validation.
    """
    validated.write.mode(mode).partitionBy("is_valid").format(fmt).save(path)
    return validated.sparkSession.read.schema(validated.schema).format(fmt).load(path)


def write_report(validated: DataFrame, path: str, threshold: float | None = None, fmt: str = "json",
                 mode: str = "overwrite") -> None:
    report(validated, threshold).write.mode(mode).format(fmt).save(path)


def original_columns(validated: DataFrame) -> DataFrame:
    """The input columns without the results."""
    return validated.drop(*RESULT_COLUMNS)
