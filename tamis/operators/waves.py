"""Stop on the first errors: a table is validated in growing waves of its files, until an error budget is spent.

The files are taken in the order given, one at first, then twice as many each time, so n files take at most log2(n) + 1 jobs, and a bad
file at the beginning costs no more than itself. Within a wave Spark runs as usual. The answer depends on the order of the files and on
``order`` only, never on which task ends first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FailFast:
    """``failures``: the first invalid rows, at most as many as the budget; ``files``: how many files were looked at; ``spent``: whether
    the budget was spent."""

    failures: DataFrame
    files: int
    spent: bool


def fail_fast(spark: SparkSession, files: list[str], checked: Callable[[DataFrame], DataFrame], *order: str | Column, budget: int = 1) -> FailFast:
    """Validate Parquet ``files``, named as ``DataFrame.inputFiles`` names them, with ``checked`` (from rows to validated rows, further
    columns kept) until ``budget`` invalid rows are found. Rows count in the order of their files, within a file by ``order``. The rows that are
    found, ``budget`` at most, pass through the driver."""
    if not files or budget < 1:
        raise ValueError("there must be a file to look at and a budget to spend")
    found: list = []
    start, width = 0, 1
    while start < len(files) and len(found) < budget:
        wave = files[start:start + width]
        places = spark.createDataFrame(list(zip(wave, range(start, start + len(wave)), strict=True)), "__path string, __place int")
        rows = checked(spark.read.parquet(*wave).withColumn("__file", F.input_file_name()))
        bad = rows.where(~F.col("is_valid")).join(places, F.col("__file") == F.col("__path"))
        bad = bad.orderBy("__place", *order).drop("__file", "__path", "__place").limit(budget - len(found))
        found += bad.collect()
        schema = bad.schema
        start += len(wave)
        width *= 2
    return FailFast(spark.createDataFrame(found, schema), start, len(found) >= budget)
