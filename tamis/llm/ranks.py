"""Places of rows in an order, per group, where a group may hold most of the table.

The rows are dealt by ranges of (group, order), so that a large group spreads over many tasks; a task numbers its sorted
rows, and a table of one row per (range, group) tells how many rows of the group lie in the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.store import stored

#: Rows of a range, about.
RANGE_ROWS = 1 << 20


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with a number ``row`` that no two share and that later steps find unchanged; written once."""
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), name)


def placed(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` of ``numbered`` with ``place`` (from 0, in the order given, equal ones by ``row``) and ``n``, the size of
    the group. Rows with a null group are a group. Nothing is gathered: equal keys spread like all others."""
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS + 1)
    keys = [*(F.col(g).asc_nulls_first() for g in group), *order, F.col("row").asc()]
    dealt = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.withColumns({"__range": F.spark_partition_id(), "__nth": F.monotonically_increasing_id()}), name)
    runs = dealt.groupBy("__range", *group).agg(F.count(F.lit(1)).alias("__rows"), F.min("__nth").alias("__first"))
    of_group = Window.partitionBy(*group)
    before = of_group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(
        F.col("__range").alias("__r"), *(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)),
        (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__rows").over(of_group).alias("n"))
    same = F.col("__range") == F.col("__r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = dealt.join(shifts, same).withColumn("place", F.col("__nth") + F.col("__shift"))
    return out.select(*rows.columns, "place", "n")
