"""Reports over a table that grows: partial counts of its parts, kept as a table.

A part is a partition of the validated table, a day for example. Its rows are validated and counted once: one row per (part, group,
verdict, test name) and one per (part, group, code of an error or a warning) are kept. Reports, breakdowns and rollups are added up from
those rows, whatever the size of the table, and equal those over all its rows. Parts are replaced as a whole, so a part that is
counted again after a failure or a correction counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tamis.operators.report import combine, success_rate, with_gate

TOTALS = ["total_records", "valid_records", "invalid_records", "warning_records", "validation_errors", "validation_warnings"]


def partials(validated: DataFrame, part: str, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The rows to keep: part, groups, kind ('test', 'errors' or 'warnings'), is_valid, name, n and the counts of ``report``. One pass and one
    shuffle of rows that were added up before it."""
    def entry(kind: str, name: Column, errors: Column, warnings: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.when(F.lit(kind == "test"), F.col("is_valid")).alias("is_valid"), name.alias("name"),
                        errors.cast("bigint").alias("n_errors"), warnings.cast("bigint").alias("n_warnings"))

    def coded(column: str) -> Column:
        return F.transform(column, lambda e: entry(column, e["code"], F.lit(0), F.lit(0)))

    test_entry = entry("test", F.col("test_name"), F.size("errors"), F.size("warnings"))
    entries = F.concat(F.array(test_entry), coded("errors"), coded("warnings"))
    rows = validated.select(F.col(part).alias("part"), *by, F.explode(entries).alias("e")).select("part", *by, "e.*")
    test, valid = F.col("kind") == "test", F.col("is_valid")
    return rows.groupBy("part", *by, "kind", "is_valid", "name").agg(
        F.count("*").alias("n"), F.count_if(test).alias("total_records"), F.count_if(test & valid).alias("valid_records"),
        F.count_if(test & ~valid).alias("invalid_records"), F.count_if(test & valid & (F.col("n_warnings") > 0)).alias("warning_records"),
        F.sum("n_errors").alias("validation_errors"), F.sum("n_warnings").alias("validation_warnings"))


def add(validated: DataFrame, folder: str, part: str, by: list[str] | tuple[str, ...] = ()) -> None:
    """Count the parts in ``validated`` and keep them in ``folder``, in place of what was kept of these parts."""
    rows = partials(validated, part, by)
    # an empty file, so that the kept columns are known where there is no row
    rows.limit(0).drop("part").write.mode("ignore").parquet(f"{folder}/part=__HIVE_DEFAULT_PARTITION__")
    # few rows per part: one file each
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)


def parts(spark: SparkSession, folder: str) -> list[str]:
    """The parts that are kept, as text; none before the first ``add``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return [r.part for r in read(spark, folder).select("part").distinct().collect()]  # a row per part


def add_missing(validated: DataFrame, folder: str, part: str, by: list[str] | tuple[str, ...] = ()) -> list[str]:
    """Count the parts of ``validated`` that are not kept yet; returns them. If the table is partitioned by ``part``, only their
    files are read. The list of parts is held by the driver."""
    spark = validated.sparkSession
    kept = set(parts(spark, folder))
    found = [r.part for r in validated.select(F.col(part).cast("string").alias("part")).distinct().collect()]
    new = sorted(p for p in found if p is not None and p not in kept)
    if new:
        add(validated.where(F.col(part).isin(new)), folder, part, by)
    return new


def read(spark: SparkSession, folder: str) -> DataFrame:
    """What is kept, with ``part`` as text."""
    kept = spark.read.parquet(folder).schema
    return spark.read.schema(StructType([StructField(f.name, StringType()) if f.name == "part" else f for f in kept])).parquet(folder)


def report_of(kept: DataFrame, threshold: float | str | Column | None = None, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The report of all parts of ``kept``; ``by`` may be any of the kept groups, and ``part``."""
    tests = kept.where("kind = 'test'").withColumnRenamed("name", "test_name")
    return with_gate(combine(tests, by), threshold)


def codes_of(kept: DataFrame, column: str = "errors", by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """How often each error or warning code occurs."""
    return kept.where(F.col("kind") == column).groupBy(*by, F.col("name").alias("code")).agg(F.sum("n").alias("n"))


def rollup_of(kept: DataFrame, *by: str, cube: bool = False) -> DataFrame:
    """Counts and success rate per group, subtotal and grand total."""
    base = kept.where("kind = 'test'").groupBy(*by).agg(*[F.sum(c).alias(c) for c in TOTALS])
    out = (base.cube(*by) if cube else base.rollup(*by)).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in TOTALS], F.grouping_id().cast("bigint").alias("grouping_level"))
    return out.withColumn("success_rate", success_rate())
