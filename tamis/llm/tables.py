"""Reading the given tables, and the shape in which this subpackage registers its queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, parts: int) -> Column:
    """The part, from 0, that a document falls into by the checksum of its id; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def sampled(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of a ``doc_id`` table, those of the smallest hashes: a bounded sample that reruns repeat."""
    return ids.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(most)
