"""Rows over all cores, however few splits a file has."""

from __future__ import annotations

from pyspark.sql import DataFrame

TASKS_PER_CORE = 3


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least three tasks per core.

    Wide records cost milliseconds each while their source rows take a few bytes, so that a file too small to be split by size is
    hours of work. Only such tables are dealt anew, as they are read; what has splits enough stays where it is.
    """
    if df.isStreaming:
        return df
    tasks = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


__all__ = ["spread"]
