"""Line dedup over levelled sorted runs of line hashes. DataFrame operations only.

A run is a table of (hash, n_docs, keeper), sorted by hash: for every line key of some batches, in how many of their
documents it occurs and the largest doc_id among those. Every batch of documents adds a run of its own to level 0; when a
level holds ``fanout`` runs they are merged into one run of the next level, so n batches leave at most
``fanout * log(n)`` runs and every row is rewritten once per level.

A new batch is merge-anti-joined with the runs: lines whose key the runs report as repeated, and whose document is not the
keeper, go. ``dedup`` first lets every batch add its run, so that the counts are those of the whole table, and then
merge-anti-joins the lines of every batch.

Line key: the line without ``[ \\t\\n\\v\\f\\r]`` at both ends, A-Z lower-cased; a null or empty text is one empty line.
Keys are compared by 128-bit hashes. Rows with a null doc_id take no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.store import discard, stored

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_table(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """One row per (document, key) of at least ``min_chars`` code points: batch, hash, doc_id, places of the lines."""
    lines = docs.select("doc_id", F.posexplode(lines_of("text")).alias("place", "line"))
    keyed = lines.select("doc_id", "place", key_of(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = keyed.select(F.md5("key").alias("hash"), "doc_id", "place")
    # all lines of a document come from one row, so this combines within the map task
    found = hashed.groupBy("hash", "doc_id").agg(F.collect_list("place").alias("places"))
    return found.withColumn("batch", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(batches)).cast("int"))


@dataclass
class Runs:
    """The levels of sorted runs; ``levels[i]`` holds fewer than ``fanout`` tables."""

    spark: SparkSession
    fanout: int = 2
    levels: list[list[DataFrame]] = field(default_factory=list)
    compactions: int = 0

    def add(self, batch: DataFrame) -> None:
        """The run of one batch of (hash, doc_id) rows joins level 0."""
        run = batch.groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        self._put(stored(run.sortWithinPartitions("hash"), "run-0"), 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = stored(merge_runs(runs).sortWithinPartitions("hash"), f"run-{level + 1}")
            self.compactions += 1
            for old in runs:
                discard(self.spark, old)
            self._put(merged, level + 1)

    def all(self) -> DataFrame:
        runs = [r for level in self.levels for r in level]
        return runs[0] if len(runs) == 1 else merge_runs(runs)

    def repeated(self, min_docs: int) -> DataFrame:
        return self.all().where(F.col("n_docs") >= min_docs).select("hash", "keeper")


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs).groupBy("hash").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


def surplus(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """Per document, the places of the lines to drop: their key is repeated and another document keeps it."""
    kept_elsewhere = repeated.withColumnRenamed("keeper", "other").hint("merge")
    found = lines.join(kept_elsewhere, "hash").where(~F.col("doc_id").eqNullSafe(F.col("other")))
    return found.groupBy("doc_id").agg(F.flatten(F.collect_list("places")).alias("surplus"))


def dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with ``lines`` (array), ``n_lines``, ``n_dropped`` and ``kept`` (the remaining lines, joined by newlines).

    All rows and columns stay; columns of these names that are already there are replaced. Rows that share a doc_id are one
    document, whose lines are counted once. Rows with a null doc_id lose no line."""
    spark = docs.sparkSession
    docs = docs.drop("lines", "n_lines", "n_dropped", "kept")
    lines = stored(line_table(docs.where("doc_id IS NOT NULL"), min_chars, batches), "lines", "batch")
    runs = Runs(spark, fanout)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).select("hash", "doc_id"))
    drops = surplus(lines, runs.repeated(min_docs)).withColumnRenamed("surplus", "__surplus")
    joined = docs.join(drops, "doc_id", "left").withColumn("lines", lines_of("text"))
    n = F.size("lines")
    # places that stay, by a hash set and in order: time in proportion to the lines, however many go
    places = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("__surplus", F.array().cast("array<int>")))
    out = joined.withColumn("n_lines", n.cast("long")).withColumn("__places", places)
    kept = F.array_join(F.transform("__places", lambda i: F.get(F.col("lines"), i)), "\n")
    out = (out.withColumn("kept", F.when(F.col("__surplus").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept))
           .withColumn("n_dropped", F.col("n_lines") - F.size("__places")))
    return out.select(*docs.columns, "lines", "n_lines", "n_dropped", "kept")
