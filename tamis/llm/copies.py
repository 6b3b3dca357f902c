"""Exact dedup with a split of the heavy hitters.

Rows are compared by the SHA-256 of their texts, so only digests move. Every task summarises its digests by Misra-Gries
counters, in the form for whole batches: add the counts, and beyond ``counters`` entries take the largest one left over
from all. Added up, the summaries undercount by at most N / (counters + 1) of N rows, so whatever occurs twice as often
has an estimate above that bound, and fewer than ``counters`` digests can. Those are counted exactly; the winners, a table of
proven size, are broadcast, and their rows are decided where they are. Only the other digests are shuffled, in groups of
less than twice the bound.

Of equal texts the row with the largest id stays: null ids come first, and of equal ids the later row stays. A null text
counts as empty, nothing else is changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.ranks import numbered
from tamis.llm.store import stored

#: Counters of a task, and so the most rows that are broadcast, of about 70 bytes.
COUNTERS = 4096


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class Summary:
    """Misra-Gries counters that take batches: an estimate is never above the count and at most total / (size + 1) below."""

    def __init__(self, size: int):
        self.size = size
        self.counts: dict[bytes, int] = {}

    def add(self, values: list[bytes], counts: list[int]) -> None:
        held = self.counts
        for v, n in zip(values, counts, strict=True):
            held[v] = held.get(v, 0) + n
        if len(held) > self.size:
            cut = sorted(held.values(), reverse=True)[self.size]
            self.counts = {v: n - cut for v, n in held.items() if n > cut}


def summaries(rows: DataFrame, size: int) -> DataFrame:
    """(digest, n): the counters of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(size)
        for batch in batches:
            found = pc.value_counts(batch.column("digest"))
            summary.add(found.field("values").to_pylist(), found.field("counts").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(summary.counts), pa.binary()), pa.array(list(summary.counts.values()), pa.int64())], ["digest", "n"])

    return rows.select("digest").mapInArrow(run, "digest binary, n bigint")


@dataclass(frozen=True)
class Split:
    """``winners``: digest, keep (id, row), group_size of the frequent digests. ``rest``: row, id, digest, keep, group_size of
    all rows of other digests."""

    rows: DataFrame
    winners: DataFrame

    @property
    def rest(self) -> DataFrame:
        w = Window.partitionBy("digest")
        others = self.rows.join(F.broadcast(self.winners.select("digest")), "digest", "left_anti")
        return others.select("row", "id", "digest", F.max(F.struct("id", "row")).over(w).alias("keep"), F.count(F.lit(1)).over(w).alias("group_size"))

    def decided(self) -> DataFrame:
        """row, id, digest, keep_id, group_size, kept of every row."""
        heavy = self.rows.join(F.broadcast(self.winners), "digest").select("row", "id", "digest", "keep", "group_size")
        both = heavy.unionByName(self.rest)
        return both.select("row", "id", "digest", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"))


def split(rows: DataFrame, counters: int = COUNTERS) -> Split:
    """``rows``: row, id, digest, a stored table."""
    bound = max(rows.count() // (counters + 1), 1)
    likely = summaries(rows, counters).groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") > bound).select("digest")
    exact = rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(
        F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return Split(rows, stored(exact.where(F.col("group_size") > bound), "winners"))


def decide(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id (that of the row that stays), group_size, kept, text_sha256."""
    rows = numbered(docs.select(F.col("doc_id").alias("id"), text_digest(F.col("text")).alias("digest")), "digests")
    out = split(rows, counters).decided()
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Copies of frequent texts go within the task that reads them; of
    the others the numbers of the rows to drop are joined."""
    held = stored(docs.select(F.struct("*").alias("doc"), text_digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")), "documents")
    parts = split(held.select("row", F.col("doc.doc_id").alias("id"), "digest"), counters)
    heavy = F.broadcast(parts.winners.select("digest", F.col("keep.row").alias("keep_row")))
    light = held.join(heavy, "digest", "left").where("keep_row IS NULL OR row = keep_row")
    drops = parts.rest.where("row <> keep.row").select("row")
    return light.join(drops, "row", "left_anti").select("doc.*")
