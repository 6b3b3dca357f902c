"""Target-distribution importance resampling with length-bucketed CRC matrices.

Features of a text are its runs of 1 to ``runs`` words, hashed by CRC-32 into buckets. A batch's distinct features of equal
length are the rows of one matrix of bytes, and one table look-up per column moves the checksums of all rows on; the
buckets are scattered back to the places where the features occur. One pass counts the buckets of the corpus and of the
target, a second one weighs every document by the mean gain of its buckets. The weights meet fixed noise (Gumbel's, from a
hash of the id), and the highest scores are drawn, ranked over ranges of scores.

What moves: counts of buckets, then one small row per document. The gains, a number per bucket, go to every task.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null and empty texts have no features and weigh 0. A target
without features counts as one that fills all buckets alike. A null id hashes like an empty one and comes last among ties. Repeated rows are drawn
one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.ranks import numbered, placed
from tamis.llm.textbytes import ALNUM, Words, by_bytes

BUCKETS = 10_000
#: Bytes of text that are cut into features at once, and bytes of one matrix.
SLICE = 1 << 20
MATRIX = 1 << 22


@cache
def crc_table() -> np.ndarray:
    """The checksums' change by one byte, for each value of the byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def crc32_rows(texts: pa.Array) -> np.ndarray:
    """CRC-32 of every text of a string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    out = np.zeros(len(texts), dtype=np.uint32)
    lengths, table = np.diff(offsets), crc_table()
    by_length = np.argsort(lengths, kind="stable")
    for group in np.split(by_length, np.flatnonzero(np.diff(lengths[by_length])) + 1):
        length = int(lengths[group[0]]) if len(group) else 0
        step = max(MATRIX // max(length, 1), 1)
        for rows in (group[i:i + step] for i in range(0, len(group), step)):
            matrix = data[offsets[rows][:, None] + np.arange(length)]
            crc = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
            for column in np.ascontiguousarray(matrix.T):
                crc = table[(crc ^ column) & 0xFF] ^ (crc >> 8)
            out[rows] = ~crc
    return out


def features(words: Words, runs: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: (place of the first word, bucket) of every run that lies in one text."""
    if not len(words):
        return
    vocabulary, codes = words.vocabulary, words.codes.astype(np.int64)
    of = np.repeat(np.arange(len(words.counts)), words.counts)
    names, now, places = vocabulary, codes, np.arange(len(codes))
    for length in range(1, runs + 1):
        if length > 1:
            inside = places + length - 1 < len(codes)
            places, now = places[inside], now[inside]
            inside = of[places] == of[places + length - 1]
            places, now = places[inside], now[inside]
            pairs, now = np.unique(now * len(vocabulary) + codes[places + length - 1], return_inverse=True)
            left, right = pairs // len(vocabulary), pairs % len(vocabulary)
            names = pc.binary_join_element_wise(names.take(pa.array(left)), vocabulary.take(pa.array(right)), " ")
        if not len(places):
            return
        yield places, (crc32_rows(names) % buckets).astype(np.int64)[now]


def bucket_counts(texts: DataFrame, runs: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of a ``text`` column; empty buckets are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                for _, found in features(Words(part.column("text"), ALNUM), runs, buckets):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, runs: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket 1000 times the logarithm of its smoothed share of the target over that of the corpus, rounded down."""
    source = bucket_counts(docs, runs, buckets).withColumnRenamed("n", "s")
    counts = source.join(bucket_counts(target, runs, buckets).withColumnRenamed("n", "t"), "bucket", "full")
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in counts.collect():  # a row per bucket at most
        s[row.bucket], t[row.bucket] = row.s or 0, row.t or 0
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, runs: int = 2) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs`` (doc_id, text)."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                words = Words(part.column("text"), ALNUM)
                total = np.zeros(len(words) + 1, dtype=np.int64)  # gain of the runs that start at a word
                n = np.zeros(len(words) + 1, dtype=np.int64)
                for places, found in features(words, runs, buckets):
                    total[places + 1] += gain[found]
                    n[places + 1] += 1
                total, n = (np.diff(np.cumsum(x)[words.of]) for x in (total, n))
                mean = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts), pa.array(n), pa.array(mean)],
                                                 ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, runs: int = 2, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_words, n_features, weight, score and rank: of the N rows with at least
    ``min_words`` words the floor(``percent`` * N / 100) with the highest scores are ranked, ties by smaller id; the other
    ranks are null."""
    weighed = weights(docs, gains(docs, target, runs, buckets), runs)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    gumbel = F.floor(-1000 * F.log(-F.log((noise.cast("double") + 0.5) / 4294967296.0)))
    scored = numbered(weighed.withColumn("score", (F.col("weight") + gumbel).cast("long")), "scores")
    fit = placed(scored.where(F.col("n_words") >= min_words), [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "placed-scores")
    rank = F.expr(f"CASE WHEN place < {percent} * n div 100 THEN place + 1 END")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    short = scored.where(F.col("n_words") < min_words)
    return fit.select(*columns, rank.alias("rank")).unionByName(short.select(*columns, F.lit(None).cast("long").alias("rank")))
