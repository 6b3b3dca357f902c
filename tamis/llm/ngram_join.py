"""N-gram Jaccard join by T-occurrence search over inverted lists.

Two documents with sets of sizes m and n reach the threshold only if they share T(n) = ceil(threshold * n) shingles. Following
DivideSkip, the lists of a document's shingles are divided by length: the T(n) - 1 longest are not merged but probed, so
a partner must occur in at least one of the short lists (T - L = 1 with L = T - 1). Hence:

* Only short lists are stored: each document posts its ``n - T(n) + 1`` rarest shingles.
* Merging them: an equi-join on the shingle brings together the documents of one list.
* Probing: candidates' remaining shingles are binary-searched in the partner's sorted set, which answers whether the partner
  is in those long lists.

Lists are ordered by a table of 2**21 counters of how often shingles with the same leading hash bits occur, over all
documents; a passage that many documents share is thus probed, not merged. Any order gives right results.

Copies: documents with equal sets are one class, represented by its smallest doc_id. Near copies: every list is first
compared with its smallest member only; members that thus fall into one component need no further comparison, so a group of
n near copies costs about n comparisons. What remains, members of one list in different components, is compared
completely. Pairs are tested with parity sketches, within the join by short ones, then, before sets are fetched, by ones as long
as the sets need: the bits in which two sketches differ cannot outnumber the shingles in which the sets differ, so the tests
lose no pair.

Shingles are 64-bit hashes of words. Null or blank texts have an empty set and are linked with nothing. Rows that share a
doc_id are one document; rows with a null doc_id are linked with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.components import components
from tamis.llm.store import discard, stored
from tamis.llm.textbytes import NOT_SPACE, Words, by_bytes, mixed

COUNTER_BITS = 21
BLOCKS = 64
SLICE = 1 << 20
#: 64-bit words of the short sketch that joins carry.
SHORT_SKETCH = 8


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingles of every text; of a shorter text, its whole sequence of words as one."""
    found = Words(texts, NOT_SPACE)
    h = mixed(found.hashes())
    of, n = found.of, found.counts
    full = max(len(h) - words + 1, 0)
    rolled = h[:full].copy()
    for i in range(1, words):
        rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + h[i:i + full])
    sets = []
    for d in range(len(n)):
        if n[d] >= words:
            sets.append(np.unique(rolled[of[d]:of[d + 1] - words + 1]))
        elif n[d]:
            one = h[of[d]:of[d] + 1].copy()
            for i in range(1, n[d]):
                one = mixed(one * np.uint64(0x9E3779B97F4A7C15) + h[of[d] + i:of[d] + i + 1])
            sets.append(one)
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def _classes_and_counters(docs: DataFrame, words: int) -> DataFrame:
    """kind 'doc': size and fingerprint of each document's set; kind 'count': each task's counters of leading bits."""
    schema = "kind string, doc_id bigint, n bigint, fingerprint string, block int, task int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTER_BITS, dtype=np.int32)  # a task's own; sums are 64 bits wide
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                sets = shingle_sets(part.column("text"), words)
                if sets:
                    at, times = np.unique(np.concatenate(sets) >> np.uint64(64 - COUNTER_BITS), return_counts=True)
                    counters[at.astype(np.int64)] += times.astype(np.int32)
                prints = [hashlib.md5(s.tobytes()).hexdigest() if len(s) else None for s in sets]
                k = len(sets)
                none = pa.nulls(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["doc"] * k), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.string()),
                     none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())],
                    ["kind", "doc_id", "n", "fingerprint", "block", "task", "counts"])
        if counters.any():
            blocks = [b.astype("<i8").tobytes() for b in np.split(counters, BLOCKS)]
            none = pa.nulls(BLOCKS)
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(["count"] * BLOCKS), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.string()),
                 pa.array(range(BLOCKS), pa.int32()), pa.array([task] * BLOCKS, pa.int32()), pa.array(blocks, pa.binary())],
                ["kind", "doc_id", "n", "fingerprint", "block", "task", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _ranks(counts: DataFrame) -> np.ndarray:
    """One byte per counter, growing with the logarithm of its sum over all tasks: 2 MB, whatever the input. Blocks are
    added up in two steps, so that no group holds more than the square root of the number of tasks."""

    def added(keys: list[str]):
        def run(batches: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(b, dtype="<i8") for b in batches.column("counts").to_pylist()], axis=0)
            return pa.table({**{k: batches.column(k)[:1] for k in keys}, "counts": pa.array([total.tobytes()], pa.binary())})
        return run

    groups = max(int(np.sqrt(counts.select(F.max("task")).first()[0] or 0)), 1)
    partly = counts.select("block", (F.col("task") % groups).alias("part"), "counts").groupBy("block", "part").applyInArrow(
        added(["block", "part"]), "block int, part int, counts binary")
    whole = partly.select("block", "counts").groupBy("block").applyInArrow(added(["block"]), "block int, counts binary")
    ranks = np.zeros((BLOCKS, (1 << COUNTER_BITS) // BLOCKS), dtype=np.uint8)
    for row in whole.collect():  # BLOCKS rows of a fixed size
        ranks[row["block"]] = np.minimum(4 * np.log2(1 + np.frombuffer(row["counts"], dtype="<i8")), 255).astype(np.uint8)
    return ranks.reshape(-1)


def _short_lists(docs: DataFrame, words: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """Per document: size, its rarest shingles (those it posts), parity sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # 2**21 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                n, posted, sketches, bits = [], [], [], []
                for s in shingle_sets(part.column("text"), words):
                    n.append(len(s))
                    short = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    order = np.argsort(rank[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], kind="stable")
                    posted.append(s[order[:short]].view(np.int64))
                    sketches.append(parity_sketch(s))
                    bits.append(short_sketch(s))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(posted, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
                     pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "n", "posted", "sketch", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, posted array<bigint>, sketch binary, bits array<bigint>")


def short_sketch(s: np.ndarray) -> np.ndarray:
    """A parity sketch of ``SHORT_SKETCH`` words, of other bits of the hashes than the long one."""
    size = 64 * SHORT_SKETCH
    odd = np.bincount(((s >> np.uint64(20)) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity_sketch(s: np.ndarray) -> bytes:
    """Bit i: whether an odd number of shingles is i modulo the number of bits, a power of two near half the size."""
    bits = 64
    while bits < len(s) / 2:
        bits *= 2
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row, in how many bits two sketches differ; the longer ones are folded to the length of the shorter ones."""
    while a.shape[1] > b.shape[1]:
        half = a.shape[1] // 2
        a = a[:, :half] ^ a[:, half:]
    while b.shape[1] > a.shape[1]:
        half = b.shape[1] // 2
        b = b[:, :half] ^ b[:, half:]
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _near(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that their sketches do not rule out."""
    sketches = lists.select("doc_id", "n", "sketch")
    both = (pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
            .join(sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            keep = np.zeros(batch.num_rows, dtype=bool)
            shapes: dict[tuple[int, int], list[int]] = {}
            for i, (x, y) in enumerate(zip(sa, sb, strict=True)):
                shapes.setdefault((len(x), len(y)), []).append(i)
            for (lx, ly), rows in shapes.items():
                x = np.frombuffer(b"".join(sa[i] for i in rows), dtype=np.uint8).reshape(-1, lx)
                y = np.frombuffer(b"".join(sb[i] for i in rows), dtype=np.uint8).reshape(-1, ly)
                keep[rows] = (100 + percent) * differing_bits(x, y) <= (100 - percent) * total[rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _linked(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold: every shingle of the one set is binary-searched in the other."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                sets = [s.tobytes() for s in shingle_sets(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    sets = stored(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(make, "doc_id bigint, shingles binary"), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b"))
    return stored(both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint"), "linked")


def _sizes_allow(x: str, y: str, percent: int):
    return (100 * F.col(x) >= percent * F.col(y)) & (100 * F.col(y) >= percent * F.col(x))


def join(docs: DataFrame, words: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(members, links). ``members``: one row per input row: doc_id, n_shingles, representative (smallest doc_id with the
    same set; null for an empty set). ``links``: pairs (a, b) of representatives with Jaccard similarity of at least
    ``percent`` hundredths, enough of them to connect every two documents that chains of such pairs connect."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = stored(_classes_and_counters(docs, words), "classes", "kind")
    seen = first.where("kind = 'doc'").select("doc_id", "n", "fingerprint")
    ranks = _ranks(first.where("kind = 'count'").select("block", "task", "counts"))
    classes = seen.where("n > 0 AND doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("representative"))
    members = seen.join(classes, "fingerprint", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("representative")).alias("representative"))
    chosen = classes.select(F.col("representative").alias("doc_id")).distinct()
    lists = stored(_short_lists(docs.where("doc_id IS NOT NULL"), words, percent, ranks).where("n > 0").join(chosen, "doc_id", "left_semi"), "lists")

    postings = lists.select(F.explode("posted").alias("shingle"), "doc_id", "n")
    heads = postings.groupBy("shingle").agg(F.min(F.struct("doc_id", "n")).alias("head"), F.count(F.lit(1)).alias("length")).where("length > 1")
    merged = stored(postings.join(heads, "shingle").select(
        "shingle", "doc_id", "n", F.col("head.doc_id").alias("head"), F.col("head.n").alias("head_n"), "length"), "merged")
    with_head = merged.where((F.col("doc_id") != F.col("head")) & _sizes_allow("n", "head_n", percent))
    pairs = stored(_near(with_head.select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct(), lists, percent), "pairs")
    links = _linked(pairs, docs, words, percent)

    groups = stored(components(links), "groups")
    rest = merged.where("length > 2 AND doc_id <> head").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "shingle", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    mixed_lists = rest.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
    words_of_sketch = [F.col("bits")[i].alias(f"s{i}") for i in range(SHORT_SKETCH)]
    rest = stored(rest.join(mixed_lists, "shingle", "left_semi").join(lists.select("doc_id", *words_of_sketch), "doc_id"), "rest")
    x, y = (rest.select("shingle", F.col("doc_id").alias(e), F.col("n").alias(f"n{e}"), F.col("component").alias(f"c{e}"),
                        *[F.col(f"s{i}").alias(f"s{e}{i}") for i in range(SHORT_SKETCH)]) for e in "ab")
    differing = sum((F.bit_count(F.col(f"sa{i}").bitwiseXOR(F.col(f"sb{i}"))) for i in range(1, SHORT_SKETCH)), F.bit_count(F.col("sa0").bitwiseXOR(F.col("sb0"))))
    close = (100 + percent) * differing <= (100 - percent) * (F.col("na") + F.col("nb"))
    across = x.join(y, (x["shingle"] == y["shingle"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _sizes_allow("na", "nb", percent) & close)
    more = stored(_near(across.select("a", "b").distinct(), lists, percent), "pairs")
    links = links.unionByName(_linked(more, docs, words, percent))
    for done in (merged, rest, lists, pairs, more):
        discard(docs.sparkSession, done)
    return members, links


def grouped(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included)."""
    members, links = join(docs, words, percent)
    found = stored(components(links), "groups")
    joined = members.join(found.withColumnRenamed("node", "representative"), "representative", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "representative", "doc_id").alias("component_id"))


def without_copies(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs`` but for those linked, directly or not, with a document of a smaller id."""
    drop = grouped(docs, words, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)
