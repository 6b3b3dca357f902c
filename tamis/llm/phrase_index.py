"""Benchmark decontamination with a distributed positional inverted index.

Building. Documents are cut into segments of a few megabytes of text, each within one task. A segment's words are numbered
through, with a gap between documents, and every term of the segment becomes one posting list: its positions, ascending,
as differences. The index is a table in the shared folder: kind 'term' holds (segment, term, n, width, postings), kind
'doc' holds (segment, doc_id, start, n_words). Nothing is shuffled to build it, every word is stored.

Searching. Queries are sequences of terms. From the lists' lengths follows how often each query term occurs in all documents;
a query is looked up in the segments where its rarest term occurs, and there the lists of its terms, each shifted by the
term's offset, are intersected from the rarest on. Proximity search finds the windows of ``within`` words that hold all terms of the
query, in any order, as often as the query does.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null texts have no words. Rows that share a doc_id are
searched one by one and reported together. Null ids are reported under null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.store import stored
from tamis.llm.textbytes import ALNUM, Words, by_bytes

SEGMENT = 3 << 19
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "kind string, segment bigint, term string, n bigint, width int, postings binary, doc_id bigint, start bigint, n_words bigint"
COLUMNS = ["kind", "segment", "term", "n", "width", "postings", "doc_id", "start", "n_words"]
#: Queries are searched in blocks of about so many, so that a segment's group stays small however many queries there are.
QUERY_BLOCK = 200_000


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def segment_rows(part: pa.RecordBatch, segment: int) -> Iterator[pa.RecordBatch]:
    """The index rows of one segment."""
    words = Words(part.column("text"), ALNUM)
    counts = words.counts
    docs = len(counts)
    starts = words.of[:-1] + np.arange(docs)  # a gap of one position between documents
    none = pa.nulls(docs)
    yield pa.RecordBatch.from_arrays(
        [pa.array(["doc"] * docs), pa.array(np.full(docs, segment)), none.cast(pa.string()), none.cast(pa.int64()), none.cast(pa.int32()),
         none.cast(pa.binary()), part.column("doc_id"), pa.array(starts), pa.array(counts)], COLUMNS)
    if not len(words):
        return
    place = np.arange(len(words)) + np.repeat(np.arange(docs), counts)
    order = np.sort((words.codes.astype(np.int64) << 32) | place)
    code, place = order >> 32, order & 0xFFFFFFFF
    first = np.flatnonzero(np.diff(code, prepend=-1))
    delta = np.diff(place, prepend=0)
    delta[first] = place[first]
    n = np.diff(np.append(first, len(code)))
    most = np.maximum.reduceat(delta, first)
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.int32)
    # the lists of each width are cut out of one buffer
    blobs = np.empty(len(n), dtype=object)
    for w, kind in ((1, "<u1"), (2, "<u2"), (4, "<u4")):
        mine = np.flatnonzero(width == w)
        if len(mine):
            data = delta[np.repeat(width == w, n)].astype(kind).tobytes()
            ends = np.cumsum(n[mine]) * w
            blobs[mine] = [data[a:b] for a, b in zip(ends - n[mine] * w, ends, strict=True)]
    terms = words.vocabulary.take(pa.array(code[first]))
    by_term = pc.sort_indices(terms)
    k = len(n)
    none = pa.nulls(k)
    yield pa.RecordBatch.from_arrays(
        [c.take(by_term) for c in (pa.array(["term"] * k), pa.array(np.full(k, segment)), terms, pa.array(n), pa.array(width), pa.array(blobs, pa.binary()),
                                   none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()))], COLUMNS)


def build(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in by_bytes(batch, "text", SEGMENT):
                for rows in segment_rows(part, number):
                    for i in range(0, rows.num_rows, 20_000):
                        yield rows.slice(i, 20_000)
                number += 1

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)
    return stored(rows, "phrase-index", "kind")


def positions(width: int, postings: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(postings, dtype=f"<u{width}").astype(np.int64))


def phrase_starts(lists: list[np.ndarray]) -> np.ndarray:
    """Where the i-th list has an entry i places on, for all i; the shortest lists are intersected first."""
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    found = lists[order[0]] - order[0]
    for i in order[1:]:
        if not len(found):
            break
        at = np.searchsorted(lists[i], found + i)
        found = found[lists[i][np.minimum(at, len(lists[i]) - 1)] == found + i]
    return found


def near_starts(lists: list[np.ndarray], times: list[int], within: int) -> np.ndarray:
    """Positions at which a window of ``within`` words starts, at one of the terms, that holds list i ``times[i]`` times."""
    rarest = min(lists, key=len)
    starts = np.unique(np.concatenate(lists))
    at = np.searchsorted(rarest, starts)
    starts = starts[rarest[np.minimum(at, len(rarest) - 1)] - starts < within]  # windows without the rarest term go first
    for held, k in sorted(zip(lists, times, strict=True), key=lambda x: len(x[0])):
        at = np.searchsorted(held, starts) + k - 1
        last = held[np.minimum(at, len(held) - 1)]
        starts = starts[(at < len(held)) & (last >= starts) & (last - starts < within)]
    return starts


def search(index: DataFrame, queries: DataFrame, within: int | None = None) -> DataFrame:
    """Matches of ``queries`` (query_id string, terms array<string>, not empty): query_id, doc_id, start (word number in its
    document, from 0), length (words). Exact phrases, or, with ``within``, proximity matches. Several documents of one id
    are told apart by ``segment`` and ``doc_start``."""
    # written first, so that the size is known when the join is planned: the postings move only if the terms are too many to send out
    terms = stored(queries.select(F.explode(F.array_distinct("terms")).alias("term")).distinct(), "terms")
    lists = stored(index.where("kind = 'term'").select("segment", "term", "n", "width", "postings").join(terms, "term", "left_semi"), "lists")
    total = lists.groupBy("term").agg(F.sum("n").alias("total"))
    spread = queries.select("query_id", "terms", F.explode("terms").alias("term"))
    rarest = (spread.join(total, "term", "left").groupBy("query_id", "terms")
              .agg(F.min(F.struct(F.coalesce("total", F.lit(0)).alias("total"), "term")).alias("least")).where("least.total > 0"))
    blocks = max(rarest.count() // QUERY_BLOCK, 1)
    placed = rarest.select("query_id", "terms", F.col("least.term").alias("term"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    wanted = lists.select("segment", "term").join(placed, "term").select(
        F.col("segment").alias("in_segment"), F.col("block").alias("in_block"), "query_id", "terms")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    held = lists.select("segment", "term", "width", "postings", F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("start"),
                        F.lit(0).cast("bigint").alias("n_words"))
    docs = index.where("kind = 'doc'").select("segment", F.lit(None).cast("string").alias("term"), F.lit(0).alias("width"),
                                              F.lit(None).cast("binary").alias("postings"), "doc_id", "start", "n_words")
    held = held.unionByName(docs).select("*", every_block)

    def run(index_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.string()), "segment": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()),
                          "doc_start": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "length": pa.array([], pa.int64())})
        if not query_rows.num_rows or not index_rows.num_rows:
            return empty
        is_doc = pc.is_null(index_rows.column("term"))
        docs = index_rows.filter(is_doc).sort_by([("start", "ascending"), ("n_words", "descending")])
        docs = docs.filter(pc.greater(docs.column("n_words"), 0))
        starts = docs.column("start").to_numpy()
        ends = starts + docs.column("n_words").to_numpy()
        postings = index_rows.filter(pc.invert(is_doc))
        by_term = {t: i for i, t in enumerate(postings.column("term").to_pylist())}
        widths, blobs = postings.column("width").to_pylist(), postings.column("postings")
        ready: dict[str, np.ndarray] = {}

        def places(term: str) -> np.ndarray:
            if term not in ready:
                i = by_term[term]
                ready[term] = positions(widths[i], blobs[i].as_py())
            return ready[term]

        ids, at, lengths = [], [], []
        for query_id, terms in zip(query_rows.column("query_id").to_pylist(), query_rows.column("terms").to_pylist(), strict=True):
            if any(t not in by_term for t in terms):
                continue
            if within is None:
                found, length = phrase_starts([places(t) for t in terms]), len(terms)
            else:
                distinct = list(dict.fromkeys(terms))
                found, length = near_starts([places(t) for t in distinct], [terms.count(t) for t in distinct], within), within
            if len(found):
                ids.append(np.full(len(found), query_id, dtype=object))
                at.append(found)
                lengths.append(np.full(len(found), length))
        if not at:
            return empty
        at, ids, lengths = np.concatenate(at), np.concatenate(ids), np.concatenate(lengths)
        of = np.searchsorted(starts, at, side="right") - 1
        if within is not None:  # a window may reach beyond its document; what lies there is not its text
            lengths = np.minimum(lengths, ends[of] - at)
        out = pa.table({"query_id": pa.array(ids, pa.string()), "segment": pa.array(np.full(len(at), index_rows.column("segment")[0].as_py())),
                        "doc_id": docs.column("doc_id").take(pa.array(of)), "doc_start": pa.array(starts[of]), "start": pa.array(at - starts[of]),
                        "length": pa.array(lengths)})
        return out

    return held.groupBy("segment", "block").cogroup(wanted.groupBy("in_segment", "in_block")).applyInArrow(
        run, "query_id string, segment bigint, doc_id bigint, doc_start bigint, start bigint, length bigint")


def windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(item_id, query_id, terms): all runs of ``size`` words of each item, or its whole sequence if shorter; the same words
    have the same query_id. Items without words have none."""
    listed = benchmark.select("item_id", words_of("text").alias("ws")).where("size(ws) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (size - 1), F.lit(1)))
    cut = listed.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("ws"), i, size))).alias("terms"))
    return cut.select("item_id", F.sha2(F.array_join("terms", " "), 256).alias("query_id"), "terms").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """One row per document id: doc_id, n_words, n_hit (words inside any occurrence of a window), items (sorted ids, as
    strings, of the items with an occurring window)."""
    index = build(docs)
    wanted = windows(benchmark, size)
    queries = wanted.select("query_id", "terms").dropDuplicates(["query_id"])
    found = stored(search(index, stored(queries, "windows")), "matches")
    places = found.groupBy("segment", "doc_start", "doc_id", "start").agg(F.max("length").alias("length"))
    placed = places.select("doc_id", "segment", "doc_start", "start", (F.col("start") + F.col("length")).alias("end"))
    # words of a match that no earlier match of the document covers; a document's matches are no more than its words
    covered = F.expr("max(end) OVER (PARTITION BY segment, doc_start, doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    hits = placed.select("doc_id", "start", "end", covered.alias("covered")).select(
        "doc_id", F.greatest(F.col("end") - F.greatest("start", F.coalesce("covered", "start")), F.lit(0)).alias("hit"))
    n_hit = hits.groupBy("doc_id").agg(F.sum("hit").alias("n_hit"))
    items = (found.select("doc_id", "query_id").distinct().join(wanted.select("item_id", "query_id"), "query_id")
             .select("doc_id", F.col("item_id").cast("string").alias("item_id")).distinct()
             .groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("items")))
    every = index.where("kind = 'doc'").groupBy("doc_id").agg(F.sum("n_words").alias("n_words"))
    joined = (every.join(n_hit.withColumnRenamed("doc_id", "hit_id"), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").drop("hit_id")
              .join(items.withColumnRenamed("doc_id", "item_doc"), F.col("doc_id").eqNullSafe(F.col("item_doc")), "left").drop("item_doc"))
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
