"""A training-data pipeline: quality, line dedup, near duplicates, decontamination, mixture.

Every stage takes the documents that its predecessor kept, written as Parquet and read again, and returns the columns of
``documents``; the last one returns the mix. ``n_chars`` is kept true to the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import lines, mixture, ngram_join, phrase_index, quality
from tamis.llm.store import new_path, stored
from tamis.llm.tables import Query, table

KEEP_FROM = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.3."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("quality_score") >= KEEP_FROM).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines of at least 40 characters that at least five documents hold, but for the
    largest doc_id's. A null text stays null."""
    out = lines.dedup(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates: those linked by chains of pairs with a Jaccard
    similarity of at least 0.8 on shingles of five words."""
    return ngram_join.without_copies(docs, words=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Documents without an id are told apart by their texts."""
    benchmark = table(spark, sf_dir, "benchmark")
    clean = _without_hits(docs.where("doc_id IS NOT NULL"), benchmark, "doc_id")
    nameless = docs.where("doc_id IS NULL")
    if nameless.isEmpty():
        return clean
    texts = nameless.where("text IS NOT NULL").select("text").distinct()
    keyed = stored(texts.select(F.monotonically_increasing_id().alias("doc_id"), "text"), "nameless")
    return clean.unionByName(_without_hits(nameless, benchmark, "text", keyed))


def _without_hits(docs: DataFrame, benchmark: DataFrame, key: str, searched: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose ``key`` no row of ``searched`` (``docs`` itself if none) with a hit has."""
    searched = docs if searched is None else searched
    dirty = phrase_index.decontaminate(searched, benchmark).where("n_hit > 0").select("doc_id")
    if key != "doc_id":
        dirty = searched.join(dirty, "doc_id", "left_semi").select(key)
    return docs.join(dirty, key, "left_anti").select(docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every drawn document as often as it was drawn, with its pass and output shard, in the shard's order."""
    return mixture.mixed_rows(mixture.mix(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
]

#: SQL can express neither the first stage nor the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERY = Query("pipeline", run, ORACLE_SQL)
