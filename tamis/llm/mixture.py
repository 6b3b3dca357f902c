"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sizes are word counts. Sources, by code point and null last, have weights 3, 1, 2, 3, 1, 2, ...; they share
   ``share`` (1.5) times all words by weight, at most ``most`` (2) times their own size, the excess going to the others.
2. The documents of a source fall into blocks of about ``block_words`` words by a hash of id and text. A target is met
   by whole passes over the source and, for the rest, by a prefix of its blocks in a permuted order; of the last block, a
   prefix of its documents in hash order, so that the words taken differ from the target by at most half a document.
3. The drawn blocks of all sources are dealt to output shards: a tree halves the range of shards, and at every node the
   left half's share of each source is one multivariate-hypergeometric draw out of the node's exact quotas. At the leaves
   each shard holds an exact quota of blocks per source, as if all blocks had been shuffled and cut.
4. The permuted blocks of a source are cut by these quotas, so shards draw disjoint blocks; rows are shuffled
   within their shard.

All draws follow from ``seed`` and the data: reruns agree. Null and blank texts have size 0; rows with a null or repeated
doc_id are drawn like any others; rows that agree in id and text are drawn together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.store import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def n_words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def place(seed: int) -> Column:
    """A hash of the row that decides its block and its order in it."""
    return F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, nth, weight, source_size, target) of a table of (source, size): one row per source.

    Sources are filled in the order of cap per weight. A source is capped if its cap is within what its weight would get
    of that which the sources before it leave; the first that is not fixes the level of all others."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("nth") % len(WEIGHTS) + 1).cast("int"))
    s = total.withColumn("nth", nth).withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("all", share * F.sum("source_size").over(everything))
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    s = s.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return s.select("source", "nth", "weight", "source_size", target.alias("target"))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(nth, shard, quota): exact numbers of blocks of each source per shard. ``quotas`` is (nth, quota). Every level of
    the tree is one grouped step; a node holds at most one row per source."""
    total = F.sum("quota").over(Window.partitionBy(F.lit(1)))
    nodes = quotas.select("nth", F.col("quota").cast("bigint").alias("quota"), F.lit(0).alias("low"), F.lit(shards).alias("high"), total.cast("bigint").alias("total"))

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        low, high, total = int(rows["low"].iloc[0]), int(rows["high"].iloc[0]), int(rows["total"].iloc[0])
        if high - low == 1:
            return rows
        middle = (low + high) // 2
        rows = rows.sort_values("nth", kind="stable")
        quota = rows["quota"].to_numpy()
        left_size = total * middle // shards - total * low // shards  # shards hold equal numbers of blocks, to within one
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(quota, left_size, method="marginals")
        halves = [rows.assign(quota=left, high=middle), rows.assign(quota=quota - left, low=middle)]
        out = pd.concat(halves)
        return out[out["quota"] > 0]

    size = 1
    while size < shards:
        nodes = nodes.groupBy("low", "high").applyInPandas(split, nodes.schema)
        size *= 2
    return nodes.select("nth", F.col("low").alias("shard"), "quota")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 7, block_words: int = 1 << 18, shard_words: int = 1 << 24) -> DataFrame:
    """``docs`` (doc_id, text, source, more) with size, source_size, target, shards (their number) and draws: an array of
    (pass, shard), one per time that the mix takes the row. Columns of these names that are already there are replaced."""
    added = ["size", "source_size", "target", "shards", "draws"]
    docs = docs.drop(*added)
    sizes = stored(docs.select("doc_id", "source", n_words("text").alias("size"), place(seed).alias("place")), "sizes")
    sources = stored(targets(sizes, share, most), "sources")
    sources = sources.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)).cast("int"))
    of_source = sources.withColumnRenamed("source", "of_source")
    block = F.pmod(F.col("place"), F.col("blocks").cast("bigint")).cast("int")
    placed = sizes.join(of_source, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("block", block)

    # whole passes, and the remainder as a prefix of the permuted blocks
    of_block = stored(placed.groupBy("nth", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"),
                                                          F.first("target").alias("target")), "blocks")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    permuted = Window.partitionBy("nth").orderBy(F.xxhash64(F.lit(seed), "nth", "block"), "block")
    before = F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    planned = of_block.withColumn("passes", passes).withColumn("left", rest - before)
    whole = F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>"))
    taken_whole = F.col("left") >= F.col("words")
    planned = planned.withColumn("whole", F.when(taken_whole & (F.col("left") > 0), F.concat(whole, F.array("passes"))).otherwise(whole))
    planned = planned.withColumn("cut", F.when(~taken_whole & (F.col("left") > 0), F.col("left")))
    # of the block in which the target falls, the documents whose middle lies before it
    last = planned.where("cut IS NOT NULL").select("nth", "block", "cut")
    in_order = Window.partitionBy("nth", "block").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (placed.join(last, ["nth", "block"]).withColumn("upto", F.sum("size").over(in_order) - F.col("size") / 2)
            .where("upto <= cut").groupBy("nth", "block").agg(F.max("place").alias("last_place")))
    planned = planned.join(cuts, ["nth", "block"], "left")

    # units (source, block, pass) in a permuted order, cut by the quotas of the shards
    units = planned.select("nth", "block", F.explode(F.concat("whole", F.when(F.col("last_place").isNotNull(), F.array("passes")).otherwise(F.array().cast("array<int>")))).alias("pass"))
    units = stored(units.withColumn("rank", F.row_number().over(Window.partitionBy("nth").orderBy(F.xxhash64(F.lit(seed + 1), "nth", "block", "pass"), "block", "pass"))), "units")
    words = sources.agg(F.sum("target")).first()[0] or 0
    shards = max(int(-(-words // shard_words)), 1)
    quotas = units.groupBy("nth").agg(F.count(F.lit(1)).alias("quota"))
    quota = split_quotas(quotas, shards, seed)
    upto = F.sum("quota").over(Window.partitionBy("nth").orderBy("shard"))
    ranges = quota.withColumn("upto", upto).select("nth", "shard", (F.col("upto") - F.col("quota")).alias("after"), "upto")
    dealt = units.join(ranges, "nth").where("rank > after AND rank <= upto").groupBy("nth", "block").agg(
        F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("units"))  # at most a unit per pass
    plan = stored(planned.join(dealt, ["nth", "block"], "left").select("nth", "block", "units", "passes", "cut", "last_place"), "plan")

    # names of their own, so that no column of the input clashes
    own = docs.select(*docs.columns, n_words("text").alias("__size"), place(seed).alias("__place"))
    sources = of_source.select(*[F.col(c).alias(f"__{c}") for c in ("of_source", "nth", "source_size", "target", "blocks")])
    plan = plan.select(*[F.col(c).alias(f"__of_{c}") for c in ("nth", "block", "units", "passes", "cut", "last_place")])
    number = F.pmod(F.col("__place"), F.col("__blocks").cast("bigint")).cast("int")
    joined = own.join(sources, F.col("source").eqNullSafe(F.col("__of_source")))
    joined = joined.join(plan, (F.col("__nth") == F.col("__of_nth")) & (number == F.col("__of_block")))
    whole = F.col("__of_cut").isNull() | F.coalesce(F.col("__place") <= F.col("__of_last_place"), F.lit(False))
    units = F.coalesce("__of_units", F.array().cast("array<struct<pass:int,shard:int>>"))
    draws = F.filter(units, lambda u: (u["pass"] < F.col("__of_passes")) | whole)
    return joined.select(*docs.columns, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
                         F.lit(shards).alias("shards"), draws.alias("draws"))


def mixed_rows(mixed: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: every row as often as it was drawn, with ``pass`` and ``shard``; one partition holds whole shards, each
    in an order of its own. Documents that are not drawn are not in it."""
    rows = mixed.drop("pass", "shard")
    rows = rows.select(*[c for c in rows.columns if c not in ("draws", "shards")], F.inline("draws"))
    order = F.xxhash64(F.lit(seed + 2), "shard", "pass", "doc_id", F.xxhash64("text"))
    return rows.repartition(F.col("shard")).sortWithinPartitions("shard", order)
