"""Merkle manifest of a table: per group a hash tree over its rows, and one over the groups' roots. Spark SQL only.

A hash is 64 hex digits. Nodes are cut into aligned blocks of ``fan ** depth``; a block is one row of a table and keeps
every level of its tree as one string, the hashes of the level side by side. Fixed-width substrings of a level are the
runs whose hashes make the next one. The tops of the blocks are the nodes of the next round, until each group has one
block; the tops of the groups, in order, are the nodes of a tree of the same kind. Rounds shrink by the size of a block.

A proof is a list of (before, after), one per level: what flanks the node within its run, as substrings of the level.
Proofs are handed down from round to round, a row per block; those of the rows are made, used and dropped inside the block.

Hash of a list of texts: SHA-256 of their concatenation. A leaf hashes its row's fields, each ``-`` if null, else its byte
count, ``:`` and the value. Rows of a group are in the order of their key, null first; rows with equal keys by their
leaves. Repeated rows are leaves of their own. A null group is a group, the first. An empty table has no rows and no root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.ranks import numbered, placed
from tamis.llm.store import stored

HASH = 64
PATH = "array<struct<before: string, after: string>>"


def digest(*fields: Column) -> Column:
    """The hash of a row: every field as ``-`` or as byte count, colon, value."""

    def piece(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.sha2(F.concat(*(piece(c) for c in fields)).cast("binary"), 256)


@dataclass(frozen=True)
class Shape:
    fan: int = 2
    depth: int = 9

    @property
    def block(self) -> int:
        return self.fan ** self.depth

    def levels(self, base: str, n: str) -> str:
        """SQL of a block's levels, from ``base`` (binary) up: as many as its group of ``n`` nodes needs, at most ``depth``."""
        powers = ", ".join(f"{self.fan ** i}L" for i in range(self.depth))
        run = self.fan * HASH
        parents = (f"cast(array_join(transform(sequence(0, (length(element_at(acc, -1)) - 1) div {run}),"
                   f" i -> sha2(substring(element_at(acc, -1), cast(1 + i * {run} AS INT), {run}), 256)), '') AS BINARY)")
        return f"aggregate(filter(array({powers}), p -> p < {n}), array({base}), (acc, p) -> concat(acc, array({parents})))"

    def flanks(self, j: str) -> str:
        """SQL of the (before, after) of node ``j`` (from 0) at every level of the column ``levels`` but the top."""
        at = f"cast({j} div cast(power({self.fan}, l) AS BIGINT) AS INT)"
        first = f"({at} div {self.fan} * {self.fan})"
        before = f"substring(level, cast(1 + {first} * {HASH} AS INT), cast(({at} - {first}) * {HASH} AS INT))"
        after = f"substring(level, 1 + ({at} + 1) * {HASH}, cast(({first} + {self.fan - 1} - {at}) * {HASH} AS INT))"
        return (f"transform(slice(levels, 1, size(levels) - 1), (level, l) -> named_struct("
                f"'before', cast({before} AS STRING), 'after', cast({after} AS STRING)))")


def top(levels: str = "levels") -> Column:
    return F.element_at(levels, -1).cast("string")


def folded(start: str, path: str) -> str:
    """SQL of the root that a node and its proof lead to."""
    return f"aggregate({path}, {start}, (h, s) -> sha2(concat(s.before, h, s.after), 256))"


def proof_text(path: str) -> str:
    return f"array_join(flatten(transform({path}, s -> array(s.before, s.after))), '')"


def grow(nodes: DataFrame, shape: Shape, name: str) -> list[DataFrame]:
    """The rounds of block tables over ``nodes`` (grp, place, n, hash, item): grp, block, n, levels, items. Every group has
    one block in the last."""
    rounds: list[DataFrame] = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        held = nodes.groupBy("grp", F.expr(f"place div {shape.block}").alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("place", "hash", "item"))).alias("nodes"), F.max("n").alias("n"))
        base = "cast(array_join(transform(nodes, x -> x.hash), '') AS BINARY)"
        blocks = held.select("grp", "block", "n", F.expr(shape.levels(base, "n")).alias("levels"), F.expr("transform(nodes, x -> x.item)").alias("items"))
        rounds.append(stored(blocks, f"{name}-{len(rounds)}"))
        if most <= shape.block:
            return rounds
        most = -(-most // shape.block)
        nodes = rounds[-1].select("grp", F.col("block").alias("place"), F.expr(f"(n + {shape.block - 1}) div {shape.block}").alias("n"),
                                  top().alias("hash"), F.lit(None).cast("string").alias("item"))


def descend(rounds: list[DataFrame], shape: Shape, above: DataFrame) -> DataFrame:
    """The blocks of the first round with ``path``, the proof of their tops, and the further columns of ``above`` (grp, path, ...),
    which has a row per group."""
    more = [c for c in above.columns if c not in ("grp", "path")]
    got = above.select(F.col("grp").alias("__grp"), *(c for c in above.columns if c != "grp"))
    held = rounds[-1].join(got, F.col("grp").eqNullSafe(F.col("__grp"))).drop("__grp")
    for lower in reversed(rounds[:-1]):
        child = f"named_struct('__block', block * {shape.block} + j, 'path', concat({shape.flanks('j')}, path))"
        n = f"length(levels[0]) div {HASH}"
        below = held.select(F.col("grp").alias("__grp"), *more, F.expr(f"inline(transform(sequence(0L, {n} - 1), j -> {child}))"))
        held = lower.join(below, F.col("grp").eqNullSafe(F.col("__grp")) & (F.col("block") == F.col("__block"))).drop("__grp", "__block")
    return held


@dataclass(frozen=True)
class Manifest:
    """The trees of a table. ``rows`` are the rounds over the rows, ``groups`` those over the groups' roots."""

    shape: Shape
    rows: list[DataFrame]
    groups: list[DataFrame]

    def root(self) -> str | None:
        """The root of the table, None if it is empty."""
        found = self.groups[-1].select(top().alias("root")).first()
        return found and found.root

    def subroots(self) -> DataFrame:
        """grp, subroot, n (rows of the group)."""
        sizes = self.rows[0].groupBy("grp").agg(F.max("n").alias("n")).withColumnRenamed("grp", "__grp")
        tops = self.rows[-1].select("grp", top().alias("subroot"))
        return tops.join(sizes, F.col("grp").eqNullSafe(F.col("__grp"))).drop("__grp")

    def blocks(self) -> DataFrame:
        """The blocks of rows with ``path`` (proof of the block's top up to the root), ``subroot`` and ``root``."""
        nothing = F.expr(f"cast(array() AS {PATH})")
        start = self.groups[-1].select("grp", nothing.alias("path"), top().alias("root"))
        groups = descend(self.groups, self.shape, start)
        each = f"transform(items, (g, j) -> named_struct('grp', g, 'path', concat({self.shape.flanks('j')}, path)))"
        above = groups.select("root", F.expr(f"inline({each})")).withColumnRenamed("grp", "__g")
        tops = self.rows[-1].select("grp", top().alias("subroot"))
        return descend(self.rows, self.shape, tops.join(above, F.col("grp").eqNullSafe(F.col("__g"))).drop("__g"))


def build(leaves: DataFrame, shape: Shape = Shape()) -> Manifest:
    """The manifest of ``leaves``: grp (string), key, hash, item (what the caller wants back with each row)."""
    rows = numbered(leaves.select("grp", "key", "hash", "item"), "leaves")
    ordered = placed(rows, ["grp"], [F.col("key").asc_nulls_first(), F.col("hash").asc()], "placed-leaves")
    rounds = grow(ordered, shape, "row-blocks")
    tops = numbered(rounds[-1].select("grp", top().alias("hash")), "subroots")
    tops = placed(tops, [], [F.col("grp").asc_nulls_first()], "placed-subroots")
    groups = grow(tops.select(F.lit(0).alias("grp"), "place", "n", "hash", F.col("grp").alias("item")), shape, "group-blocks")
    return Manifest(shape, rounds, groups)


def audit(rows: DataFrame, key: str, group: str, fields: list[str], changed: dict[str, Column], where: Column, shape: Shape = Shape()) -> DataFrame:
    """Every row held against the manifest of ``rows``: the key, ``leaf``, ``subroot``, ``root``, ``proof`` (siblings, level by
    level up to the root, left to right), ``folded_root`` and ``verified``.

    The manifest is that of the rows as they are. ``folded_root`` is recomputed from the row as found, which differs in the
    columns of ``changed`` where ``where`` holds, and the siblings of the manifest."""
    leaf = digest(*(F.col(c) for c in fields))
    found = F.when(F.coalesce(where, F.lit(False)), digest(*(changed.get(c, F.col(c)) for c in fields)))
    item = F.struct(F.col(key).alias("key"), found.alias("found"))
    held = build(rows.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("key"), leaf.alias("hash"), item.alias("item")), shape).blocks()
    own = f"cast(substring(levels[0], 1 + j * {HASH}, {HASH}) AS STRING)"
    proved = f"transform(items, (d, j) -> named_struct('d', d, 'leaf', {own}, 'path', concat({shape.flanks('j')}, path)))"
    row = (f"named_struct({_named(key)}, x.d.key, 'leaf', x.leaf, 'subroot', subroot, 'root', root, 'proof', {proof_text('x.path')},"
           f" 'folded_root', {folded('coalesce(x.d.found, x.leaf)', 'x.path')})")
    out = held.select(F.expr(f"inline(transform({proved}, x -> {row}))"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _named(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"
