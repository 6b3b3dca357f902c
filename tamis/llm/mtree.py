"""Exact top-k search by inner product with paged M-trees.

Metric. The inner product is no metric; with one more coordinate it becomes one. Let ``norm`` be the largest length of
a vector. A vector x becomes (x, sqrt(norm**2 - |x|**2)), a query q becomes (q, 0), and the squared Euclidean distance of the two is
|q|**2 + norm**2 - 2 q.x: the nearest are those of the highest inner products.

Forest. Pivots, a bounded sample of the vectors, divide the space; a vector belongs to its nearest pivot, and the
vectors of a pivot are dealt to trees of at most about ``tree_size`` rows. Every tree is an M-tree: a page holds up to ``page`` entries;
an entry of an inner page has a routing vector, a covering radius and its distance to the routing vector of its own page (parent
distance); an entry of a leaf is a vector with its parent distance. Trees are a table of pages in the shared folder.

Search. A query goes best-first through a tree: pages wait in a queue by their least possible distance, max(0, d(q, routing) - radius). An
entry whose parent distance differs from d(q, parent) by more than radius + current k-th distance is skipped without
computing its distance. The first round searches the query's nearest tree; its k-th distance then rules out whole pivots in
the second round, by d(q, pivot) - radius, and bounds the search in the trees that remain. Scores are exact integers;
bounds carry a slack for rounding, so nothing is lost, and equal scores are ordered by the smaller id.

Vectors that are null or hold null or non-finite components take no part; neither do rows without an id. Rows that share an id are
candidates one by one. A query is compared with the vectors of its own length only: every length has pivots and trees of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.store import stored

PIVOTS = 256
#: So many of the most common lengths share the pivots; every other length has one.
COMMON_LENGTHS = 8
#: Queries of a group at most, about; a tree's pages are sent once for each of them.
QUERY_BLOCK = 4096
TREE = "tree bigint, page int, parent int, leaf boolean, entries int, ids array<bigint>, vectors binary, radii binary, parent_distances binary, children array<int>"
SLACK = 1e-6


def whole_vectors(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double; null for vectors that take no part."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(x * scale).cast("bigint")))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def raised(x: np.ndarray, norm2: float) -> np.ndarray:
    """Vectors with the coordinate that makes inner products distances."""
    return np.hstack([x, np.sqrt(np.maximum(norm2 - (x**2).sum(axis=1), 0))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((a - b) ** 2).sum(axis=-1), 0))


# Building

def build_tree(ids: np.ndarray, x: np.ndarray, page: int) -> list[dict]:
    """The pages of an M-tree over ``x``, root first. Pages are split top-down: routing vectors far from each other, every
    entry to its nearest."""
    pages: list[dict] = []

    def routing(rows: np.ndarray) -> np.ndarray:
        center = x[rows].mean(axis=0)
        return x[rows[np.argmin(distances(x[rows], center))]]

    def add(rows: np.ndarray, parent: int, route: np.ndarray) -> int:
        number = len(pages)
        pages.append({})
        if len(rows) <= page:
            pages[number] = {"parent": parent, "ids": ids[rows], "vectors": x[rows], "radii": np.zeros(len(rows)), "children": [],
                             "parent_distances": distances(x[rows], route)}
            return number
        fan = min(page, max(2, -(-len(rows) // page)))
        chosen = [int(np.argmax(distances(x[rows], route)))]
        near = distances(x[rows], x[rows[chosen[0]]])
        while len(chosen) < fan and near.max() > 0:
            chosen.append(int(np.argmax(near)))
            near = np.minimum(near, distances(x[rows], x[rows[chosen[-1]]]))
        centers = x[rows[chosen]]
        square = (x[rows] ** 2).sum(axis=1)[:, None] + (centers**2).sum(axis=1)[None] - 2 * x[rows] @ centers.T
        side = np.argmin(square, axis=1)
        if len(chosen) == 1:  # all vectors are equal: cut anywhere
            side = np.arange(len(rows)) * fan // len(rows)
        routes, radii, children = [], [], []
        for s in range(int(side.max()) + 1):
            mine = rows[side == s]
            if not len(mine):
                continue
            if len(mine) > page and len(mine) > 0.9 * len(rows):  # a lump: halve it, so that the depth stays logarithmic
                order = mine[np.argsort(distances(x[mine], centers[min(s, len(centers) - 1)]), kind="stable")]
                parts = [order[:len(order) // 2], order[len(order) // 2:]]
            else:
                parts = [mine]
            for part in parts:
                r = routing(part)
                routes.append(r)
                radii.append(distances(x[part], r).max())
                children.append(add(part, number, r))
        routes = np.stack(routes)
        pages[number] = {"parent": parent, "ids": np.zeros(0, dtype=np.int64), "vectors": routes, "radii": np.array(radii), "children": children,
                         "parent_distances": distances(routes, route)}
        return number

    if len(ids):
        everything = np.arange(len(ids))
        add(everything, -1, routing(everything))
    return pages


def _packed(pages: list[dict], tree: int) -> dict[str, list]:
    return {
        "tree": [tree] * len(pages), "page": list(range(len(pages))), "parent": [p["parent"] for p in pages], "leaf": [not p["children"] for p in pages],
        "entries": [len(p["vectors"]) for p in pages], "ids": [p["ids"] for p in pages], "vectors": [p["vectors"].astype("<f8").tobytes() for p in pages],
        "radii": [p["radii"].astype("<f8").tobytes() for p in pages], "parent_distances": [p["parent_distances"].astype("<f8").tobytes() for p in pages],
        "children": [p["children"] for p in pages]}


def _unpacked(rows: pa.Table) -> list[dict]:
    out: list[dict] = [{}] * rows.num_rows
    for r in rows.select(["page", "leaf", "entries", "ids", "vectors", "radii", "parent_distances", "children"]).to_pylist():
        out[r["page"]] = {"leaf": r["leaf"], "ids": np.array(r["ids"], dtype=np.int64), "vectors": np.frombuffer(r["vectors"], "<f8").reshape(r["entries"], -1),
                          "radii": np.frombuffer(r["radii"], "<f8"), "parent_distances": np.frombuffer(r["parent_distances"], "<f8"), "children": r["children"]}
    return out


# Searching

class Best:
    """The k best (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, k: int, least: float):
        self.k, self.least = k, least
        self.heap: list[tuple[int, int]] = []

    @property
    def floor(self) -> float:
        """Scores below this cannot be among the best."""
        return max(self.least, self.heap[0][0]) if len(self.heap) == self.k else self.least

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.floor)
        if len(good) > self.k:
            good = good[np.lexsort((ids[good], -scores[good]))[:self.k]]
        for s, i in zip(scores[good].tolist(), ids[good].tolist(), strict=True):
            entry = (int(s), -int(i))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def search_tree(pages: list[dict], q: np.ndarray, norm2: float, best: Best, own: int, count: dict[str, int]) -> None:
    """Best-first search of one tree for the query ``q`` (not raised), leaving out the row with the query's own id."""
    if not pages:
        return
    q2 = float(q @ q)
    target = np.append(q, 0.0)

    def reach() -> float:
        """The distance at which a vector's score equals the current k-th best."""
        floor = best.floor
        return np.inf if floor == -np.inf else float(np.sqrt(max(q2 + norm2 - 2 * floor, 0))) + SLACK * (1 + np.sqrt(q2 + norm2))

    queue: list[tuple[float, int, float]] = [(0.0, 0, np.nan)]
    while queue:
        bound, number, to_parent = heapq.heappop(queue)
        if bound > reach():
            break
        page = pages[number]
        limit = reach()
        if np.isnan(to_parent):
            near = np.arange(len(page["vectors"]))
        else:  # triangle inequality on stored distances: no distance is computed for the others
            near = np.flatnonzero(np.abs(to_parent - page["parent_distances"]) - page["radii"] <= limit)
        count["computed"] += len(near)
        count["avoided"] += len(page["vectors"]) - len(near)
        if not len(near):
            continue
        if page["leaf"]:
            scores = np.rint(page["vectors"][near, :-1] @ q).astype(np.int64)
            ids = page["ids"][near]
            others = ids != own
            best.offer(scores[others], ids[others])
        else:
            d = distances(page["vectors"][near], target)
            lower = np.maximum(d - page["radii"][near], 0)
            for i, low, dist in zip(near.tolist(), lower.tolist(), d.tolist(), strict=True):
                if low <= limit:
                    heapq.heappush(queue, (low, page["children"][i], dist))


def by_length(batch: pa.RecordBatch, vector: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each length of ``vector``."""
    lengths = pc.list_value_length(batch.column(vector)).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))


class _Centers:
    """Pivots by the length of their vectors: numbers and raised vectors."""

    def __init__(self, numbers: list[int], vectors: list[np.ndarray]):
        by: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by.setdefault(len(v) - 1, []).append(i)
        self._of = {n: (np.array([numbers[i] for i in rows]), np.stack([vectors[i] for i in rows])) for n, rows in by.items()}

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        return self._of.get(length, (np.zeros(0, dtype=np.int64), np.zeros((0, length + 1))))


def build(vectors: DataFrame, pivots: int = PIVOTS, tree_size: int = 4096, page: int = 128) -> tuple[DataFrame, DataFrame, float]:
    """(pages, pivots, norm2) of ``vectors`` (vec_id, v: array<bigint>). The pivot table holds at most ``pivots`` rows, and
    one for each rare length: pivot, vector, radius, trees. ``norm2`` is the largest squared length."""
    spark = vectors.sparkSession
    norm = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    sizes = vectors.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm2"))
    sizes = sizes.orderBy(F.desc("n"), "length").collect()  # a row per length
    norm2 = float(max((r["norm2"] for r in sizes), default=0) or 0)
    place = [F.xxhash64(F.lit(5), "vec_id"), F.col("vec_id")]
    chosen = [r["v"] for s in sizes[:COMMON_LENGTHS]
              for r in vectors.where(F.size("v") == s["length"]).orderBy(*place).limit(int(min(max(s["n"] // 1024, 1), pivots // COMMON_LENGTHS if len(sizes) > 1 else pivots))).collect()]
    rare = [s["length"] for s in sizes[COMMON_LENGTHS:]]
    if rare:
        others = vectors.where(~F.size("v").isin([s["length"] for s in sizes[:COMMON_LENGTHS]]))
        chosen += [r["v"] for r in others.groupBy(F.size("v")).agg(F.min_by("v", F.struct(*place)).alias("v")).collect()]
    centers = [raised(np.array([v], dtype=np.float64), norm2)[0] for v in chosen]
    shared = spark.sparkContext.broadcast(_Centers(list(range(len(centers))), centers))  # at most `pivots` vectors, and one of each rare length

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, part in by_length(batch, "v"):
                number, c = shared.value.of(length)
                x = raised(_matrix(part.column("v")), norm2)
                d2 = (x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * x @ c.T
                nearest = np.argmin(d2, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("v"), pa.array(number[nearest].astype(np.int32)), pa.array(distances(x, c[nearest]))], ["vec_id", "v", "pivot", "distance"])

    assigned = stored(vectors.select("vec_id", "v").mapInArrow(assign, "vec_id bigint, v array<bigint>, pivot int, distance double"), "assigned")
    of_pivot = assigned.groupBy("pivot").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n"))
    of_pivot = of_pivot.withColumn("trees", F.ceil(F.col("n") / tree_size).cast("int")).collect()  # at most `pivots` rows
    table = spark.createDataFrame([(r["pivot"], centers[r["pivot"]].tolist(), r["radius"], r["trees"]) for r in of_pivot],
                                  "pivot int, vector array<double>, radius double, trees int")
    # a pivot's vectors are dealt to its trees by the hash of their ids, so that no tree outgrows a task
    dealt = assigned.join(F.broadcast(table.select("pivot", "trees")), "pivot")
    tree = F.col("pivot").cast("bigint") * (1 << 32) + F.pmod(F.xxhash64(F.lit(6), "vec_id", "v"), F.col("trees").cast("bigint"))

    def grow(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x = raised(_matrix(rows.column("v").chunk(0)), norm2)
        packed = _packed(build_tree(ids[order], x[order], page), rows.column("tree")[0].as_py())
        return pa.table({k: pa.array(v) if k not in ("ids", "children") else pa.array(v, pa.list_(pa.int64() if k == "ids" else pa.int32())) for k, v in packed.items()}).cast(PAGES)

    pages = stored(dealt.select(tree.alias("tree"), "vec_id", "v").groupBy("tree").applyInArrow(grow, TREE), "pages")
    return pages, table, norm2


PAGES = pa.schema([("tree", pa.int64()), ("page", pa.int32()), ("parent", pa.int32()), ("leaf", pa.bool_()), ("entries", pa.int32()), ("ids", pa.list_(pa.int64())),
                   ("vectors", pa.binary()), ("radii", pa.binary()), ("parent_distances", pa.binary()), ("children", pa.list_(pa.int32()))])
FOUND = "query_id bigint, vec_id bigint, score bigint, computed bigint, avoided bigint"


def _routes(queries: DataFrame, pivots: DataFrame, norm2: float, home: bool) -> DataFrame:
    """(tree, query_id, q, least): for the first round one tree of the query's nearest pivot; for the second, all other trees of all
    pivots that may hold a score of at least ``least``."""
    rows = {r["pivot"]: r for r in pivots.collect()}  # bounded by the number of pivots
    shared = _Centers(list(rows), [np.array(r["vector"]) for r in rows.values()])
    of_pivot = {i: (r["radius"], r["trees"]) for i, r in rows.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, batch in (x for batch in batches for x in by_length(batch, "q")):
            number, centers = shared.of(length)
            radius, trees = (np.array([of_pivot[i][j] for i in number.tolist()]) for j in (0, 1))
            q = _matrix(batch.column("q"))
            out: list[list[int]] = []
            q2 = (q**2).sum(axis=1)
            least = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            ids = batch.column("query_id").to_pylist()
            d = np.sqrt(np.maximum(q2[:, None] + (centers**2).sum(axis=1)[None] - 2 * q @ centers[:, :-1].T, 0))
            for i in range(len(q) if len(number) else 0):
                nearest = int(np.argmin(d[i] - radius))
                first = int(number[nearest]) * (1 << 32) + (ids[i] % int(trees[nearest]))
                if home:
                    out.append([first])
                    continue
                limit = np.inf if np.isnan(least[i]) else np.sqrt(max(q2[i] + norm2 - 2 * least[i], 0)) + SLACK * (1 + np.sqrt(q2[i] + norm2))
                some = np.flatnonzero(d[i] - radius <= limit)
                out.append([t for p in some for t in range(int(number[p]) * (1 << 32), int(number[p]) * (1 << 32) + int(trees[p])) if t != first])
            out = out or [[]] * len(q)  # no vector of this length is indexed
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("q"), batch.column("least"), pa.array(out, pa.list_(pa.int64()))],
                                             ["query_id", "q", "least", "trees"])

    routed = queries.select("query_id", "q", "least").mapInArrow(run, "query_id bigint, q array<bigint>, least bigint, trees array<bigint>")
    return routed.select(F.explode("trees").alias("tree"), "query_id", "q", "least")


def _searched(pages: DataFrame, routes: DataFrame, norm2: float, k: int, blocks: int) -> DataFrame:
    """The k best of every (tree, query). Queries come to a tree in ``blocks`` by the hash of their ids, each a task's group."""
    here = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    there = routes.select(F.col("tree").alias("t"), F.pmod(F.xxhash64(F.lit(8), "query_id"), F.lit(blocks)).cast("int").alias("b"), "query_id", "q", "least")

    def run(tree_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("query_id", "vec_id", "score", "computed", "avoided")}
        if tree_rows.num_rows and query_rows.num_rows:
            tree = _unpacked(tree_rows)
            vectors = _matrix(query_rows.column("q").combine_chunks())
            for q, query_id, least in zip(vectors, query_rows.column("query_id").to_pylist(), query_rows.column("least").to_pylist(), strict=True):
                best, count = Best(k, -np.inf if least is None else least), {"computed": 0, "avoided": 0}
                search_tree(tree, q, norm2, best, query_id, count)
                for s, i in best.heap:
                    for c, v in (("query_id", query_id), ("vec_id", -i), ("score", s), *count.items()):
                        out[c].append(v)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return here.groupBy("tree", "block").cogroup(there.groupBy("t", "b")).applyInArrow(run, FOUND)


def top_k(index: tuple[DataFrame, DataFrame, float], queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` highest inner products of every query (query_id, q: array<bigint>) with
    the indexed vectors but those of the query's own id; fewer if there are fewer."""
    pages, pivots, norm2 = index
    blocks = max(8, -(-queries.count() // QUERY_BLOCK))
    first = stored(_searched(pages, _routes(queries.withColumn("least", F.lit(None).cast("bigint")), pivots, norm2, home=True), norm2, k, blocks), "first")
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select("query_id", F.col("kth").alias("least"))
    rest = _searched(pages, _routes(queries.join(kth, "query_id", "left"), pivots, norm2, home=False), norm2, k, blocks)
    found = first.select("query_id", "vec_id", "score").unionByName(rest.select("query_id", "vec_id", "score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
