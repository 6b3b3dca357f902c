"""Vectors, phrases, near duplicates: against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamis.llm import mtree, ngram_join, phrase_index
from tamis.llm.components import components

VECTORS = "vec_id bigint, embedding array<float>, extra string"


def top(spark, rows, k=5, every=1):
    df = spark.createDataFrame(rows, VECTORS)
    v = df.where("vec_id IS NOT NULL").select("vec_id", mtree.whole_vectors("embedding").alias("v")).where("v IS NOT NULL")
    q = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return mtree.top_k(mtree.build(v, tree_size=64, page=8), q, k)


def test_top_k_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    x[100:180] = x[100]  # many equal vectors
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    rows += [(None, [0.0] * 6, ""), (1000, None, ""), (1001, [None] + [0.0] * 5, ""), (1002, [float("nan")] * 6, ""), (1003, [float("inf")] * 6, ""), (1004, [1.0], "")]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top(spark, rows, every=10).collect()}
    whole = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 300, 10):
        order = sorted((-int(whole[q] @ whole[i]), i) for i in range(300) if i != q)[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -s) for s, i in order]
    assert len(got) == 150


def test_top_k_small_tables(spark):
    assert top(spark, []).collect() == []
    assert top(spark, [(1, [1.0, 2.0], "")]).collect() == []
    got = top(spark, [(1, [1.0, 0.0], ""), (2, [0.5, 0.5], ""), (1, [0.0, 1.0], "")]).collect()
    assert {r["vec_id"] for r in got if r["query_id"] == 2} == {1}


def test_top_k_of_every_length(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=int(n)).tolist(), "e") for i, n in enumerate(rng.choice([6, 7, 9], 400, p=[0.6, 0.3, 0.1]))]
    rows += [(1000 + n, rng.normal(size=n).tolist(), "e") for n in range(10, 22)]  # more lengths than share the pivots, one vector of each
    rows += [(2000, [], "e"), (2001, [], "e"), (3000, rng.normal(size=30).tolist(), "e"), (3001, rng.normal(size=30).tolist(), "e")]
    got = {}
    for r in top(spark, rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(np.float64)).astype(np.int64) for i, v, _ in rows}
    for q, x in whole.items():
        best = sorted((-int(x @ y), i) for i, y in whole.items() if i != q and len(y) == len(x))[:5]
        assert sorted(got.get(q, [])) == [(r + 1, i, -s) for r, (s, i) in enumerate(best)]


def test_queries_of_a_tree_come_in_blocks(spark):
    # ids are multiples of 50: their hashes fill all blocks alike
    n = spark.range(0, 50 * 40_000, 50).select(F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(10)).alias("b")).groupBy("b").count().collect()
    assert len(n) == 10 and max(r["count"] for r in n) < 1.1 * mtree.QUERY_BLOCK


def test_search_avoids_computations():
    rng = np.random.default_rng(2)
    x = np.rint(np.repeat(rng.normal(size=(20, 4)) * 500, 100, axis=0) + rng.normal(size=(2000, 4)) * 5)
    norm2 = float((x**2).sum(axis=1).max())
    pages = mtree.build_tree(np.arange(2000), mtree.raised(x, norm2), 32)
    tree = [dict(p, leaf=not p["children"]) for p in pages]
    for p in tree:  # covering radii and parent distances hold
        for child, r, v in zip(p["children"], p["radii"], p["vectors"], strict=False):
            assert mtree.distances(tree[child]["vectors"], v).max() <= r + 1e-6
            assert np.allclose(tree[child]["parent_distances"], mtree.distances(tree[child]["vectors"], v))
    count, best = {"computed": 0, "avoided": 0}, mtree.Best(5, -np.inf)
    mtree.search_tree(tree, x[7], norm2, best, 7, count)
    want = sorted(((int(x[7] @ x[i]), -i) for i in range(2000) if i != 7), reverse=True)[:5]
    assert sorted(best.heap, reverse=True) == want
    assert count["computed"] < 1000 < count["computed"] + count["avoided"] + 1000


DOCS = "doc_id bigint, text string, n int, kind string, segment string, a string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "k", "s", "a") for i, t in texts], DOCS)


def shingles(t):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in (t or "")))
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def expected_groups(texts):
    sets = [(i, shingles(t)) for i, t in texts]
    root = {i: i for i, _ in texts if i is not None}
    changed = True
    while changed:
        changed = False
        for x, a in sets:
            for y, b in sets:
                if x is not None and y is not None and a and b and 100 * len(a & b) >= 90 * len(a | b) and root[x] != root[y]:
                    root[x] = root[y] = min(root[x], root[y])
                    changed = True
    return root


def test_ngram_join(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    passage = " ".join(words[:60])
    for i in range(150):
        base = list(rng.choice(words, size=int(rng.integers(1, 120))))
        texts.append((i, " ".join(base)))
        if i % 7 == 0:
            texts.append((1000 + i, "  " + " ".join(base).upper() + "\n"))  # an exact copy but for case and blanks
        if i % 5 == 0:
            for j in range(6):  # a chain of near copies
                base[int(rng.integers(len(base)))] = "x"
                texts.append((2000 + 10 * i + j, " ".join(base)))
        if i % 3 == 0:
            texts.append((5000 + i, passage + " " + " ".join(base[:10])))
    texts += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "one"), (9004, "ONE"), (9005, "one two"), (9006, "ünïcode ÄÖ x y"), (9007, "ünïcode ÄÖ X y"),
              (9008, "ünïcode äö X y"), (None, "one"), (None, None), (9010, "long " * 50_000)]
    got = ngram_join.grouped(docs(spark, texts)).collect()
    want = expected_groups(texts)
    assert len(got) == len(texts)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    sizes = {i: len(shingles(t)) for i, t in texts}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]


def test_ngram_join_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(120):
        mine = list(base)
        mine[i] = "changed"
        texts.append((i, " ".join(mine)))
    got = ngram_join.grouped(docs(spark, texts)).collect()
    assert {r["component_id"] for r in got} == {0}
    members, links = ngram_join.join(docs(spark, texts))
    assert links.count() < 120 * 12  # far from all pairs


def test_repeated_rows_and_empty(spark):
    texts = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "x y z")]
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.grouped(docs(spark, texts)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3)]
    assert ngram_join.grouped(docs(spark, [])).collect() == []
    kept = ngram_join.without_copies(docs(spark, texts + [(None, "a b c d e")]))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 1, 3] and kept.columns == DOCS.replace(",", "").split()[::2]


def test_sketch_never_overstates():
    rng = np.random.default_rng(4)
    for n, m in ((10, 3000), (700, 690), (5000, 100), (1, 1)):
        a, b = (np.unique(rng.integers(0, 2**63, size=k, dtype=np.uint64)) for k in (n, m))
        b = np.unique(np.concatenate([b, a[: n // 2]]))
        x, y = (np.frombuffer(ngram_join.parity_sketch(s), dtype=np.uint8)[None] for s in (a, b))
        assert ngram_join.differing_bits(x, y)[0] <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100)]])
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = {x: x for e in links for x in e}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


ITEMS = "item_id bigint, text string, term string"


def contaminated(spark, texts, items):
    bench = spark.createDataFrame([(i, t, "t") for i, t in items], ITEMS)
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in phrase_index.decontaminate(docs(spark, texts), bench).collect()}


def test_decontamination(spark):
    import re
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(40)] + ["ÄÖ", "é1"]
    pick = lambda n: list(rng.choice(words, size=n))
    items = [(i, " ".join(pick(int(rng.integers(1, 25))))) for i in range(30)] + [(40, None), (41, ""), (42, "!!"), (43, "t1"), (44, "t1 t2 t3"), (1, "t5 t6")]
    long_ones = [t for _, t in items if t and len(t.split()) >= 10]
    texts = [(i, ", ".join(pick(20)) + ". " + long_ones[i % len(long_ones)].upper() + "; " + " ".join(pick(5))) for i in range(40)]
    texts += [(100, None), (101, ""), (102, "..."), (103, "T1"), (104, ("t1 " * 30_000) + long_ones[0]), (105, "nothing here")]
    got = contaminated(spark, texts, items)

    def tokens(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    for i, t in texts:
        w = tokens(t)
        if i == 104:
            assert got[i][0] == len(w)
            continue
        hit, found = set(), set()
        for item, s in items:
            v = tokens(s)
            for k in {min(len(v), 10)} - {0}:
                for a in range(len(v) - k + 1):
                    for p in range(len(w) - k + 1):
                        if w[p:p + k] == v[a:a + k]:
                            hit.update(range(p, p + k))
                            found.add(str(item))
        assert got[i] == (len(w), len(hit), sorted(found)), i
    assert len(got) == len(texts)


def test_decontamination_of_nothing(spark):
    assert contaminated(spark, [], [(1, "a b")]) == {}
    assert contaminated(spark, [(1, "a b")], []) == {1: (2, 0, [])}
    assert contaminated(spark, [(1, "a b"), (1, "b a"), (None, "a b c")], [(7, "a b")]) == {1: (4, 2, ["7"]), None: (3, 2, ["7"])}


def test_proximity(spark):
    index = phrase_index.build(docs(spark, [(1, "red x fox y z dog red"), (2, "dog fox red"), (3, "red red dog fox"), (4, "fox")]))
    query = spark.createDataFrame([("q", ["red", "fox", "dog"]), ("r", ["red", "red", "fox"])], "query_id string, terms array<string>")

    def found(within):
        return sorted((r["query_id"], r["doc_id"], r["start"]) for r in phrase_index.search(index, query, within).collect())

    assert found(3) == [("q", 2, 0), ("q", 3, 1)]
    assert found(4) == [("q", 2, 0), ("q", 3, 0), ("q", 3, 1), ("r", 3, 0)]
    assert ("q", 1, 0) in found(6) and ("q", 1, 2) in found(6)
    assert sorted((r["query_id"], r["doc_id"], r["start"]) for r in phrase_index.search(index, query).collect()) == []


def test_words_of_bytes():
    from tamis.llm.textbytes import ALNUM, NOT_SPACE, Words, by_bytes
    w = Words(pa.array(["A b", None, "", "é-é", "  x"]), ALNUM)
    assert [w.vocabulary[c].as_py() for c in w.codes] == ["a", "b", "é", "é", "x"] and w.counts.tolist() == [2, 0, 0, 2, 1]
    assert Words(pa.array(["ab", "cd"]).slice(1), NOT_SPACE).vocabulary.to_pylist() == ["cd"]
    assert len(Words(pa.array([], pa.string()), ALNUM)) == 0
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 10, "c"]})
    assert [b.num_rows for b in by_bytes(batch, "text", 12)] == [2, 2]
