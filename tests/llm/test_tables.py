"""Manifests, exact dedup and resampling: against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis.llm import copies, manifest, queries, resample
from tamis.llm.ranks import numbered, placed
from tamis.llm.textbytes import ALNUM, Words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, place string, n int, digest string, keep string, rank int"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source, n_chars) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "p", 2, "d", "k", 3) for r in rows], DOCS)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# -- places ----------------------------------------------------------------------------------------
def test_places_of_hot_groups_nulls_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 7}", int(rng.integers(0, 5)) if i % 5 else None) for i in range(3000)]
    df = numbered(spark.createDataFrame(rows, "g string, v int").repartition(6), "t")
    got = placed(df, ["g"], [F.col("v").asc_nulls_first()], "p").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r)
    assert {g: len(x) for g, x in by.items()} == Counter(g for g, _ in rows)
    for g, x in by.items():
        x.sort(key=lambda r: r.place)
        assert [r.place for r in x] == list(range(len(x))) and {r.n for r in x} == {len(x)}
        keys = [(r.v is not None, r.v or 0, r.row) for r in x]
        assert keys == sorted(keys)
    assert placed(numbered(df.drop("row").limit(0), "t"), ["g"], [F.col("v").asc()], "p").collect() == []


# -- manifest --------------------------------------------------------------------------------------
def piece(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*(piece(v) for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def path(tree, i, fan):
    out = []
    for level in tree[:-1]:
        first = i // fan * fan
        out.append(("".join(level[first:i]), "".join(level[i + 1:first + fan])))
        i //= fan
    return out


def expected_audit(rows, fan):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[g] = levels([leaf(*r) for r in groups[g]], fan)
    top = levels([trees[g][-1][0] for g in order], fan)
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            proof = path(trees[g], i, fan) + path(top, k, fan)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf(r[0], r[1], r[2], r[3], None if r[4] is None else r[4] + 1) if hit else leaf(*r)
            for a, b in proof:
                now = sha(a, now, b)
            out.append((r[0], leaf(*r), trees[g][-1][0], top[-1][0], "".join(a + b for a, b in proof), now, now == top[-1][0]))
    return out


def audited(df, shape):
    more = {"n_chars": F.col("n_chars").cast("decimal(20, 0)") + 1}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = manifest.audit(df, "doc_id", "lang", queries.LEAF, more, hit, shape)
    return [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()]


def key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("fan,depth", [(2, 1), (2, 3), (3, 2), (5, 1)])
def test_manifest(spark, fan, depth):
    rows = [(i, f"text {i} é\x00 " * (i % 3), ["en", "en", "de", None][i % 4], None if i % 5 == 0 else "s", None if i % 6 == 0 else i) for i in range(70)]
    rows += [(7, "other", "en", "s", 1), (7, "other", "en", "s", 1), (None, None, None, None, None), (None, "x", "ü", "s", 2**63 - 1), (5, "alone", "", "s", 0)]
    rows += [(200, "long " * 40_000, "zz", "s", 5)]
    got = audited(docs(spark, rows), manifest.Shape(fan, depth))
    assert sorted(got, key=key) == sorted(expected_audit(rows, fan), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9])
def test_manifest_small_tables(spark, n):
    rows = [(i, "t", "en" if n < 9 else f"l{i}", "s", 1) for i in range(n)]
    got = audited(docs(spark, rows), manifest.Shape(2, 2))
    assert sorted(got, key=key) == sorted(expected_audit(rows, 2), key=key)


def test_manifest_of_nothing_and_roots(spark):
    assert audited(docs(spark, []), manifest.Shape()) == []
    leaves = spark.createDataFrame([("a", i, sha(str(i)), "x") for i in range(5)] + [(None, 1, sha("n"), "x")], "grp string, key int, hash string, item string")
    m = manifest.build(leaves, manifest.Shape(2, 1))
    tree = levels([sha(str(i)) for i in range(5)], 2)
    assert {(r.grp, r.subroot, r.n) for r in m.subroots().collect()} == {("a", tree[-1][0], 5), (None, sha("n"), 1)}
    assert m.root() == sha(sha("n"), tree[-1][0])
    assert manifest.build(leaves.limit(0)).root() is None


def test_manifest_blocks_stay_small(spark):
    leaves = spark.range(5000).selectExpr("'hot' AS grp", "id AS key", "sha2(cast(id AS string), 256) AS hash", "id AS item")
    m = manifest.build(leaves, manifest.Shape(2, 6))
    assert m.rows[0].agg(F.max(F.size("items"))).first()[0] == 64 and m.rows[0].count() == 79
    assert [r.count() for r in m.rows] == [79, 2, 1]


# -- exact dedup -----------------------------------------------------------------------------------
def expected_copies(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1] or "", []).append(r[0])
    return sorted(((i, max((x for x in ids if x is not None), default=None), len(ids), sha(t)) for t, ids in by.items() for i in ids), key=key)


@pytest.mark.parametrize("counters", [1, 3, 4096])
def test_exact_dedup(spark, counters):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 90}", "en", "s", 1) for i in range(600)]
    rows += [(1000, None, "en", "s", 1), (1001, "", "en", "s", 1), (None, "", "en", "s", 1), (None, "only", "en", "s", 1), (None, "only", "en", "s", 1)]
    rows += [(2000, "same id", "en", "s", 1)] * 3 + [(2001, "Hot", "en", "s", 1), (2002, "hot ", "en", "s", 1), (2003, "x" * 300_000, "en", "s", 1)]
    df = docs(spark, rows).repartition(5)
    got = copies.decide(df, counters).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == expected_copies(rows)
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted({sha(t or "") for _, t, *_ in rows})  # one row of each text
    assert all(r.doc_id == r.keep_id for r in kept)
    whole = copies.without_copies(df, counters)
    assert whole.columns == df.columns
    assert sorted(key((r.doc_id, sha(r.text or ""))) for r in whole.collect()) == sorted(key((r.doc_id, r.text_sha256)) for r in kept)


def test_exact_dedup_of_nothing(spark):
    assert copies.decide(docs(spark, [])).collect() == [] and copies.without_copies(docs(spark, [])).collect() == []


@given(st.lists(st.lists(st.integers(0, 30), max_size=60), max_size=8), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_summaries_find_what_is_frequent(batches, size):
    summary = copies.Summary(size)
    for batch in batches:
        c = Counter(batch)
        summary.add([bytes([v]) for v in c], list(c.values()))
    every = Counter(v for b in batches for v in b)
    assert len(summary.counts) <= size
    for v, n in every.items():
        assert n - sum(every.values()) / (size + 1) <= summary.counts.get(bytes([v]), 0) <= n


def test_frequent_texts_are_not_shuffled(spark):
    rows = [(i, "hot" if i % 2 else f"t{i}", "en", "s", 1) for i in range(2000)]
    stored_rows = numbered(docs(spark, rows).select(F.col("doc_id").alias("id"), copies.text_digest(F.col("text")).alias("digest")), "t")
    parts = copies.split(stored_rows, 50)
    assert [r.group_size for r in parts.winners.collect()] == [1000]
    assert parts.rest.count() == 1000 and parts.decided().count() == 2000
    assert copies.split(stored_rows, 4096).winners.count() <= 4096


# -- resampling ------------------------------------------------------------------------------------
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs_of(text, most=2):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return [" ".join(words[i:i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)], len(words)


def expected_resample(rows, target, percent=25, min_words=20, buckets=10_000, most=2):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = Counter(), Counter()
    for r in rows:
        s.update(map(bucket, runs_of(r[1], most)[0]))
    for text in target:
        t.update(map(bucket, runs_of(text, most)[0]))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for r in rows:
        found, n_words = runs_of(r[1], most)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(sha("7:" + ("" if r[0] is None else str(r[0])))[:8], 16)
        out.append([r[0], n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(fit[:percent * len(fit) // 100])}
    return [(*r, drawn.get(id(r))) for r in out]


def test_resample(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ÜBER", "日本語", "A1b2", "x" * 3000]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))), "en", "s", 1) for i in range(300)]
    rows += [(None, "null id " * 30, "en", "s", 1), (900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "?!\n", "en", "s", 1), (903, "one", "en", "s", 1)]
    rows += [(904, "same " * 25, "en", "s", 1)] * 4 + [(905, "long word " * 50_000, "en", "s", 1)]
    target = ["w1 w2 w3 W4", None, "", "été w5 w5 w5", "日本語 a1B2"]
    df, goal = docs(spark, rows).repartition(4), spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(df, goal)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(key, got.collect())) == sorted(map(key, expected_resample(rows, target)))
    three = resample.resample(df, goal, percent=60, min_words=3, runs=3, buckets=97)
    assert sorted(map(key, three.collect())) == sorted(map(key, expected_resample(rows, target, 60, 3, 97, 3)))


def test_resample_without_documents_or_target(spark):
    rows = [(i, f"word{i} " * 25, "en", "s", 1) for i in range(8)]
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs(spark, []), none).collect() == []
    assert sorted(map(key, resample.resample(docs(spark, rows), none).collect())) == sorted(map(key, expected_resample(rows, [])))


@given(st.lists(st.text(max_size=40), max_size=30))
@settings(max_examples=100, deadline=None)
def test_checksums(texts):
    got = resample.crc32_rows(pa.array(texts, pa.string()))
    assert got.tolist() == [zlib.crc32(t.encode()) for t in texts]
    sliced = pa.array(["zz", *texts], pa.string()).slice(1)
    assert resample.crc32_rows(sliced).tolist() == got.tolist()


def test_features_lie_in_one_text():
    words = Words(pa.array(["a b", None, "c", "", "b a b a"]), ALNUM)
    ones, twos = resample.features(words, 2, 10_000)
    assert ones[0].tolist() == list(range(7)) and twos[0].tolist() == [0, 3, 4, 5]
    assert twos[1].tolist() == [zlib.crc32(f.encode()) % 10_000 for f in ("a b", "b a", "a b", "b a")]
