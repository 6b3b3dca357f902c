"""The registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import (
    chat, copies, html_text, lines, manifest, mixture, mtree, ngram_join, phrase_index, quality, resample, toxicity, url_filter,
)
from tamis.llm.tables import Query, fold, table


def op1_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").where("vec_id IS NOT NULL")
    vectors = rows.select("vec_id", mtree.whole_vectors("embedding").alias("v")).where("v IS NOT NULL")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return mtree.top_k(mtree.build(vectors), queries, 5)


OP1 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""


def op2_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.main_text(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


def op3_mixing_sources(spark: SparkSession, sf: str) -> DataFrame:
    out = mixture.mix(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.col("draws.shard").alias("in_shards"), "shards")


def op4_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    out = phrase_index.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP4 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
q AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + 9], ' '))) AS g, least(len(ws), 10) AS k FROM b WHERE len(ws) > 0),
z AS (SELECT DISTINCT k FROM q),
o AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS i, ws FROM d, z WHERE len(ws) >= k),
m AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM o),
h AS (SELECT m.doc_id, m.i, m.k, q.item_id FROM m JOIN q ON m.g = q.g AND m.k = q.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""


def op5_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.grouped(table(spark, sf, "documents"))


OP5 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.sh) AS n_shingles, m.component_id FROM s JOIN m USING (doc_id)"""


def op6_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    return chat.formatted(table(spark, sf, "conversations")).drop("place")


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = lines.dedup(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP7 = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND r.keeper <> k.doc_id AS drop_it FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop_it) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT drop_it), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    tagged = toxicity.tag(docs, toxicity.train(docs, table(spark, sf, "labels")))
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return tagged.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= 0.7).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"))


def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf, "labels"))
    scored = quality.score(docs, model)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op10_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    more = {"n_chars": F.col("n_chars").cast("decimal(20, 0)") + 1}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = manifest.audit(table(spark, sf, "documents").select(LEAF), "doc_id", "lang", LEAF, more, hit)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


_FIELDS = "concat({})".format(", ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', {c}) END" for c in ("doc_id", "source", "lang", "{n}", "text")))
# the checksum of the decimal id, bit by bit
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))))"""
OP11 = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, lang, sha256({_FIELDS.format(n='n_chars')}) AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN sha256({_FIELDS.format(n='(n_chars + 1)')}) END AS found FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
t AS (SELECT lang, 0 AS level, list(leaf ORDER BY place) AS hs FROM p GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range(0, (len(hs) + 1) // 2), lambda i: sha256(concat(hs[2 * i + 1], hs[2 * i + 2]))) FROM t WHERE len(hs) > 1),
s AS (SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS nth FROM t WHERE len(hs) = 1),
u AS (SELECT 0 AS level, list(subroot ORDER BY nth) AS hs FROM s
  UNION ALL SELECT level + 1, list_transform(range(0, (len(hs) + 1) // 2), lambda i: sha256(concat(hs[2 * i + 1], hs[2 * i + 2]))) FROM u WHERE len(hs) > 1),
r AS (SELECT hs[1] AS root FROM u WHERE len(hs) = 1),
k AS MATERIALIZED (SELECT p.doc_id, p.leaf, p.place, t.level, p.place >> t.level AS pos, t.hs[xor(p.place >> t.level, 1) + 1] AS other, subroot, nth
    FROM p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang JOIN s ON p.lang IS NOT DISTINCT FROM s.lang WHERE len(t.hs) > 1
  UNION ALL SELECT p.doc_id, p.leaf, p.place, 1000 + u.level, s.nth >> u.level, u.hs[xor(s.nth >> u.level, 1) + 1], subroot, nth
    FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN u ON len(u.hs) > 1),
w AS MATERIALIZED (SELECT doc_id, leaf, place, nth, list(struct_pack(pos := pos, other := coalesce(other, '')) ORDER BY level) AS path FROM k GROUP BY ALL),
f AS (SELECT doc_id, leaf, place, lang, coalesce(found, leaf) AS h, 1 AS i FROM p
  UNION ALL SELECT f.doc_id, f.leaf, f.place, f.lang, sha256(CASE WHEN path[i].pos % 2 = 0 THEN concat(h, path[i].other) ELSE concat(path[i].other, h) END), i + 1
    FROM f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang JOIN w ON f.doc_id IS NOT DISTINCT FROM w.doc_id AND f.place = w.place AND s.nth = w.nth WHERE i <= len(path)),
z AS (SELECT doc_id, leaf, place, lang, arg_max(h, i) AS folded_root FROM f GROUP BY ALL)
SELECT z.doc_id, z.leaf, s.subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda x: x.other), 'string_agg', ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM z CROSS JOIN r JOIN s ON z.lang IS NOT DISTINCT FROM s.lang LEFT JOIN w ON z.doc_id IS NOT DISTINCT FROM w.doc_id AND z.place = w.place AND s.nth = w.nth"""


def op12_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return copies.decide(table(spark, sf, "documents"))


OP12 = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def op13_target_resampling(spark: SparkSession, sf: str) -> DataFrame:
    out = resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# checksums byte by byte, over a table of 256 that follows from the polynomial
OP13 = r"""WITH c AS MATERIALIZED (SELECT list(list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY v) AS tab FROM range(0, 256) r(v)),
x AS MATERIALIZED (SELECT doc_id, false AS target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL SELECT NULL, true, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS MATERIALIZED (SELECT doc_id, target, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])))) AS f FROM x),
g AS (SELECT DISTINCT f, regexp_extract_all(hex(encode(f)), '..') AS bytes FROM f),
b AS MATERIALIZED (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(bytes, lambda y: CAST(concat('0x', y) AS BIGINT))),
  lambda crc, y: xor(tab[(xor(crc, y) & 255) + 1], crc >> 8))) % 10000 AS bucket FROM g, c),
n AS (SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM f JOIN b USING (f) GROUP BY bucket),
m AS (SELECT count(*) FILTER (NOT target) AS all_s, count(*) FILTER (target) AS all_t FROM f),
k AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (all_s + 10000) / ((CAST(s AS DOUBLE) + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM n, m),
w AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS total FROM f JOIN b USING (f) JOIN k USING (bucket) WHERE NOT target GROUP BY doc_id),
d AS (SELECT x.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(CAST(floor(CAST(total AS DOUBLE) / n_features) AS BIGINT), 0) AS weight,
  CAST(concat('0x', substr(sha256(concat('7:', x.doc_id)), 1, 8)) AS BIGINT) AS h FROM x LEFT JOIN w ON x.doc_id = w.doc_id WHERE NOT x.target),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS fit FROM e WHERE n_words >= 20)
SELECT e.doc_id, n_features, weight, score, CASE WHEN place <= 25 * fit // 100 THEN place END AS rank FROM e LEFT JOIN o ON e.doc_id = o.doc_id"""


def all_queries() -> list[Query]:
    return [
        Query("op1_exact_top_k", op1_exact_top_k, OP1),
        Query("op2_html_extraction", op2_html_extraction),
        Query("op3_mixing_sources", op3_mixing_sources),
        Query("op4_benchmark_decontamination", op4_benchmark_decontamination, OP4),
        Query("op5_ngram_jaccard_join", op5_ngram_jaccard_join, OP5),
        Query("op6_chat_formatting", op6_chat_formatting),
        Query("op7_line_dedup", op7_line_dedup, OP7),
        Query("op8_toxicity", op8_toxicity),
        Query("op9_quality_classifier", op9_quality_classifier),
        Query("op10_url_filters", op10_url_filters),
        Query("op11_merkle_manifest", op11_merkle_manifest, OP11),
        Query("op12_exact_dedup", op12_exact_dedup, OP12),
        Query("op13_target_resampling", op13_target_resampling, OP13),
    ]
