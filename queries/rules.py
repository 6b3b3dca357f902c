"""One query per field rule and scalar: a derived column of a whole table, row verdicts on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.base import Query, first, seed, seed_sql, table, utc
from tamis.functions import scalars
from tamis.functions.predicates import MEDIA_TYPES, register_rule
from tamis.functions.text import ZERO_TIME
from tamis.models.incident import INCIDENT
from tamis.operators.validate import codes, validate
from tamis.plans.ruleset import (
    Field, integer, optional, real, record, required, rule_set, text, texts, time,
)


def rule_query(name: str, source: str, columns: dict[str, str], field: Field, cases: list[tuple[str, str]],
               others: tuple[Field, ...] = (), casts: dict[str, str] | None = None) -> Query:
    """Row verdict of one field: its first failing rule or ''. ``cases`` are the checking conditions."""
    rules = rule_set("Row", field, *others, style="generic")

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = seed(spark, sf, source, columns)
        for c, t in (casts or {}).items():
            df = df.withColumn(c, F.expr(t))
        return validate(df, rules).select("k", "is_valid", codes("errors").alias("code"))

    sql = (f"WITH s AS ({seed_sql(source, columns)}), v AS (SELECT k, coalesce({first(cases)}, '') AS code FROM s)"
           " SELECT k, code = '' AS is_valid, code FROM v")
    return Query(name, run, sql)


def pattern_query(name: str, source: str, key: str, value: str, rule: str, passes: str) -> Query:
    """A format rule on a required text; ``passes`` is the checking condition on ``v``."""
    return rule_query(name, source, {"k": key, "v": value}, text("v", required, **{rule: True}),
                      [("v IS NULL OR v = ''", "required"), (f"NOT ({passes})", "semver" if rule == "loose_semver" else rule)])


def rx(pattern: str) -> str:
    return f"regexp_matches(v, '{pattern}')"


K, P, E, C, D, G = "o_orderkey", "p_partkey", "event_id", "c_custkey", "doc_id", "page_id"
MD5 = f"md5(cast({P} AS string))"

_types = ", ".join(f"'{t}'" for t in MEDIA_TYPES)


def basic() -> list[Query]:
    return [
        rule_query("r01_required", "orders", {"k": K, "v": "nullif(o_orderpriority, '5-LOW')"}, text("v", required),
                   [("v IS NULL", "required")]),
        rule_query("r02_omitempty", "customer", {"k": C, "v": f"CASE WHEN {C} % 3 = 0 THEN '' ELSE c_mktsegment END"},
                   text("v", optional, min=9), [("v <> '' AND length(v) < 9", "min")]),
        rule_query("r03_min", "documents", {"k": D, "v": "text"}, text("v", min=500), [("length(v) < 500", "min")]),
        rule_query("r04_max", "documents", {"k": D, "v": "text"}, text("v", max=2000), [("length(v) > 2000", "max")]),
        rule_query("r05_len", "part", {"k": P, "v": f"substr({MD5}, 1, 30 + cast({P} % 4 AS int))"}, text("v", len=32),
                   [("length(v) <> 32", "len")]),
        rule_query("r06_gt", "orders", {"k": K, "v": "o_totalprice"}, real("v", gt=200000), [("v <= 200000", "gt")]),
        rule_query("r07_gte", "customer", {"k": C, "v": "c_acctbal"}, real("v", gte=0), [("v < 0", "gte")]),
        rule_query("r08_lte", "lineitem", {"k": "l_orderkey * 10 + l_linenumber", "v": "l_quantity"}, real("v", lte=40),
                   [("v > 40", "lte")]),
        rule_query("r09_eq", "lineitem", {"k": "l_orderkey * 10 + l_linenumber", "v": "l_linenumber"}, integer("v", eq=1),
                   [("v <> 1", "eq")]),
        rule_query("r10_oneof", "events", {"k": E, "v": "event_type"}, text("v", oneof="click view purchase"),
                   [("v NOT IN ('click', 'view', 'purchase')", "oneof")]),
        rule_query("r12_required_if", "orders",
                   {"k": K, "status": "o_orderstatus", "v": f"CASE WHEN {K} % 2 = 0 THEN o_orderpriority END"},
                   text("v", required_if=[("status", "P"), ("status", "O")]),
                   [("status IN ('P', 'O') AND v IS NULL", "required_if")], others=(text("status"),)),
        rule_query("r20_boolean", "orders",
                   {"k": K, "v": f"CASE {K} % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'yes' WHEN 2 THEN '0' WHEN 3 THEN 'F' WHEN 4 THEN 'tRUE' ELSE 'False' END"},
                   text("v", boolean=True), [("v IN ('yes', 'tRUE')", "boolean")]),
    ]


def formats() -> list[Query]:
    url = (f"CASE {G} % 9 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', ':/') WHEN 2 THEN replace(replace(url, 'https://', ''), 'http://', '')"
           f" WHEN 3 THEN 'http://example.com/%zz' || {G} WHEN 4 THEN 'mailto:user' || {G} WHEN 5 THEN url || '#part'"
           f" WHEN 6 THEN 'http://exa mple.com/' || {G} WHEN 7 THEN 'http://:80/' || {G} ELSE 'http://host:port/' || {G} END")
    email = (f"CASE {C} % 8 WHEN 0 THEN lower(c_name) || '@example.com' WHEN 1 THEN c_name || '.example.com' WHEN 2 THEN 'a..b@example.com'"
             f" WHEN 3 THEN 'x@localhost' WHEN 4 THEN 'x+' || {C} || '@sub.example.org' WHEN 5 THEN 'x@example.c0' WHEN 6 THEN '.x@example.com' ELSE 'é@exämple.de' END")
    ip = (f"CASE {E} % 7 WHEN 0 THEN (user_id % 400) || '.1.2.3' WHEN 1 THEN '10.0.0.0' || (user_id % 9) WHEN 2 THEN '2001:db8::' || (user_id % 99)"
          f" WHEN 3 THEN '::' WHEN 4 THEN '1::2::' || (user_id % 9) WHEN 5 THEN '::ffff:10.0.0.' || (user_id % 300) ELSE '10.0.' || (user_id % 300) END")
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = f"{octet}[.]{octet}[.]{octet}[.]{octet}"
    host = (f"CASE s_suppkey % 6 WHEN 0 THEN lower(replace(s_name, '#', '-')) WHEN 1 THEN s_name WHEN 2 THEN 'a.b' WHEN 3 THEN 'ab..c'"
            f" WHEN 4 THEN '9host' || s_suppkey ELSE 'host' || s_suppkey || '.example.com' END")
    version = (f"CASE {P} % 9 WHEN 0 THEN p_size || '.' || ({P} % 7) || '.0' WHEN 1 THEN '0' || p_size || '.1.0' WHEN 2 THEN 'v1.' || p_size || '.0'"
               f" WHEN 3 THEN '1.0.' || p_size || '-rc.0' || ({P} % 5) WHEN 4 THEN '1.0.0-a..' || p_size WHEN 5 THEN '1.0.0+build.' || p_size"
               f" WHEN 6 THEN '1.0.0-0a.b-' || p_size WHEN 7 THEN '1.0' ELSE '2023-01-' || lpad(cast(p_size AS string), 2, '0') END")
    number = "(0|[1-9][0-9]*)"
    ident = "(0|[1-9][0-9]*|[0-9]*[a-zA-Z-][0-9a-zA-Z-]*)"
    return [
        pattern_query("r15_url", "pages", G, url, "url",
                      "contains(v, '://') AND NOT contains(v, ' ') AND NOT contains(v, '%zz') AND NOT contains(v, ':port') OR v LIKE 'mailto:%'"
                      " OR (regexp_matches(v, '^[a-z]+:/[^/]') AND contains(v, '#'))"),
        pattern_query("r16_email", "customer", C, email, "email",
                      rx("^[a-z0-9#+é]+@[a-zä]+([.][a-z]+)+$") + " AND NOT contains(v, '..')"),
        pattern_query("r17_ip", "events", E, ip, "ip",
                      rx(f"^{v4}$") + " OR " + rx("^2001:db8::[0-9]{1,4}$") + " OR v = '::' OR " + rx(f"^::ffff:{v4}$")),
        pattern_query("r18_hostname", "supplier", "s_suppkey", host, "hostname", rx("^[a-zA-Z]([a-zA-Z0-9-]+[.]?)*[a-zA-Z0-9]$")),
        pattern_query("r19_hexadecimal", "part", P, f"CASE {P} % 4 WHEN 0 THEN {MD5} WHEN 1 THEN '0X' || {MD5} WHEN 2 THEN p_name ELSE '0x' END",
                      "hexadecimal", rx("^(0[xX])?[0-9a-fA-F]+$")),
        pattern_query("r21_uuid", "part", P,
                      f"substr({MD5}, 1, 8) || '-' || substr({MD5}, 9, 4) || '-' || substr({MD5}, 13, 4) || '-' || substr({MD5}, 17, 4) || '-' ||"
                      f" CASE {P} % 3 WHEN 0 THEN substr({MD5}, 21, 12) WHEN 1 THEN upper(substr({MD5}, 21, 12)) ELSE substr({MD5}, 21, 11) END",
                      "uuid", rx("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
        pattern_query("r21_numeric", "orders", K, f"CASE {K} % 4 WHEN 0 THEN '-' || {K} || '.50' WHEN 1 THEN {K} || '.' WHEN 2 THEN '+' || {K} ELSE '1e' || {K} END",
                      "numeric", rx("^[-+]?[0-9]+([.][0-9]+)?$")),
        pattern_query("r21_alpha", "part", P, f"CASE {P} % 3 WHEN 0 THEN p_type WHEN 1 THEN p_name ELSE p_brand END", "alpha", rx("^[a-zA-Z]+$")),
        pattern_query("r21_alphanum", "part", P, f"CASE {P} % 3 WHEN 0 THEN p_type || p_size WHEN 1 THEN p_name ELSE p_brand END", "alphanum",
                      rx("^[a-zA-Z0-9]+$")),
        pattern_query("r22_semver", "part", P, version, "semver",
                      rx(f"^{number}[.]{number}[.]{number}(-{ident}([.]{ident})*)?([+][0-9a-zA-Z-]+([.][0-9a-zA-Z-]+)*)?$")),
        pattern_query("r23_deployment_semver", "part", P, version, "loose_semver",
                      rx("^[0-9]+[.][0-9]+[.][0-9]+(-[0-9A-Za-z-]+([.][0-9A-Za-z-]+)*)?([+][0-9A-Za-z-]+([.][0-9A-Za-z-]+)*)?$")),
        pattern_query("r24_deployment_name", "part", P, f"CASE {P} % 5 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN p_name WHEN 2 THEN '7' WHEN 3 THEN 'é' ELSE 'x' || {P} || '-' END",
                      "deployment_name", rx("^[a-zA-Z][a-zA-Z0-9-]*[a-zA-Z0-9]$") + " OR strlen(v) = 1"),
        pattern_query("r25_priority_level", "orders", K, f"CASE {K} % 5 WHEN 0 THEN substr(o_orderpriority, 3) WHEN 1 THEN substr(o_orderpriority, 1, 1) WHEN 2 THEN 'Normal' WHEN 3 THEN '6' ELSE lower(substr(o_orderpriority, 3)) END",
                      "priority_level", "lower(v) IN ('low', 'normal', 'high', 'urgent', 'critical', '1', '2', '3', '4', '5')"),
        pattern_query("r26_api_content_type", "events", E,
                      f"CASE {E} % 7 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/csv ; charset=' || event_type WHEN 2 THEN 'application/vnd.x+json'"
                      f" WHEN 3 THEN 'ab/' || event_type WHEN 4 THEN 'a/' || event_type WHEN 5 THEN event_type ELSE 'font/woff2;v=1' END",
                      "api_content_type", f"v IN ({_types}) OR (contains(v, ';') AND trim(split_part(v, ';', 1)) IN ({_types})) OR "
                      + rx("^[a-zA-Z][a-zA-Z0-9][a-zA-Z0-9!#$&^-]*/[a-zA-Z0-9][a-zA-Z0-9!#$&^-]*$")),
        pattern_query("r27_api_version", "part", P, version, "api_version",
                      rx("^v?[0-9]+$") + " OR " + rx("^v?[0-9]+[.][0-9]+$") + " OR " + rx("^v?[0-9]+[.][0-9]+[.][0-9]+$") + " OR "
                      + rx("^v?[0-9]+[.][0-9]+[.][0-9]+-[a-zA-Z0-9.-]+$") + " OR " + rx("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")),
        pattern_query("r28_hostname_rfc1123", "supplier", "s_suppkey", f"CASE s_suppkey % 7 WHEN 6 THEN repeat('a', 254) ELSE {host} END", "hostname_rfc1123",
                      "strlen(v) <= 253 AND " + rx("^[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?([.][a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?)*$")),
        pattern_query("r29_github_username", "customer", C,
                      f"CASE {C} % 6 WHEN 0 THEN lower(c_mktsegment) || '-' || {C} WHEN 1 THEN c_name WHEN 2 THEN '-x' || {C} WHEN 3 THEN 'a--' || {C} WHEN 4 THEN repeat('a', 40) ELSE 'u' || {C} || '-' END",
                      "github_username", "length(v) <= 39 AND " + rx("^[a-zA-Z0-9]+(-[a-zA-Z0-9]+)*$")),
        pattern_query("r30_hexcolor", "part", P, f"CASE {P} % 4 WHEN 0 THEN '#' || substr({MD5}, 1, 6) WHEN 1 THEN substr({MD5}, 1, 6) WHEN 2 THEN '#' || substr({MD5}, 1, 3) ELSE p_type END",
                      "hexcolor", rx("^#?[0-9a-fA-F]{6}$")),
    ]


def gtefield(spark: SparkSession, sf: str) -> DataFrame:
    items, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    rows = items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        "l_orderkey", "l_linenumber", F.expr(utc("o_orderdate")).alias("ordered"), F.expr(utc("l_shipdate")).alias("shipped"))
    rules = rule_set("Item", time("ordered", required), time("shipped", required, gtefield="ordered"), style="generic")
    return validate(rows, rules).groupBy("l_linenumber", "is_valid", codes("errors").alias("code")).agg(F.count("*").alias("n"))


GTEFIELD = """SELECT l_linenumber, l_shipdate >= o_orderdate AS is_valid,
  CASE WHEN l_shipdate >= o_orderdate THEN '' ELSE 'gtefield' END AS code, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"""


def dive(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(D, F.expr("split(text, ' ')").alias("words"))
    v = validate(docs, rule_set("Document", texts("words", required, each=dict(required=True, max=12)), style="generic"))
    return v.select(D, F.size("errors").cast("bigint").alias("n_errors"),
                    F.expr("coalesce(get(errors, 0).field, '')").alias("first_field"),
                    F.expr("coalesce(get(errors, 0).code, '')").alias("first_code"))


DIVE = """WITH w AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents),
b AS (SELECT doc_id, words, list_filter(range(len(words)), lambda i: words[i + 1] = '' OR length(words[i + 1]) > 12) AS bad FROM w)
SELECT doc_id, len(bad) AS n_errors,
  CASE WHEN len(bad) = 0 THEN '' ELSE 'Words[' || bad[1] || ']' END AS first_field,
  CASE WHEN len(bad) = 0 THEN '' WHEN words[bad[1] + 1] = '' THEN 'required' ELSE 'max' END AS first_code
FROM b"""


def nested(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").select(
        "o_orderkey", F.col("o_totalprice").alias("total"),
        F.when(F.col("c_custkey").isNotNull(), F.struct(
            F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_acctbal").alias("amount")).alias("balance"))).alias("customer"))
    balance = rule_set("Balance", real("amount", required, gte=0))
    buyer = rule_set("Buyer", text("segment", required, oneof="BUILDING MACHINERY HOUSEHOLD"), record("balance", balance, required))
    rules = rule_set("Order", real("total", required, lte=400000), record("customer", buyer, required), style="generic")
    v = validate(rows, rules)
    return v.select("o_orderkey", F.expr("array_join(transform(errors, e -> concat(e.path, ':', e.code)), ',')").alias("findings"))


NESTED = """SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 400000 THEN 'Order.Total:lte' END,
  CASE WHEN coalesce(c_mktsegment, '') = '' THEN 'Order.Customer.Segment:required'
    WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'Order.Customer.Segment:oneof' END,
  CASE WHEN coalesce(c_acctbal, 0) = 0 THEN 'Order.Customer.Balance.Amount:required'
    WHEN c_acctbal < 0 THEN 'Order.Customer.Balance.Amount:gte' END) AS findings
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""


def incident_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The two errors that are tested only when all fields are fine."""
    id_rule, agreement = INCIDENT.extra_errors
    df = seed(spark, sf, "orders", INCIDENT_SEED)
    sub = lambda sql: sql.replace("$", "")
    return df.select("k", F.expr(f"NOT ({sub(id_rule.when)})").alias("id_ok"), F.expr(f"NOT ({sub(agreement.when)})").alias("agrees"))


INCIDENT_SEED = {
    "k": K,
    "id": f"CASE {K} % 4 WHEN 0 THEN 'INC-20240101-' || lpad(cast({K} % 10000 AS string), 4, '0') WHEN 1 THEN 'INC-2024-001'"
          f" WHEN 2 THEN 'inc-20240101-0001' ELSE 'INC-20240101-' || {K} END",
    "severity": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END",
    "priority": f"{K} % 5 + 1",
}
INCIDENT_SQL = f"""WITH s AS ({seed_sql('orders', INCIDENT_SEED)})
SELECT k, regexp_matches(id, '^INC-[0-9]{{8}}-[0-9]{{4}}$') AS id_ok,
  CASE severity WHEN 'low' THEN priority IN (1, 2) WHEN 'medium' THEN priority IN (2, 3)
    WHEN 'high' THEN priority IN (3, 4) ELSE priority IN (4, 5) END AS agrees FROM s"""


def scalar_query(name: str, source: str, key: str, column: str, spark_sql: str, check_sql: str, out: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, source).select(F.expr(key).alias("k"), F.expr(spark_sql).alias(out))

    return Query(name, run, f"SELECT {key} AS k, {check_sql} AS {out} FROM {source}")


WORDS = ["the", "und", "les", "password"]


def scalar_queries() -> list[Query]:
    low = "lower(text)"
    first_case = " ".join(f"WHEN contains({low}, '{w}') THEN '{w}'" for w in WORDS)
    all_case = ", ".join(f"CASE WHEN contains({low}, '{w}') THEN '{w}' END" for w in WORDS)
    since = "from_utc_timestamp(cast(ts AS TIMESTAMP), current_timezone())"
    at = "timestamp_seconds(1706745600)"
    return [
        scalar_query("f01_first_contained", "documents", D, "text", scalars.first_contained(low, WORDS), f"CASE {first_case} END", "word"),
        scalar_query("f02_all_contained", "documents", D, "text", scalars.all_contained(low, WORDS), f"concat_ws(', ', {all_case})", "words"),
        scalar_query("f03_occurrences", "documents", D, "text", scalars.occurrences(low, "en"),
                     "len(string_split(lower(text), 'en')) - 1", "n"),
        scalar_query("f04_word_count", "documents", D, "text", f"cast({scalars.word_count('text')} AS BIGINT)",
                     r"len(list_filter(regexp_split_to_array(text, '[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> ''))",
                     "n"),
        scalar_query("f05_has_prefix", "pages", G, "url", scalars.has_prefix("upper(url)", "http://"), "lower(url) LIKE 'http://%'", "plain_http"),
        scalar_query("f06_media_type", "events", E, "event_type", scalars.media_type("concat(' text/', event_type, ' ; q=', props)"),
                     "trim(split_part(' text/' || event_type || ' ; q=' || props, ';', 1))", "media_type"),
        scalar_query("f07_age_hours", "events", E, "ts", f"floor({scalars.hours_between(since, at)})",
                     "CAST(floor((1706745600000000 - epoch_us(ts)) / 3600000000) AS BIGINT)", "hours"),
        # differences of more than 292 years stay at the largest value
        scalar_query("f08_seconds_between", "events", E, "ts",
                     f"cast(floor({scalars.seconds_between(f'CASE WHEN {E} % 5 = 0 THEN {ZERO_TIME} ELSE {since} END', at)}) AS BIGINT)",
                     f"CASE WHEN {E} % 5 = 0 THEN 9223372036 ELSE CAST(floor((1706745600000000 - epoch_us(ts)) / 1000000) AS BIGINT) END", "seconds"),
        scalar_query("f09_ratio", "part", P, "p_size", scalars.ratio("p_size", f"{P} % 7"),
                     f"CASE WHEN {P} % 7 <> 0 THEN p_size::double / ({P} % 7) END", "ratio"),
        scalar_query("f10_has_key", "events", E, "props", scalars.has_key("from_json(props, 'MAP<STRING, STRING>')", "k"),
                     "json_exists(props, '$.k')", "has_k"),
        scalar_query("f12_number_text", "orders", K, "o_totalprice", scalars.number_text("o_orderkey * 1000"),
                     "CASE WHEN o_orderkey = 0 THEN '0' WHEN o_orderkey < 1000 THEN (o_orderkey * 1000)::varchar ELSE"
                     " substr(o_orderkey::varchar, 1, 1) || CASE WHEN rtrim(substr(o_orderkey::varchar, 2), '0') <> '' THEN '.' ||"
                     " rtrim(substr(o_orderkey::varchar, 2), '0') ELSE '' END || 'e+' ||"
                     " lpad((length(o_orderkey::varchar) + 2)::varchar, 2, '0') END", "text"),
        scalar_query("f12_duration_text", "lineitem", "l_orderkey * 10 + l_linenumber", "l_quantity", scalars.duration_text("cast(l_quantity AS BIGINT) * 1500000000L"),
                     "CASE WHEN l_quantity < 40 THEN replace(CAST(l_quantity * 1.5 AS VARCHAR), '.0', '') || 's' ELSE '1m' ||"
                     " replace(CAST(l_quantity * 1.5 - 60 AS VARCHAR), '.0', '') || 's' END", "text"),
    ]


def custom_rule(spark: SparkSession, sf: str) -> DataFrame:
    register_rule("ends_with", "NOT endswith({value}, '{param}')")
    rules = rule_set("Part", text("p_name", required, ends_with="ring"), style="generic")
    v = validate(table(spark, sf, "part").select(P, "p_name"), rules)
    return v.select(P, "is_valid", codes("errors").alias("code"))


def all_queries() -> list[Query]:
    return [
        *basic(),
        Query("r11_gtefield", gtefield, GTEFIELD),
        Query("r13_dive", dive, DIVE),
        Query("r14_nested", nested, NESTED),
        *formats(),
        Query("r31_r32_incident_rules", incident_rules, INCIDENT_SQL),
        *scalar_queries(),
        Query("c04_custom_rule", custom_rule,
              "SELECT p_partkey, p_name LIKE '%ring' AS is_valid, CASE WHEN p_name LIKE '%ring' THEN '' ELSE 'ends_with' END AS code FROM part"),
    ]

