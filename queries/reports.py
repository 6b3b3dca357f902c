"""Queries for reports, gates, row assembly, decoding, routing and batch sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.base import AS_OF, Query, seed, seed_sql, table, utc
from queries.models import DEPLOYMENT, GENERIC, INCIDENT
from tamis.functions.predicates import register_rule
from tamis.models import CATALOG
from tamis.models.api import SCHEMA
from tamis.models.github import TEAM
from tamis.operators import ledger
from tamis.operators import report as rep
from tamis.operators import sessions as ses
from tamis.operators.quarantine import bad_rows, good_rows, write_split
from tamis.operators.routing import route, unknown_types
from tamis.operators import waves
from tamis.operators.validate import codes, validate
from tamis.plans.ruleset import Check, RuleSet, integer, real, record, records, required, rule_set, text, text_map, texts
from tamis.sources.decode import decode
from tamis.sources.records import (
    explode_array, read_requests, record_identifier, request_records, typed_identifier, with_row_index,
)
from tamis.streaming.continuous import work_folder

K = "o_orderkey"
register_rule("short_priority", "NOT ({value} RLIKE '^[1-3]-[A-Z]+\\\\z')")


def order_rules(style: str = "generic") -> RuleSet:
    return rule_set(
        "Order",
        text("o_orderstatus", required, oneof="O F"),
        real("o_totalprice", required, gt=1000, lte=300000),
        text("o_orderpriority", required, short_priority=True),
        checks=[
            Check("BIG_ORDER", "$o_totalprice > 200000", "Total", "Total of {$o_totalprice}", "$o_totalprice", "Look twice", "size"),
            Check("URGENT_FINISHED", "$o_orderstatus = 'F' AND $o_orderpriority = '1-URGENT'", "Status", "Done"),
        ],
        title="OrderValidator", model_type="order", provider="order_validator", style=style,
    )


def orders(spark: SparkSession, sf: str, style: str = "generic") -> DataFrame:
    df = table(spark, sf, "orders").select(K, "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
    return validate(df, order_rules(style))


V = """WITH e AS (SELECT *,
    CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'oneof' END AS e1,
    CASE WHEN o_totalprice <= 1000 THEN 'gt' WHEN o_totalprice > 300000 THEN 'lte' END AS e2,
    CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-3]-[A-Z]+$') THEN 'short_priority' END AS e3 FROM orders),
f AS (SELECT *, concat_ws(',', e1, e2, e3) AS error_codes,
    (e1 IS NOT NULL)::int + (e2 IS NOT NULL)::int + (e3 IS NOT NULL)::int AS n_errors FROM e),
w AS (SELECT *, error_codes = '' AS is_valid,
    CASE WHEN error_codes = '' AND o_totalprice > 200000 THEN 'BIG_ORDER' END AS w1,
    CASE WHEN error_codes = '' AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'URGENT_FINISHED' END AS w2 FROM f),
v AS (SELECT *, concat_ws(',', w1, w2) AS warning_codes, (w1 IS NOT NULL)::int + (w2 IS NOT NULL)::int AS n_warnings,
    'OrderValidator' || coalesce(':' || coalesce(e1, e2, e3, w1, w2), '') AS test_name FROM w)
"""
COUNTS = """count(*) AS total_records, count(*) FILTER (is_valid) AS valid_records, count(*) FILTER (NOT is_valid) AS invalid_records,
  count(*) FILTER (is_valid AND n_warnings > 0) AS warning_records, coalesce(sum(n_errors), 0)::bigint AS validation_errors,
  coalesce(sum(n_warnings), 0)::bigint AS validation_warnings"""
RATE = "CASE WHEN total_records = 0 THEN 0.0 ELSE valid_records / total_records * 100.0 END"
NAMES = """coalesce(array_to_string(list_sort(list(DISTINCT test_name) FILTER (is_valid)), ','), '') AS successful_test_names,
  coalesce(array_to_string(list_sort(list(DISTINCT test_name) FILTER (NOT is_valid)), ','), '') AS failed_test_names,
  count(DISTINCT test_name) AS total_tests_ran"""
NUMBERS = ["total_records", "valid_records", "invalid_records", "warning_records", "validation_errors", "validation_warnings"]


def flat(report: DataFrame, *keep: str) -> DataFrame:
    return report.select(*keep, *NUMBERS, "success_rate", F.array_join("successful_test_names", ",").alias("successful_test_names"),
                         F.array_join("failed_test_names", ",").alias("failed_test_names"), "total_tests_ran")


def row_results(spark, sf):
    return orders(spark, sf).select(K, "is_valid", codes("errors").alias("error_codes"), codes("warnings").alias("warning_codes"), "test_name")


def detail(spark, sf):
    return rep.flatten_findings(orders(spark, sf), "errors", [K]).select(
        K, "field", "message", "code", F.expr("if(field = 'OTotalprice', '', value)").alias("value"), "expected", "constraint", "path", "severity")


DETAIL = V + """, x AS (
SELECT o_orderkey, 'OOrderstatus' AS field, 'must be one of: O F' AS m, 'oneof' AS code, o_orderstatus AS value, 'O F' AS expected FROM v WHERE e1 IS NOT NULL
UNION ALL SELECT o_orderkey, 'OTotalprice', CASE e2 WHEN 'gt' THEN 'must be greater than 1000' ELSE 'must be less than or equal to 300000' END,
  e2, '', CASE e2 WHEN 'gt' THEN '1000' ELSE '300000' END FROM v WHERE e2 IS NOT NULL
UNION ALL SELECT o_orderkey, 'OOrderpriority', 'failed validation: short_priority', e3, o_orderpriority, '' FROM v WHERE e3 IS NOT NULL)
SELECT o_orderkey, field, 'Field ''' || field || ''' ' || m AS message, code, value, expected, code AS "constraint", 'Order.' || field AS path, 'error' AS severity FROM x"""


def styles(spark, sf):
    parts = [orders(spark, sf, s).select(F.lit(s).alias("style"), K, codes("errors").alias("error_codes"))
             for s in ("base", "incident", "api")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


STYLES = V + """SELECT 'base' AS style, o_orderkey, concat_ws(',', CASE WHEN e1 IS NOT NULL THEN 'INVALID_ENUM_VALUE' END,
  CASE WHEN e2 IS NOT NULL THEN 'VALIDATION_FAILED' END, CASE WHEN e3 IS NOT NULL THEN 'VALIDATION_FAILED' END) AS error_codes FROM v
UNION ALL SELECT 'incident', o_orderkey, concat_ws(',', CASE WHEN e1 IS NOT NULL THEN 'VALIDATION_FAILED' END,
  CASE WHEN e2 IS NOT NULL THEN 'VALIDATION_FAILED' END, CASE WHEN e3 IS NOT NULL THEN 'VALIDATION_FAILED' END) FROM v
UNION ALL SELECT 'api', o_orderkey, error_codes FROM v"""


def labels(spark, sf):
    df = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice", "o_orderpriority")
    v = validate(df, order_rules(), labels=True)
    return v.groupBy("model_type", "provider", "is_valid").agg(F.count("*").alias("n"))


def with_threshold(threshold: float | None):
    def run(spark, sf):
        return rep.report(orders(spark, sf), threshold).select("total_records", "success_rate", "status")

    return run


def threshold_sql(threshold: float | None) -> str:
    test = f"success_rate < {threshold}" if threshold is not None else "total_records = 1 AND valid_records = 0"
    return V + (f", c AS (SELECT {COUNTS} FROM v), r AS (SELECT *, {RATE} AS success_rate FROM c)"
                f" SELECT total_records, success_rate, CASE WHEN {test} THEN 'failed' ELSE 'success' END AS status FROM r")


def lone_gate(spark, sf):
    """One report per order: the gate without threshold fails exactly the lone invalid records."""
    return rep.report(orders(spark, sf), None, [K]).select(K, "success_rate", "status")


def gate_per_customer(spark, sf):
    """A threshold per row; 57 of 100 with threshold 57 fails because of the division's last bit."""
    r = rep.summarize(orders(spark, sf), ["o_custkey"]).withColumn("threshold", F.expr("cast(o_custkey % 101 AS DOUBLE)"))
    return r.select("o_custkey", "success_rate", rep.gate("threshold").alias("status"))


def last_bit(spark, sf):
    """Every supplier as a batch of 100 records, of which its key says how many are valid."""
    pairs = table(spark, sf, "supplier").selectExpr("s_suppkey", "100 AS total_records", "1 + s_suppkey % 100 AS valid_records")
    out = pairs.withColumn("success_rate", rep.success_rate()).withColumn("invalid_records", F.expr("total_records - valid_records"))
    return out.select("s_suppkey", "success_rate", rep.gate(F.col("valid_records").cast("double")).alias("status"))


def split_counts(spark, sf):
    folder = work_folder(spark, "split")
    written = write_split(orders(spark, sf), f"{folder}/rows")
    good = good_rows(written).select(F.lit("good").alias("side"), K)
    bad = bad_rows(written).select(F.lit("bad").alias("side"), K)
    return good.unionByName(bad)


def quarantine(spark, sf):
    return bad_rows(orders(spark, sf)).select(K, codes("errors").alias("error_codes"))


def bad_or_warned(spark, sf):
    return bad_rows(orders(spark, sf), include_warnings=True).select(K, "test_name")


def slow_rows(spark, sf):
    df = orders(spark, sf).withColumn("took", F.expr(f"cast({K} % 205 AS DOUBLE)"))
    return rep.flag_slow(df, "took").select(K, "is_slow", F.size("warnings").cast("bigint").alias("n_warnings"))


REQUEST = "o_custkey % 97"


def batch_response(spark, sf):
    return rep.batch_response(orders(spark, sf).withColumn("request", F.expr(REQUEST)), "request")


def rollup(spark, sf):
    v = orders(spark, sf).withColumn("year", F.year("o_orderdate"))
    return rep.rollup(v, "year", "o_orderstatus").select(F.col("year").cast("bigint").alias("year"), "o_orderstatus", *NUMBERS, "success_rate", "grouping_level")


def cube(spark, sf):
    return rep.rollup(orders(spark, sf), "o_orderstatus", "o_orderpriority", cube=True).select(
        "o_orderstatus", "o_orderpriority", "total_records", "success_rate", "grouping_level")


def by_field(spark, sf):
    return rep.by_field(orders(spark, sf))


def daily(spark, sf):
    v = orders(spark, sf).withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return rep.counts(v, ["day"]).withColumn("success_rate", rep.success_rate())


def kept_parts(spark, sf):
    """Partial reports of the orders by year: some years, then those that are missing, then some once more."""
    folder = work_folder(spark, "ledger")
    v = orders(spark, sf).withColumn("year", F.year("o_orderdate").cast("string"))
    ledger.add(v.where("year % 3 = 0"), folder, "year", ("o_orderstatus",))
    ledger.add_missing(v, folder, "year", ("o_orderstatus",))
    ledger.add(v.where("year % 2 = 0"), folder, "year", ("o_orderstatus",))
    return ledger.read(spark, folder)


def incremental_report(spark, sf):
    return flat(ledger.report_of(kept_parts(spark, sf), 80.0), "status")


def incremental_codes(spark, sf):
    kept = kept_parts(spark, sf)
    return ledger.codes_of(kept, "errors", ("part",)).unionByName(ledger.codes_of(kept, "warnings", ("part",))).withColumnRenamed("part", "year")


def incremental_rollup(spark, sf):
    out = ledger.rollup_of(kept_parts(spark, sf), "part", "o_orderstatus")
    return out.select(F.col("part").cast("bigint").alias("year"), "o_orderstatus", *NUMBERS, "success_rate", "grouping_level")


def fail_fast_orders(spark, sf):
    """The first three invalid orders, looked for in growing waves of files, of which there is one for each year."""
    folder = work_folder(spark, "waves")
    by_year = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    by_year.repartition("year").write.partitionBy("year").parquet(folder)
    files = sorted(spark.read.parquet(folder).inputFiles())
    return waves.fail_fast(spark, files, lambda df: validate(df, order_rules()), K, budget=3).failures.select(K, "test_name")


def code_map(spark, sf):
    m = rep.by_code_map(orders(spark, sf))
    return m.select(F.expr("array_join(transform(map_entries(errors_by_code), e -> concat(e.key, '=', e.value)), ',')").alias("errors_by_code"))


# ---- decoding ------------------------------------------------------------------------------------
E = "event_id"
_JSON = (
    f"CASE {E} % 12 WHEN 0 THEN '{{\"id\": ' || {E} || '}}' WHEN 1 THEN '{{\"title\": true}}' WHEN 2 THEN '{{\"priority\": \"' || {E} || '\"}}'"
    f" WHEN 3 THEN '{{\"priority\": ' || {E} || '.5}}' WHEN 4 THEN '{{\"reported_at\": \"2024-01-02 10:00:00\"}}'"
    f" WHEN 5 THEN '{{\"reported_at\": \"2024-01-02T10:00:00Z\", \"tags\": [\"a\", null]}}' WHEN 6 THEN '{{\"tags\": [\"a\", ' || {E} || ']}}'"
    f" WHEN 7 THEN '[' || props || ']' WHEN 8 THEN '{{broken ' || {E} WHEN 9 THEN props WHEN 10 THEN '{{\"id\": null, \"uuid\": \"u' || {E} || '\"}}'"
    f" ELSE '{{\"id\": \"' || event_type || '\", \"priority\": ' || ({E} % 7) || '}}' END"
)
JSON_SEED = {"k": E, "value": _JSON, "event_type": "event_type"}


def strict(spark, sf):
    d = decode(seed(spark, sf, "events", JSON_SEED), CATALOG["incident"])
    return d.select("k", "undecodable", "record.id", "record.priority", F.expr("unix_seconds(record.reported_at)").alias("reported"),
                    F.size("record.tags").cast("bigint").alias("n_tags"))


STRICT = f"""WITH s AS ({seed_sql('events', JSON_SEED)})
SELECT k, k % 12 IN (0, 1, 2, 3, 4, 6, 7, 8) AS undecodable, CASE WHEN k % 12 = 11 THEN event_type END AS id,
  CASE WHEN k % 12 = 11 THEN k % 7 END AS priority, CASE WHEN k % 12 = 5 THEN 1704189600::bigint END AS reported,
  CASE WHEN k % 12 = 5 THEN 2::bigint END AS n_tags FROM s"""


def lenient(spark, sf):
    d = decode(seed(spark, sf, "events", JSON_SEED), CATALOG["incident"], mode="lenient")
    return d.select("k", "undecodable", "record.id", "record.title", "record.priority",
                    F.array_join("record.tags", "|").alias("tags"))


LENIENT = f"""WITH s AS ({seed_sql('events', JSON_SEED)})
SELECT k, k % 12 IN (4, 7, 8) AS undecodable,
  CASE k % 12 WHEN 0 THEN CASE WHEN k < 1000000 THEN k::varchar END WHEN 11 THEN event_type END AS id,
  CASE WHEN k % 12 = 1 THEN 'true' END AS title,
  CASE WHEN k % 12 IN (2, 3) THEN k WHEN k % 12 = 11 THEN k % 7 END AS priority,
  CASE k % 12 WHEN 5 THEN 'a|' WHEN 6 THEN 'a|' || k END AS tags FROM s"""


def decode_failures(spark, sf):
    d = decode(seed(spark, sf, "events", JSON_SEED), CATALOG["incident"])
    v = validate(d, CATALOG["incident"], as_of=AS_OF, root="record", undecodable="undecodable")
    return v.filter("undecodable").select("k", "is_valid", codes("errors").alias("error_codes"), codes("warnings").alias("warning_codes"), "test_name")


def identifiers(spark, sf):
    df = seed(spark, sf, "events", JSON_SEED).withColumnRenamed("k", "row_index")
    return df.select(F.col("row_index").alias("k"), record_identifier().alias("record_identifier"))


IDENTIFIERS = f"""SELECT {E} AS k, CASE {E} % 12 WHEN 0 THEN {E}::varchar WHEN 10 THEN 'u' || {E} WHEN 11 THEN event_type
  ELSE 'row_' || {E} END AS record_identifier FROM events"""


def typed_identifiers(spark, sf):
    df = table(spark, sf, "events").selectExpr(f"{E} AS row_index", f"CASE WHEN {E} % 3 = 0 THEN event_type END AS id",
                                               f"CASE WHEN {E} % 2 = 0 THEN user_id END AS uuid")
    return df.select(F.col("row_index").alias("k"), typed_identifier(df.columns).alias("record_identifier"))


ARRAY_SEED = {"k": "user_id % 50", "e": E, "p": "props"}


def arrays(spark, sf):
    """Arrays built per group of users, exploded again into numbered records."""
    packed = seed(spark, sf, "events", ARRAY_SEED).groupBy("k", F.expr("e div 40").alias("part")).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("e", "p"))), lambda x: x)).alias("value"))
    return explode_array(packed).select("k", "part", "row_index", F.get_json_object("value", "$.e").cast("bigint").alias("e"))


ARRAYS = """SELECT user_id % 50 AS k, event_id // 40 AS part, event_id AS e,
  row_number() OVER (PARTITION BY user_id % 50, event_id // 40 ORDER BY event_id) - 1 AS row_index FROM events"""

# documents that are arrays, empty arrays, no arrays, no JSON, null; arrays with null elements
DOCUMENT_SEED = {
    "k": E,
    "value": f"CASE {E} % 7 WHEN 0 THEN '[{{\"type\": \"t' || {E} || '\"}}, null]' WHEN 1 THEN '[]' WHEN 2 THEN '{{\"type\": \"x\"}}'"
             f" WHEN 3 THEN 'not json' WHEN 4 THEN NULL WHEN 5 THEN '[1, 2' ELSE '[{{\"type\": 7}}]' END",
}


def documents(spark, sf):
    """No document vanishes: what is no array gives one undecodable row."""
    rows = explode_array(seed(spark, sf, "events", DOCUMENT_SEED))
    v = validate(decode(rows, CATALOG["generic"]), CATALOG["generic"], as_of=AS_OF, root="record", undecodable="undecodable")
    return v.select("k", "row_index", "unreadable", "undecodable", "is_valid", F.size("errors").cast("bigint").alias("n_errors"))


# a record of the generic kind lacks three fields beside its type, a null element all four
DOCUMENTS = """SELECT event_id AS k, CASE WHEN event_id % 7 IN (0, 6) THEN i::bigint END AS row_index, event_id % 7 IN (2, 3, 4, 5) AS unreadable,
  event_id % 7 <> 0 AS undecodable, false AS is_valid, CAST(CASE WHEN event_id % 7 <> 0 THEN 1 WHEN i = 0 THEN 3 ELSE 4 END AS bigint) AS n_errors
FROM events, (VALUES (0), (1)) t(i) WHERE event_id % 7 <> 1 AND (i = 0 OR event_id % 7 = 0)"""

# integers with a point or an exponent, repeated keys
ODD_RULES = rule_set("Odd", integer("n"), text("s"), real("f"))
ODD_SEED = {
    "k": E,
    "value": f"CASE {E} % 8 WHEN 0 THEN '{{\"n\": ' || {E} || '.0}}' WHEN 1 THEN '{{\"n\": 1e3}}' WHEN 2 THEN '{{\"n\": 2.5}}'"
             f" WHEN 3 THEN '{{\"n\": 1, \"n\": ' || {E} || '}}' WHEN 4 THEN '{{\"s\": \"a\", \"s\": 5}}' WHEN 5 THEN '{{\"s\": 5, \"s\": \"b\"}}'"
             f" WHEN 6 THEN '{{\"n\": 1e30}}' ELSE '{{\"n\": -' || {E} || '.00, \"f\": 7, \"s\": \"x\"}}' END",
}


def odd_inputs(spark, sf):
    out = decode(seed(spark, sf, "events", ODD_SEED), ODD_RULES)
    return out.select("k", "undecodable", "record.n", "record.s", "record.f")


ODD_INPUTS = """SELECT event_id AS k, event_id % 8 IN (2, 4, 6) AS undecodable,
  CAST(CASE event_id % 8 WHEN 0 THEN event_id WHEN 1 THEN 1000 WHEN 3 THEN event_id WHEN 7 THEN -event_id END AS bigint) AS n,
  CASE event_id % 8 WHEN 5 THEN 'b' WHEN 7 THEN 'x' END AS s, CASE WHEN event_id % 8 = 7 THEN 7::double END AS f FROM events"""

# keys in other case than declared, at the top, nested and in arrays; two spellings at once; other keys and free maps stay as they are
CASE_RULES = rule_set(
    "Cased", text("title"), integer("n"), record("who", rule_set("Who", text("login"), texts("tags"))), records("items", rule_set("Item", integer("id"))), text_map("free"))
CASE_SEED = {
    "k": E,
    "value": f"CASE {E} % 8 WHEN 0 THEN '{{\"Title\": \"a\", \"N\": ' || {E} || '}}' WHEN 1 THEN '{{\"title\": \"exact\", \"TITLE\": \"other\", \"N\": ' || {E} || '.0}}'"
             f" WHEN 2 THEN '{{\"WHO\": {{\"LOGIN\": \"u' || {E} || '\", \"Tags\": [\"x\"]}}}}' WHEN 3 THEN '{{\"Items\": [{{\"ID\": 1}}, {{\"id\": ' || {E} || '}}, null]}}'"
             f" WHEN 4 THEN '{{\"Free\": {{\"Title\": \"kept\", \"ID\": \"7\"}}}}' WHEN 5 THEN '{{\"Title\": 5}}' WHEN 6 THEN '{{\"Titel\": \"unknown\", \"n\": 1}}'"
             f" ELSE '{{\"Who\": {{\"login\": 1}}}}' END",
}


def cased(spark, sf):
    out = decode(seed(spark, sf, "events", CASE_SEED), CASE_RULES)
    return out.select("k", "undecodable", "record.title", "record.n", F.col("record.who.login").alias("login"), F.array_join("record.who.tags", ",").alias("tags"),
                      F.expr("array_join(transform(record.items, x -> coalesce(cast(x.id AS string), '-')), ',')").alias("items"),
                      F.expr("concat_ws(',', record.free['Title'], record.free['ID'], record.free['title'])").alias("free"))


CASED = """SELECT event_id AS k, event_id % 8 IN (5, 7) AS undecodable, CASE event_id % 8 WHEN 0 THEN 'a' WHEN 1 THEN 'exact' END AS title,
  CAST(CASE event_id % 8 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 6 THEN 1 END AS bigint) AS n, CASE WHEN event_id % 8 = 2 THEN 'u' || event_id END AS login,
  CASE WHEN event_id % 8 = 2 THEN 'x' END AS tags, CASE WHEN event_id % 8 = 3 THEN '1,' || event_id || ',-' END AS items, CASE WHEN event_id % 8 = 4 THEN 'kept,7' ELSE '' END AS free FROM events"""

# query plans nested event_id % 23 deep; every third innermost step breaks two rules, every seventh has a value of the wrong type
DEEP_SEED = {
    "k": E,
    "depth": f"{E} % 23",
    "value": f"'{{\"execution_plan\": {{\"operations\": [' || repeat('{{\"type\": \"x\", \"children\": [', cast({E} % 23 AS INT))"
             f" || CASE WHEN {E} % 7 = 0 THEN '{{\"type\": 1}}' WHEN {E} % 3 = 0 THEN '{{\"type\": \"\", \"rows\": -1}}' ELSE '{{\"type\": \"y\"}}' END"
             f" || repeat(']}}', cast({E} % 23 AS INT)) || ']}}}}'",
}


def deep(spark, sf):
    rules = CATALOG["database"]
    v = validate(decode(seed(spark, sf, "events", DEEP_SEED), rules), rules, as_of=AS_OF, root="record", undecodable="undecodable")
    found = F.expr("filter(errors, e -> contains(e.path, 'Operations'))")
    return v.select("k", "undecodable", F.array_join(F.transform(found, lambda e: F.concat(e["path"], F.lit(":"), e["code"])), ",").alias("found"))


DEEP = """WITH d AS (SELECT event_id AS k, event_id % 7 = 0 AS undecodable, 'DatabaseQuery.ExecutionPlan.Operations[0]' || repeat('.Children[0]', CAST(event_id % 23 AS INT)) AS p FROM events)
SELECT k, undecodable, CASE WHEN NOT undecodable AND k % 3 = 0 THEN p || '.Type:required,' || p || '.Rows:gte' ELSE '' END AS found FROM d"""

# the same with many siblings below the unrolled levels, whose texts hold brackets; every fourth sibling breaks a rule
WIDE_SEED = {
    "k": E,
    "value": f"'{{\"execution_plan\": {{\"operations\": [' || repeat('{{\"type\": \"x\", \"children\": [', 3) || concat_ws(', ',"
             f" transform(slice(sequence(0, 60), 1, cast({E} % 61 AS INT)), i -> if(i % 4 = 3, '{{\"type\": \"\"}}', concat('{{\"type\": \"y{{[', i, '\"}}'))))"
             f" || repeat(']}}', 3) || ']}}}}'",
}


def wide(spark, sf):
    rules = CATALOG["database"]
    v = validate(decode(seed(spark, sf, "events", WIDE_SEED), rules), rules, as_of=AS_OF, root="record", undecodable="undecodable")
    found = F.expr("filter(errors, e -> contains(e.path, 'Operations'))")
    return v.select("k", "undecodable", F.array_join(F.transform(found, lambda e: e["path"]), ",").alias("found"))


WIDE = """SELECT event_id AS k, false AS undecodable, array_to_string(list_transform(range(0, (event_id % 61) // 4),
  lambda i: 'DatabaseQuery.ExecutionPlan.Operations[0].Children[0].Children[0].Children[' || (4 * i + 3) || '].Type'), ',') AS found FROM events"""

# schemas nested event_id % 37 deep; the innermost breaks two rules, or has a value of the wrong type; every fourth record has an empty
# name among the required ones on each level but the innermost
SCHEMA_SEED = {
    "k": E,
    "value": f"repeat(CASE WHEN {E} % 4 = 0 THEN '{{\"type\": \"array\", \"required\": [\"\"], \"items\": ' ELSE '{{\"type\": \"array\", \"items\": ' END, cast({E} % 37 AS INT))"
             f" || CASE WHEN {E} % 7 = 0 THEN '{{\"min_length\": \"1\"}}' WHEN {E} % 3 = 0 THEN '{{\"type\": \"odd\", \"min_length\": -1}}' ELSE '{{\"type\": \"string\"}}' END"
             f" || repeat('}}', cast({E} % 37 AS INT))",
}
TEAM_TEXT = ('"id": {id}, "node_id": "n", "url": "http://a.b/", "html_url": "http://a.b/", "name": "n", "slug": "s", "privacy": "{privacy}", "permission": "pull",'
             ' "members_url": "http://a.b/", "repositories_url": "http://a.b/"')
TEAM_SEED = {
    "k": E,
    "value": f"repeat('{{{TEAM_TEXT.format(id=1, privacy='closed')}, \"parent\": ', cast({E} % 41 AS INT))"
             f" || CASE WHEN {E} % 7 = 0 THEN '{{\"id\": \"1\"}}' WHEN {E} % 3 = 0 THEN '{{{TEAM_TEXT.format(id=0, privacy='open')}}}'"
             f" ELSE '{{{TEAM_TEXT.format(id=2, privacy='secret')}}}' END || repeat('}}', cast({E} % 41 AS INT))",
}


def nested(rules: RuleSet, columns: dict[str, str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        v = validate(decode(seed(spark, sf, "events", columns), rules), rules, as_of=AS_OF, root="record", undecodable="undecodable")
        found = F.transform(F.expr("filter(errors, e -> e.path IS NOT NULL)"), lambda e: F.concat(e["path"], F.lit(":"), e["code"]))
        return v.select("k", "undecodable", F.array_join(found, ",").alias("found"))

    return run


DEEP_SCHEMAS = """WITH d AS (SELECT event_id AS k, event_id % 7 = 0 AS undecodable, event_id % 37 AS depth FROM events)
SELECT k, undecodable, CASE WHEN undecodable THEN '' ELSE concat_ws(',',
  CASE WHEN k % 3 = 0 THEN 'APISchema' || repeat('.Items', depth) || '.Type:oneof,APISchema' || repeat('.Items', depth) || '.MinLength:gte' END,
  CASE WHEN k % 4 = 0 AND depth > 0 THEN array_to_string(list_transform(range(1, depth + 1), lambda i: 'APISchema' || repeat('.Items', depth - i) || '.Required[0]:min'), ',') END)
  END AS found FROM d"""
DEEP_TEAMS = """WITH d AS (SELECT event_id AS k, event_id % 7 = 0 AS undecodable, 'Team' || repeat('.Parent', event_id % 41) AS p FROM events)
SELECT k, undecodable, CASE WHEN NOT undecodable AND k % 3 = 0 THEN p || '.ID:required,' || p || '.Privacy:oneof' ELSE '' END AS found FROM d"""

ENVELOPE_SEED = {
    "k": E,
    "value": f"CASE {E} % 4 WHEN 0 THEN '{{\"model_type\": \"generic\", \"data\": [' || props || ', ' || props || '], \"threshold\": 50}}'"
             f" WHEN 1 THEN '{{\"model_type\": \"generic\", \"payload\": {{\"type\": 5}}}}'"
             f" WHEN 2 THEN '{{\"model_type\": \"nothing\", \"payload\": ' || props || '}}'"
             f" ELSE '{{\"model_type\": \"incident\", \"payload\": ' || props || ', \"data\": []}}' END",
}


def envelopes(spark, sf):
    r = request_records(read_requests(seed(spark, sf, "events", ENVELOPE_SEED)))
    return r.select("k", "model_type", "threshold", "is_array", "row_index", F.col("value").isNotNull().alias("has_record"))


ENVELOPES = f"""SELECT event_id AS k, CASE event_id % 4 WHEN 2 THEN 'nothing' WHEN 3 THEN 'incident' ELSE 'generic' END AS model_type,
  CASE WHEN event_id % 4 = 0 THEN 50::double END AS threshold, event_id % 4 = 0 AS is_array, i::bigint AS row_index, true AS has_record
FROM events, (VALUES (0), (1)) t(i) WHERE i = 0 OR event_id % 4 = 0"""

SMALL = {t: CATALOG[t] for t in ("incident", "generic")}


def routed(spark, sf):
    r = request_records(read_requests(seed(spark, sf, "events", ENVELOPE_SEED))).withColumn("soft", ~F.col("is_array"))
    v = route(r, SMALL, lenient="soft", as_of=AS_OF)
    return v.select("k", "row_index", "model_type", "is_valid", F.size("errors").cast("bigint").alias("n_errors"), "test_name")


# an events record in a generic request has none of the four required fields; a lenient {"type": 5} has one
ROUTED = """SELECT event_id AS k, i::bigint AS row_index, CASE event_id % 4 WHEN 3 THEN 'incident' WHEN 2 THEN 'nothing' ELSE 'generic' END AS model_type, false AS is_valid,
  CAST(CASE event_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 10 END AS bigint) AS n_errors,
  CASE event_id % 4 WHEN 3 THEN 'IncidentValidator:VALIDATION_FAILED' WHEN 2 THEN '' ELSE 'GenericValidator:required' END AS test_name
FROM events, (VALUES (0), (1)) t(i) WHERE i = 0 OR event_id % 4 = 0"""


def routed_json(spark, sf):
    """Records of three kinds, written as JSON, decoded and validated in one pass."""
    parts = []
    for name, model in (("incident", INCIDENT), ("deployment", DEPLOYMENT), ("generic", GENERIC)):
        as_json = F.to_json("record", {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"})
        parts.append(model.records(spark, sf).select("k", F.lit(name).alias("model_type"), as_json.alias("value")))
    v = route(parts[0].unionByName(parts[1]).unionByName(parts[2]), CATALOG, as_of=AS_OF)
    return v.groupBy("model_type", "test_name").agg(F.count("*").alias("n"))


def _model_counts(name: str, model) -> str:
    return f"(SELECT '{name}' AS model_type, test_name, count(*) AS n FROM ({model.result_sql()} SELECT test_name FROM v) GROUP BY test_name)"


ROUTED_JSON = "SELECT * FROM " + " UNION ALL SELECT * FROM ".join(
    _model_counts(n, m) for n, m in (("incident", INCIDENT), ("deployment", DEPLOYMENT), ("generic", GENERIC)))


def unknown(spark, sf):
    r = read_requests(seed(spark, sf, "events", ENVELOPE_SEED))
    return unknown_types(r, CATALOG).select("k", "model_type")


def row_index(spark, sf):
    df = table(spark, sf, "orders").select(K, (F.lit(10_000_000) - F.col(K)).alias("place"))
    return with_row_index(df, "place").select(K, "row_index")


# ---- batch sessions ----------------------------------------------------------------------------
# one session per day of events; it starts ten minutes before the first event and every other day is
# completed at 20:00
DAY = "cast(cast(ts AS date) AS string)"
EVENT_RULES = rule_set(
    "Event", text("event_type", required, oneof="click view purchase signup"), real("value", required, gte=5),
    checks=[Check("BIG_VALUE", "$value > 90", "Value", "Value {$value}")], title="EventValidator", style="generic")


def events(spark, sf):
    df = table(spark, sf, "events").select(F.expr(DAY).alias("batch_id"), F.expr(utc("ts")).alias("ts"), E, "event_type", "value")
    return validate(df, EVENT_RULES)


def control(spark, sf):
    days = table(spark, sf, "events").groupBy(F.expr(DAY).alias("batch_id")).agg(F.min("ts").alias("t"), F.expr("cast(day(min(ts)) AS bigint)").alias("d"))
    begin = days.filter("d % 7 <> 0").select(
        "batch_id", F.lit("start").alias("kind"), F.expr(f"{utc('t')} - INTERVAL 10 MINUTES").alias("ts"),
        F.expr("CASE WHEN d % 3 > 0 THEN 40.0D + d END").alias("threshold"))
    end = days.filter("d % 2 = 0").select(
        "batch_id", F.lit("complete").alias("kind"), F.expr(utc("concat(batch_id, ' 20:00:00')")).alias("ts"),
        F.lit(None).cast("double").alias("threshold"))
    return begin.unionByName(end)


def chunks(spark, sf):
    return ses.chunk_counts(events(spark, sf))


SESSIONS = """WITH ev AS (SELECT cast(ts AS date)::varchar AS batch_id, ts, event_id, day(ts) AS d,
    event_type IN ('click', 'view', 'purchase', 'signup') AND value >= 5 AS ok, value > 90 AS big FROM events),
b AS (SELECT batch_id, min(d) AS d, min(ts) - INTERVAL 10 MINUTE AS started,
    CASE WHEN min(d) % 2 = 0 THEN (batch_id || ' 20:00:00')::timestamp END AS done0 FROM ev GROUP BY batch_id),
c AS (SELECT batch_id, d, started, CASE WHEN done0 >= started THEN done0 END AS done,
    CASE WHEN d % 3 > 0 THEN (40 + d)::double END AS threshold FROM b WHERE d % 7 <> 0),
u AS (SELECT ev.*, c.started, c.done FROM ev JOIN c USING (batch_id) WHERE c.done IS NULL OR ev.ts <= c.done),
g AS (SELECT *, ts - coalesce(lag(ts) OVER (PARTITION BY batch_id ORDER BY ts, event_id), started) > INTERVAL 30 MINUTE AS gap FROM u),
x AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY batch_id ORDER BY ts, event_id) > 0 AS dead FROM g),
t AS (SELECT c.batch_id, c.threshold, c.started, c.done, count(*) FILTER (x.ok AND NOT x.dead) AS valid,
    count(*) FILTER (NOT x.ok AND NOT x.dead) AS invalid, count(*) FILTER (x.ok AND x.big AND NOT x.dead) AS warned,
    coalesce(bool_or(x.dead), false) AS dead, coalesce(max(x.ts) FILTER (NOT x.dead), c.started) AS last_ts
  FROM c LEFT JOIN x USING (batch_id) GROUP BY c.batch_id, c.threshold, c.started, c.done),
z AS (SELECT *, dead OR (done IS NOT NULL AND done - last_ts > INTERVAL 30 MINUTE) AS expired FROM t)
"""


def session_state(spark, sf):
    s = ses.sessions(control(spark, sf), chunks(spark, sf))
    return s.select("batch_id", "status", "is_final", "is_expired", "total_records", "valid_records", "invalid_records",
                    "warning_records", "success_rate", "threshold", F.expr("unix_micros(last_updated)").alias("last_updated"))


SESSION_STATE = SESSIONS + """SELECT batch_id,
  CASE WHEN expired THEN 'expired' WHEN done IS NULL THEN 'in_progress'
    WHEN threshold IS NOT NULL AND valid + invalid > 0 THEN CASE WHEN valid / (valid + invalid) * 100.0 < threshold THEN 'failed' ELSE 'success' END
    WHEN valid + invalid = 1 AND invalid = 1 THEN 'failed' ELSE 'success' END AS status,
  done IS NOT NULL AND NOT expired AS is_final, expired AS is_expired, valid + invalid AS total_records, valid AS valid_records,
  invalid AS invalid_records, warned AS warning_records, CASE WHEN valid + invalid = 0 THEN 0.0 ELSE valid / (valid + invalid) * 100.0 END AS success_rate,
  threshold, epoch_us(CASE WHEN expired OR done IS NULL THEN last_ts ELSE done END) AS last_updated FROM z"""


def session_starts(spark, sf):
    s = ses.start_sessions(control(spark, sf))
    return s.select("batch_id", "status", F.expr("unix_micros(started_at)").alias("started_at"), F.expr("unix_micros(expires_at)").alias("expires_at"), "threshold")


def session_rejects(spark, sf):
    r = ses.rejected_chunks(control(spark, sf), chunks(spark, sf))
    return r.groupBy("batch_id", "reason").agg(F.sum(F.expr("valid + invalid")).alias("records"))


SESSION_REJECTS = SESSIONS + """, y AS (SELECT ev.batch_id, CASE WHEN c.batch_id IS NULL THEN 'unknown'
    WHEN c.done IS NOT NULL AND ev.ts > c.done AND NOT coalesce(k.dead, false) THEN 'completed'
    WHEN c.done IS NOT NULL AND ev.ts > c.done THEN 'expired' END AS reason
  FROM ev LEFT JOIN c USING (batch_id) LEFT JOIN (SELECT batch_id, bool_or(dead) AS dead FROM x GROUP BY batch_id) k USING (batch_id)
  UNION ALL SELECT batch_id, 'expired' FROM x WHERE dead)
SELECT batch_id, reason, count(*) AS records FROM y WHERE reason IS NOT NULL GROUP BY ALL"""


def session_running(spark, sf):
    r = ses.running_totals(chunks(spark, sf))
    return r.select("batch_id", F.expr("unix_micros(ts)").alias("ts"), "records_count")


def live(spark, sf):
    return ses.live_sessions(ses.sessions(control(spark, sf), chunks(spark, sf))).select("batch_id", "total_records")


def restarts(spark, sf):
    """The control events, and a second start at noon on every third day."""
    noon = table(spark, sf, "events").selectExpr(f"{DAY} AS batch_id", "cast(day(ts) AS bigint) AS d").distinct().filter("d % 3 = 1")
    begin = noon.select("batch_id", F.lit("start").alias("kind"), F.expr(utc("concat(batch_id, ' 12:00:00')")).alias("ts"), F.expr("70.0D + d").alias("threshold"))
    return control(spark, sf).unionByName(begin)


def restarted(spark, sf):
    """Runs of every batch id, also those that a second start replaced."""
    s = ses.sessions(restarts(spark, sf), chunks(spark, sf))
    return s.select("batch_id", F.expr("unix_micros(started_at)").alias("started_at"), "status", "total_records", "valid_records")


RUNS = """WITH e AS (SELECT cast(ts AS date)::varchar AS batch_id, ts, 1 AS rank, event_type IN ('click', 'view', 'purchase', 'signup') AND value >= 5 AS ok, NULL::double AS threshold, day(ts) AS d FROM events),
b AS (SELECT batch_id, min(d) AS d, min(ts) AS t FROM e GROUP BY batch_id),
a AS (SELECT batch_id, ts, rank, ok, threshold FROM e
  UNION ALL SELECT batch_id, t - INTERVAL 10 MINUTE, 0, NULL, CASE WHEN d % 3 > 0 THEN 40 + d END FROM b WHERE d % 7 <> 0
  UNION ALL SELECT batch_id, (batch_id || ' 12:00:00')::timestamp, 0, NULL, 70 + d FROM b WHERE d % 3 = 1
  UNION ALL SELECT batch_id, (batch_id || ' 20:00:00')::timestamp, 2, NULL, NULL FROM b WHERE d % 2 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ts, rank) AS i FROM a),
r AS (SELECT *, count(*) FILTER (rank = 0) OVER (PARTITION BY batch_id ORDER BY i) AS run FROM n),
g AS (SELECT *, coalesce(count(*) FILTER (rank = 2) OVER (PARTITION BY batch_id, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  ts - lag(ts) OVER (PARTITION BY batch_id, run ORDER BY i) > INTERVAL 30 MINUTE AS gap FROM r),
x AS (SELECT *, count(*) FILTER (gap AND before = 0) OVER (PARTITION BY batch_id, run ORDER BY i) > 0 AS dead FROM g),
s AS (SELECT batch_id, run, min(ts) AS started, max(threshold) FILTER (rank = 0) AS threshold, bool_or(dead) AS dead, bool_or(rank = 2 AND NOT dead) AS final,
    max(ts) FILTER (NOT dead AND before = 0 AND rank < 2) AS last_ts, count(*) FILTER (rank = 1 AND NOT dead AND before = 0) AS total,
    count(*) FILTER (rank = 1 AND ok AND NOT dead AND before = 0) AS valid FROM x WHERE run > 0 GROUP BY batch_id, run),
z AS (SELECT *, lead(started) OVER (PARTITION BY batch_id ORDER BY run) AS following FROM s),
q AS (SELECT batch_id, epoch_us(started) AS started_at, CASE WHEN dead OR (NOT final AND coalesce(following - last_ts > INTERVAL 30 MINUTE, false)) THEN 'expired'
    WHEN final THEN CASE WHEN threshold IS NOT NULL AND total > 0 THEN CASE WHEN valid / total * 100.0 < threshold THEN 'failed' ELSE 'success' END
      WHEN total = 1 AND valid = 0 THEN 'failed' ELSE 'success' END
    WHEN following IS NOT NULL THEN 'replaced' ELSE 'in_progress' END AS status, total AS total_records, valid AS valid_records FROM z)
"""


def all_queries() -> list[Query]:
    good_bad = V + "SELECT CASE WHEN is_valid THEN 'good' ELSE 'bad' END AS side, o_orderkey FROM v"
    summary = f"SELECT {COUNTS}, {NAMES} FROM v"
    summary = f", c AS ({summary}) SELECT {', '.join(NUMBERS)}, {RATE} AS success_rate, successful_test_names, failed_test_names, total_tests_ran FROM c"
    codes_of = "SELECT unnest(string_split({c}, ',')) AS code FROM v WHERE {c} <> ''"
    return [
        Query("a01_a05_a06_a07_row_results", row_results, V + "SELECT o_orderkey, is_valid, error_codes, warning_codes, test_name FROM v"),
        Query("a02_a03_code_styles", styles, STYLES),
        Query("a04_a08_error_details", detail, DETAIL),
        Query("a09_labels", labels, V + "SELECT 'order' AS model_type, 'order_validator' AS provider, is_valid, count(*) AS n FROM v GROUP BY ALL"),
        Query("a10_decode_failures", decode_failures,
              "SELECT event_id AS k, false AS is_valid, 'JSON_UNMARSHAL_ERROR' AS error_codes, '' AS warning_codes, 'IncidentValidator' AS test_name"
              " FROM events WHERE event_id % 12 IN (0, 1, 2, 3, 4, 6, 7, 8)"),
        Query("g01_g03_g06_g08_summary", lambda s, d: flat(rep.summarize(orders(s, d))), V + summary),
        Query("g01_counts_by_customer", lambda s, d: rep.counts(orders(s, d), ["o_custkey"]), V + f"SELECT o_custkey, {COUNTS} FROM v GROUP BY o_custkey"),
        Query("g01_incremental_report", incremental_report, V + summary[:-len(" FROM c")] + f", CASE WHEN {RATE} < 80 THEN 'failed' ELSE 'success' END AS status FROM c"),
        Query("g09_incremental_codes", incremental_codes,
              V + "SELECT year(o_orderdate)::varchar AS year, code, count(*) AS n FROM (SELECT o_orderdate, unnest(string_split(concat_ws(',', nullif(error_codes, ''), nullif(warning_codes, '')), ',')) AS code FROM v)"
                  " WHERE code <> '' GROUP BY ALL"),
        Query("g04_gate_failed", with_threshold(60.0), threshold_sql(60.0)),
        Query("g04_gate_success", with_threshold(1.0), threshold_sql(1.0)),
        Query("g05_gate_without_threshold", with_threshold(None), threshold_sql(None)),
        Query("g05_lone_record_gate", lone_gate,
              V + "SELECT o_orderkey, CAST(CASE WHEN is_valid THEN 100 ELSE 0 END AS DOUBLE) AS success_rate, CASE WHEN is_valid THEN 'success' ELSE 'failed' END AS status FROM v"),
        Query("g04_gate_per_customer", gate_per_customer,
              V + f", c AS (SELECT o_custkey, {COUNTS} FROM v GROUP BY o_custkey) SELECT o_custkey, {RATE} AS success_rate,"
                  f" CASE WHEN {RATE} < o_custkey % 101 THEN 'failed' ELSE 'success' END AS status FROM c"),
        Query("g03_last_bit", last_bit,
              "SELECT s_suppkey, (1 + s_suppkey % 100) / 100 * 100.0 AS success_rate,"
              " CASE WHEN (1 + s_suppkey % 100) / 100 * 100.0 < 1 + s_suppkey % 100 THEN 'failed' ELSE 'success' END AS status FROM supplier"),
        Query("g09_errors_by_code", lambda s, d: rep.by_code(orders(s, d)),
              V + f"SELECT code, count(*) AS n FROM ({codes_of.format(c='error_codes')}) GROUP BY code"),
        Query("g09_warnings_by_code", lambda s, d: rep.by_code(orders(s, d), "warnings"),
              V + f"SELECT code, count(*) AS n FROM ({codes_of.format(c='warning_codes')}) GROUP BY code"),
        Query("g09_errors_by_code_map", code_map,
              V + f", n AS (SELECT code, count(*) AS n FROM ({codes_of.format(c='error_codes')}) GROUP BY code)"
                  " SELECT string_agg(code || '=' || n, ',' ORDER BY code) AS errors_by_code FROM n"),
        Query("g10_common_errors", lambda s, d: rep.common_errors(orders(s, d), 2),
              V + f"SELECT code, count(*) AS n FROM ({codes_of.format(c='error_codes')}) GROUP BY code ORDER BY n DESC, code LIMIT 2"),
        Query("g11_first_failure", lambda s, d: rep.first_failure(orders(s, d), K).select(K, "test_name"),
              V + "SELECT o_orderkey, test_name FROM v WHERE NOT is_valid ORDER BY o_orderkey LIMIT 1"),
        Query("g11_fail_fast", fail_fast_orders,
              V + "SELECT o_orderkey, test_name FROM v WHERE NOT is_valid ORDER BY year(o_orderdate), o_orderkey LIMIT 3"),
        Query("g12_rollup", rollup,
              V + f", c AS (SELECT year(o_orderdate) AS year, o_orderstatus, {COUNTS}, grouping(year(o_orderdate), o_orderstatus)::bigint AS grouping_level"
                  f" FROM v GROUP BY ROLLUP (year(o_orderdate), o_orderstatus)) SELECT year, o_orderstatus, {', '.join(NUMBERS)}, {RATE} AS success_rate, grouping_level FROM c"),
        Query("g12_incremental_rollup", incremental_rollup,
              V + f", c AS (SELECT year(o_orderdate) AS year, o_orderstatus, {COUNTS}, grouping(year(o_orderdate), o_orderstatus)::bigint AS grouping_level"
                  f" FROM v GROUP BY ROLLUP (year(o_orderdate), o_orderstatus)) SELECT year, o_orderstatus, {', '.join(NUMBERS)}, {RATE} AS success_rate, grouping_level FROM c"),
        Query("g12_cube", cube,
              V + f", c AS (SELECT o_orderstatus, o_orderpriority, {COUNTS}, grouping(o_orderstatus, o_orderpriority)::bigint AS grouping_level"
                  f" FROM v GROUP BY CUBE (o_orderstatus, o_orderpriority)) SELECT o_orderstatus, o_orderpriority, total_records, {RATE} AS success_rate, grouping_level FROM c"),
        Query("g12_errors_by_field", by_field,
              V + "SELECT field, code, count(*) AS n FROM (SELECT 'OOrderstatus' AS field, e1 AS code FROM v UNION ALL SELECT 'OTotalprice', e2 FROM v"
                  " UNION ALL SELECT 'OOrderpriority', e3 FROM v) WHERE code IS NOT NULL GROUP BY ALL"),
        Query("g12_daily", daily,
              V + f", c AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, {COUNTS} FROM v GROUP BY day) SELECT *, {RATE} AS success_rate FROM c"),
        Query("g13_batch_response", batch_response,
              V + f"SELECT {REQUEST} AS request, count(*) AS total_count, count(*) FILTER (is_valid) AS valid_count, count(*) FILTER (NOT is_valid) AS invalid_count,"
                  " count(*) > 100 AS oversized FROM v GROUP BY request"),
        Query("g14_slow_rows", slow_rows,
              V + "SELECT o_orderkey, o_orderkey % 205 > 100 AS is_slow, (n_warnings + (o_orderkey % 205 > 100)::int)::bigint AS n_warnings FROM v"),
        Query("s01_s05_strict_decode", strict, STRICT),
        Query("s02_arrays", arrays, ARRAYS),
        Query("s02_unreadable_documents", documents, DOCUMENTS),
        Query("s05_odd_inputs", odd_inputs, ODD_INPUTS),
        Query("s05_keys_in_other_case", cased, CASED),
        Query("m43_deep_plans", deep, DEEP),
        Query("m43_wide_plans", wide, WIDE),
        Query("m36_deep_schemas", nested(SCHEMA, SCHEMA_SEED), DEEP_SCHEMAS),
        Query("m65_deep_teams", nested(TEAM, TEAM_SEED), DEEP_TEAMS),
        Query("s02_row_index", row_index, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS row_index FROM orders"),
        Query("s03_s04_envelopes", envelopes, ENVELOPES),
        Query("s06_lenient_decode", lenient, LENIENT),
        Query("s07_record_identifiers", identifiers, IDENTIFIERS),
        Query("s07_typed_identifiers", typed_identifiers,
              "SELECT event_id AS k, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, CASE WHEN event_id % 2 = 0 THEN user_id::varchar END,"
              " 'row_' || event_id) AS record_identifier FROM events"),
        Query("s08_report_by_status", lambda s, d: flat(rep.report(orders(s, d), 50.0, ["o_orderstatus"]), "o_orderstatus", "status"),
              V + f", c AS (SELECT o_orderstatus, {COUNTS}, {NAMES} FROM v GROUP BY o_orderstatus) SELECT o_orderstatus, {', '.join(NUMBERS)}, {RATE} AS success_rate,"
                  f" successful_test_names, failed_test_names, total_tests_ran, CASE WHEN {RATE} < 50 THEN 'failed' ELSE 'success' END AS status FROM c"),
        Query("s09_quarantine", quarantine, V + "SELECT o_orderkey, error_codes FROM v WHERE NOT is_valid"),
        Query("s09_bad_or_warned", bad_or_warned, V + "SELECT o_orderkey, test_name FROM v WHERE NOT is_valid OR n_warnings > 0"),
        Query("s09_v11_written_split", split_counts, good_bad),
        Query("s10_violations", lambda s, d: rep.flatten_findings(orders(s, d), "warnings", [K]).select(K, "code", "field", "suggestion", "category"),
              V + "SELECT o_orderkey, 'BIG_ORDER' AS code, 'Total' AS field, 'Look twice' AS suggestion, 'size' AS category FROM v WHERE w1 IS NOT NULL"
                  " UNION ALL SELECT o_orderkey, 'URGENT_FINISHED', 'Status', '', '' FROM v WHERE w2 IS NOT NULL"),
        Query("c02_route_requests", routed, ROUTED),
        Query("c02_route_mixed_json", routed_json, ROUTED_JSON),
        Query("c02_unknown_types", unknown, "SELECT event_id AS k, 'nothing' AS model_type FROM events WHERE event_id % 4 = 2"),
        Query("v10_c05_user_rules_and_checks", lambda s, d: rep.by_code(validate(
            table(s, d, "customer"), rule_set("Customer", text("c_mktsegment", required), integer("c_nationkey", gte=1)),
            checks=[Check("NEGATIVE_BALANCE", "$c_nationkey > 0 AND c_acctbal < 0")]), "warnings"),
            "SELECT 'NEGATIVE_BALANCE' AS code, count(*) AS n FROM customer WHERE c_nationkey >= 1 AND c_acctbal < 0 HAVING count(*) > 0"),
        Query("b01_session_starts", session_starts, SESSIONS + "SELECT batch_id, 'active' AS status, epoch_us(started) AS started_at,"
              " epoch_us(started + INTERVAL 30 MINUTE) AS expires_at, threshold FROM c"),
        Query("b02_running_totals", session_running, "SELECT cast(ts AS date)::varchar AS batch_id, epoch_us(ts) AS ts, max(n) AS records_count FROM ("
              "SELECT ts, count(*) OVER (PARTITION BY cast(ts AS date) ORDER BY ts) AS n FROM events) GROUP BY ALL"),
        Query("b03_b04_b08_session_states", session_state, SESSION_STATE),
        Query("b01_b04_restarted_sessions", restarted, RUNS + "SELECT * FROM q"),
        Query("b05_expired_sessions", lambda s, d: session_state(s, d).filter("is_expired").select("batch_id", "total_records", "last_updated"),
              SESSION_STATE.replace("SELECT batch_id,\n  CASE WHEN expired", ", q AS (SELECT batch_id,\n  CASE WHEN expired") + ") SELECT batch_id, total_records, last_updated FROM q WHERE is_expired"),
        Query("b06_live_sessions", live, SESSIONS + "SELECT batch_id, valid + invalid AS total_records FROM z WHERE NOT expired AND done IS NULL"),
        Query("b07_rejected_chunks", session_rejects, SESSION_REJECTS),
    ]
