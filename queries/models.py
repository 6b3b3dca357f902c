"""Queries for the ready-made models: row verdicts, error findings, business-check codes and test names.

The checking SQL states every business check on its own; see queries/structures.py for the field rules.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.base import AS_OF, Query, joined, seed, seed_sql
from queries.structures import Flat, Spec
from tamis.models import api, database, deployment, generic, github, incident
from tamis.operators.report import by_code
from tamis.operators.validate import codes, validate
from tamis.plans.ruleset import RuleSet

NOW = 1706745600  # AS_OF in epoch seconds


def has(column: str, *words: str) -> str:
    """Checking SQL: the text contains one of the words."""
    return "(" + " OR ".join(f"contains({column}, '" + w.replace("'", "''") + "')" for w in words) + ")"


class Model:
    """One model over one table: the Spark side and the checking SQL."""

    def __init__(self, rules: RuleSet, table: str, key: str, spec: Spec, warnings: list[tuple[str, str]],
                 extra_errors: list[tuple[str, str]] = (), field_count: str | None = None) -> None:
        self.rules, self.table, self.key = rules, table, key
        plain = rules.with_(checks=(), extra_errors=())
        self.flat = Flat(plain, key, spec)
        self.record, _ = self.flat.structure(plain, "", "")
        self.columns = {"k": key, **self.flat.columns}
        self.warnings = [(self.names(c), code) for c, code in warnings]
        self.extra = [(self.names(c), code) for c, code in extra_errors]
        self.field_count = self.names(field_count) if field_count else None

    def names(self, sql: str) -> str:
        return re.sub(r"\$([a-z_0-9.]+[#!]?(?:=\d)?)", lambda m: "(" + self.flat.names[m[1]] + ")", sql)

    def records(self, spark: SparkSession, sf: str, dealt: bool = True) -> DataFrame:
        return seed(spark, sf, self.table, self.columns, dealt).select("k", F.expr(self.record).alias("record"))

    def validated(self, spark: SparkSession, sf: str, dealt: bool = False, **kw: object) -> DataFrame:
        """The records where the table's rows lie, which takes no shuffle; the registered queries deal the rows first."""
        return validate(self.records(spark, sf, dealt), self.rules, as_of=AS_OF, root="record", **kw)

    def result_sql(self) -> str:
        """CTEs that end in ``v(k, is_valid, findings, first_error, warning_codes, test_name)``."""
        listed = "concat_ws(',', " + ",\n  ".join(self.flat.findings or ["NULL"]) + ")"
        extra = joined(self.extra) if self.extra else "''"
        found = joined(self.warnings)
        always = "true" if self.rules.checks_when_invalid else "findings = ''"
        count = f", {self.field_count} AS field_count" if self.field_count else ""
        title = self.rules.title
        return f"""WITH s AS ({seed_sql(self.table, self.columns)}),
f AS (SELECT *, {listed} AS rule_findings FROM s),
e AS (SELECT *, CASE WHEN rule_findings <> '' THEN rule_findings ELSE {extra} END AS findings FROM f),
w AS (SELECT *, CASE WHEN {always} THEN {found} ELSE '' END AS warning_codes{count} FROM e),
v AS (SELECT *, findings = '' AS is_valid, '{title}' || CASE
    WHEN findings <> '' THEN ':' || split_part(split_part(findings, ',', 1), ':', -1)
    WHEN warning_codes <> '' THEN ':' || split_part(warning_codes, ',', 1) ELSE '' END AS test_name FROM w)
"""

    def row_query(self, name: str) -> Query:
        root = self.rules.name

        def run(spark: SparkSession, sf: str) -> DataFrame:
            v = self.validated(spark, sf, dealt=True, field_count=self.field_count is not None)
            where = f"coalesce(concat(replace(e.path, '{root}.', ''), ':'), if(e.code = 'VALIDATION_FAILED', concat(e.field, ':'), ''))"
            found = F.expr(f"array_join(transform(errors, e -> concat({where}, e.code)), ',')").alias("findings")
            count = ["field_count"] if self.field_count else []
            return v.select("k", "is_valid", found, codes("warnings").alias("warning_codes"), "test_name", *count)

        count = ", CAST(field_count AS BIGINT) AS field_count" if self.field_count else ""
        return Query(name, run, self.result_sql() + f"SELECT k, is_valid, findings, warning_codes, test_name{count} FROM v")

    def code_query(self, name: str) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return by_code(self.validated(spark, sf, dealt=True), "warnings")

        return Query(name, run, self.result_sql() + (
            "SELECT code, count(*) AS n FROM (SELECT unnest(string_split(warning_codes, ',')) AS code FROM v"
            " WHERE warning_codes <> '') GROUP BY code"))


K = "o_orderkey"
INCIDENT = Model(
    incident.INCIDENT, "orders", K,
    Spec(
        values={
            "id": f"CASE WHEN {K} % 13 = 0 THEN 'INC-2024-001' WHEN {K} % 29 = 0 THEN '' ELSE 'INC-202401' ||"
                  f" lpad(cast({K} % 28 + 1 AS string), 2, '0') || '-' || lpad(cast({K} % 10000 AS string), 4, '0') END",
            "title": f"CASE {K} % 7 WHEN 0 THEN 'Database is Down now' WHEN 1 THEN 'Checkout failure for many of our customers'"
                     f" WHEN 2 THEN 'Report on ' || o_orderpriority WHEN 3 THEN 'A bug' || ' in  it: ' || {K}"
                     f" WHEN 4 THEN CASE WHEN {K} % 3 = 0 THEN 'short' ELSE 'Login problem again' END ELSE 'Ordinary title ' || {K} END",
            "description": f"CASE WHEN {K} % 43 = 0 THEN 'too short' ELSE 'Order total of ' || cast(cast(o_totalprice AS bigint) AS string) || ' looks odd' END",
            "severity": f"CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'"
                        f" WHEN '3-MEDIUM' THEN 'medium' ELSE CASE WHEN {K} % 31 = 0 THEN 'none' ELSE 'low' END END",
            "priority": f"CASE WHEN {K} % 5 = 0 THEN {K} % 7 ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 5"
                        f" WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 2 ELSE 1 END END",
            "status": "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'investigating' ELSE 'resolved' END",
            "category": f"CASE {K} % 4 WHEN 0 THEN 'bug' WHEN 1 THEN 'security' WHEN 2 THEN 'feature' ELSE 'performance' END",
            "environment": f"CASE {K} % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' ELSE 'development' END",
            "reported_by": f"'customer ' || o_custkey",
            "assigned_to": f"CASE WHEN {K} % 2 = 0 THEN NULL WHEN {K} % 23 = 0 THEN 'ab' ELSE 'team ' || {K} END",
            "reported_at": f"CASE WHEN {K} % 37 = 0 THEN NULL ELSE {NOW} - ({K} % 49) * 3600 END",
            "impact": f"CASE WHEN {K} % 47 = 0 THEN 'huge' END",
        },
        sizes={"tags": f"CASE {K} % 6 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE {K} % 4 END"},
        items={"tags": [f"CASE WHEN {K} % 53 = 0 THEN 'x' ELSE 'tag' END"]},
    ),
    warnings=[
        ("$severity = 'critical' AND $assigned_to = ''", "CRITICAL_INCIDENT_UNASSIGNED"),
        ("$environment = 'production' AND $priority < 3", "PRODUCTION_LOW_PRIORITY"),
        (f"$status IN ('open', 'investigating') AND ($reported_at IS NULL OR {NOW} - $reported_at > 86400)", "STALE_INCIDENT"),
        ("$severity IN ('high', 'critical') AND regexp_matches(lower($title), 'issue|problem|error|bug|broken|down|failure')"
         " AND len(list_filter(regexp_split_to_array($title, '[ ]+'), lambda x: x <> '')) < 6", "GENERIC_INCIDENT_TITLE"),
        ("$category = 'security' AND greatest($tags#, 0) = 0", "SECURITY_INCIDENT_NO_TAGS"),
    ],
    extra_errors=[
        ("NOT regexp_matches($id, '^INC-[0-9]{8}-[0-9]{4}$')", "INVALID_ID_FORMAT"),
        ("NOT (($severity = 'low' AND $priority IN (1, 2)) OR ($severity = 'medium' AND $priority IN (2, 3))"
         " OR ($severity = 'high' AND $priority IN (3, 4)) OR ($severity = 'critical' AND $priority IN (4, 5)))",
         "PRIORITY_SEVERITY_MISMATCH"),
    ],
)

P = "p_partkey"
DEPLOYMENT = Model(
    deployment.DEPLOYMENT, "part", P,
    Spec(values={
        "id": f"'dep-' || {P}",
        "app_name": f"CASE {P} % 9 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN p_name WHEN 2 THEN 'a' ELSE 'svc-' || {P} END",
        "environment": f"CASE {P} % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' ELSE 'development' END",
        "version": f"CASE {P} % 8 WHEN 0 THEN '0' || p_size || '.1.0' WHEN 1 THEN p_size || '.0.0-Alpha.1' WHEN 2 THEN 'v1.0.0'"
                   f" WHEN 3 THEN '1.2.' || p_size || '-devel' ELSE p_size || '.1.' || ({P} % 5) END",
        "status": f"CASE {P} % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'completed' ELSE 'running' END",
        "branch": f"CASE {P} % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'master' ELSE 'release/' || {P} END",
        "commit_hash": f"CASE WHEN {P} % 19 = 0 THEN substr(md5(p_name), 1, 8) ELSE md5(p_name) || substr(md5(p_brand), 1, 8) END",
        "deployed_by": f"CASE WHEN {P} % 17 = 0 THEN 'nobody' ELSE 'dev' || {P} || '@example.com' END",
        "rollback": f"{P} % 6 = 0",
    }),
    warnings=[
        ("$environment = 'production' AND $branch <> 'main' AND $branch <> 'master'", "NON_MAIN_PROD_DEPLOY"),
        ("$rollback", "ROLLBACK_DEPLOYMENT"),
        ("$status = 'failed'", "FAILED_DEPLOYMENT"),
        ("$environment = 'production' AND regexp_matches(lower($version), 'dev|test|alpha')", "DEV_VERSION_IN_PROD"),
    ],
)

E = "event_id"
GENERIC = Model(
    generic.GENERIC, "events", E,
    Spec(
        values={
            "type": f"CASE WHEN {E} % 12 = 0 THEN 'heartbeat' WHEN {E} % 61 = 0 THEN '' ELSE event_type END",
            "version": f"CASE WHEN {E} % 59 = 0 THEN '1.02.0' WHEN {E} % 2 = 0 THEN '1.2.' || ({E} % 30) END",
            "timestamp": f"CASE {E} % 10 WHEN 0 THEN {NOW} + 301 WHEN 1 THEN {NOW} - 8760 * 3600 - 1 WHEN 2 THEN {NOW} + 300"
                         f" WHEN 3 THEN {NOW} - 8760 * 3600 ELSE {NOW} - ({E} % 1000) * 60 END",
            "source": f"CASE WHEN {E} % 67 = 0 THEN 'example.com/no-scheme' ELSE 'https://user' || user_id || '.example.com/e' END",
            "priority": f"CASE {E} % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' WHEN 2 THEN 'urgent' WHEN 3 THEN '3' WHEN 4 THEN 'HIGH' END",
            "status": f"CASE {E} % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'completed' WHEN 3 THEN 'processing' END",
            "checksum": f"CASE WHEN {E} % 4 = 0 THEN md5(props) || md5(event_type) WHEN {E} % 71 = 0 THEN 'abc' END",
        },
        sizes={
            "data": f"CASE WHEN {E} % 73 = 0 THEN -1 WHEN {E} % 9 = 0 THEN 0 WHEN {E} % 101 = 0 THEN 100 WHEN {E} % 103 = 0 THEN 101 ELSE {E} % 5 + 1 END",
            "metadata": f"CASE WHEN {E} % 8 = 0 THEN -1 WHEN {E} % 107 = 0 THEN 51 WHEN {E} % 109 = 0 THEN 50 ELSE {E} % 4 END",
            "tags": f"CASE WHEN {E} % 11 = 0 THEN -1 WHEN {E} % 97 = 0 THEN 21 WHEN {E} % 89 = 0 THEN 20 ELSE {E} % 5 END",
        },
        items={
            "data": ["'k'"],
            "metadata": [f"CASE {E} % 6 WHEN 0 THEN 'Api_Token' WHEN 1 THEN 'owner' ELSE 'region' END", "'note'"],
            "tags": ["event_type", f"CASE WHEN {E} % 3 = 0 THEN event_type WHEN {E} % 3 = 1 THEN 'two words' ELSE 'plain' END",
                     f"CASE WHEN {E} % 4 = 0 THEN repeat('ü', 15) WHEN {E} % 4 = 1 THEN repeat('ü', 16) ELSE 'two words' END"],
        },
        map_values={"metadata": [f"CASE WHEN {E} % 10 = 3 THEN 'the PassWord is x' ELSE 'v' END", "'plain'"]},
    ),
    warnings=[
        (f"$timestamp - {NOW} > 300", "FUTURE_TIMESTAMP"),
        (f"{NOW} - $timestamp > 8760 * 3600", "OLD_TIMESTAMP"),
        ("$checksum <> '' AND $data# <= 0", "CHECKSUM_WITHOUT_DATA"),
        ("$data# > 100", "LARGE_DATA_PAYLOAD"),
        ("$data# <= 0 AND $type NOT IN ('heartbeat', 'ping')", "EMPTY_DATA"),
        ("$metadata# > 0 AND (contains(lower($metadata.0), 'token') OR contains(lower($metadata=0), 'password'))", "SENSITIVE_METADATA"),
        ("$metadata# > 50", "EXCESSIVE_METADATA"),
        ("$priority = 'critical' AND $status = 'pending'", "CRITICAL_PENDING"),
        ("$priority = 'low' AND $status = 'failed'", "LOW_PRIORITY_FAILED"),
        ("$priority IN ('urgent', 'critical') AND $status = 'completed'", "HIGH_PRIORITY_COMPLETED"),
        ("($tags# >= 2 AND $tags.0 = $tags.1) OR ($tags# >= 3 AND $tags.1 = $tags.2)", "DUPLICATE_TAGS"),
        ("$tags# > 20", "EXCESSIVE_TAGS"),
        ("$tags# >= 2 AND contains($tags.1, ' ')", "SPACED_TAG"),
        ("$tags# >= 3 AND contains($tags.2, ' ')", "SPACED_TAG"),
        ("$tags# >= 3 AND strlen($tags.2) > 30", "LONG_TAG"),
    ],
    field_count="10 + greatest($data#, 0) + greatest($metadata#, 0) + greatest($tags#, 0)",
)

G = "page_id"
API_CALL = Model(
    generic.API_MODEL, "pages", G,
    Spec(
        values={
            "method": f"CASE {G} % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'DELETE' ELSE CASE WHEN {G} % 3 = 0 THEN 'FETCH' ELSE 'HEAD' END END",
            "url": f"CASE WHEN {G} % 11 = 0 THEN replace(url, '://', '') ELSE url END",
            "body": f"CASE WHEN {G} % 2 = 0 THEN html END",
            "status_code": f"CASE {G} % 3 WHEN 0 THEN 200 WHEN 1 THEN 201 ELSE CASE WHEN {G} % 31 = 0 THEN 99 ELSE 404 END END",
            "response": f"CASE WHEN {G} % 4 < 2 THEN '{{}}' END",
            "duration": f"CASE {G} % 6 WHEN 0 THEN 5000000000 WHEN 1 THEN 5000000001 ELSE {G} * 1000000 END",
            "remote_ip": f"CASE WHEN {G} % 13 = 0 THEN '10.0.0.999' ELSE '10.0.0.' || ({G} % 200) END",
        },
        sizes={"headers": f"{G} % 3", "parameters": f"CASE WHEN {G} % 17 = 0 THEN 21 WHEN {G} % 19 = 0 THEN 20 ELSE {G} % 4 - 1 END"},
        items={"parameters": [f"CASE {G} % 5 WHEN 1 THEN 'Session_TOKEN' WHEN 2 THEN 'api_key' ELSE 'q' END"]},
    ),
    warnings=[
        ("$method = 'GET' AND $body IS NOT NULL", "GET_WITH_BODY"),
        ("$method IN ('POST', 'PUT') AND $body IS NULL", "MISSING_BODY"),
        ("$method = 'DELETE' AND $body IS NOT NULL", "DELETE_WITH_BODY"),
        ("$method = 'POST' AND $status_code = 200", "POST_WRONG_STATUS"),
        ("$method = 'PUT' AND $status_code = 200", "PUT_STATUS_AMBIGUOUS"),
        ("$method = 'DELETE' AND $status_code = 200 AND $response IS NOT NULL", "DELETE_WITH_RESPONSE"),
        ("lower($url) LIKE 'http://%'", "INSECURE_HTTP"),
        ("$parameters# > 0 AND contains(lower($parameters.0), 'token')", "SENSITIVE_QUERY_PARAM"),
        ("$duration > 5000000000", "SLOW_API_RESPONSE"),
        ("$parameters# > 20", "LARGE_PARAMETER_SET"),
    ],
    field_count="12 + greatest($headers#, 0) + greatest($parameters#, 0)",
)

REQUEST = Model(
    api.REQUEST, "pages", G,
    Spec(
        values={
            "method": f"CASE {G} % 6 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'DELETE' WHEN 4 THEN 'PATCH' ELSE 'TRACE' END",
            "url": f"CASE WHEN {G} % 23 = 0 THEN '/relative/' || {G} ELSE url END",
            "request_id": f"CASE WHEN {G} % 3 > 0 THEN 'req-' || {G} END",
            "user_agent": f"CASE {G} % 5 WHEN 0 THEN 'ExampleBot/1.0 (web crawler)' WHEN 1 THEN 'Port-SCANNER' ELSE 'Mozilla/5.0' END",
            "remote_ip": f"CASE {G} % 7 WHEN 0 THEN '2001:db8::' || ({G} % 99) ELSE '192.168.0.' || ({G} % 250) END",
            "content_type": f"CASE {G} % 4 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/html; charset=utf-8' WHEN 2 THEN CASE WHEN {G} % 29 = 0 THEN 'json' END END",
            "timeout": f"CASE {G} % 8 WHEN 0 THEN 61 WHEN 1 THEN 60 WHEN 2 THEN CASE WHEN {G} % 31 = 0 THEN 0 ELSE 300 END END",
            "retry_count": f"{G} % 11",
            "source": f"CASE {G} % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'web' END",
            "version": f"CASE {G} % 3 WHEN 0 THEN 'v1.2' WHEN 1 THEN '2023-01-01' END",
            "authorization.type": "'Bearer'", "authorization.token": f"md5(url)",
            "authorization.issuer": f"CASE WHEN {G} % 37 = 0 THEN 'nobody' END",
            "rate_limit.limit": "100", "rate_limit.remaining": f"{G} % 60", "rate_limit.window": "'minute'",
            "rate_limit.reset": f"{NOW} + ({G} % 4) * 30",
        },
        sizes={
            "headers": f"{G} % 3", "path_params": f"{G} % 2",
            "query_params": f"CASE WHEN {G} % 17 = 0 THEN 21 WHEN {G} % 19 = 0 THEN 20 ELSE {G} % 4 - 1 END",
        },
        items={
            "headers": [f"CASE WHEN {G} % 4 = 0 THEN 'If-Match' ELSE 'if-match' END", "'If-Unmodified-Since'"],
            "query_params": [f"CASE {G} % 5 WHEN 1 THEN 'Api_KEY' WHEN 2 THEN 'secret' ELSE 'page' END"],
        },
        present={"authorization": f"{G} % 2 = 0", "rate_limit": f"{G} % 3 = 0"},
    ),
    warnings=[
        ("NOT ($authorization!) AND $source <> 'test'", "MISSING_AUTHORIZATION"),
        ("lower($url) LIKE 'http://%' AND $source <> 'test'", "INSECURE_PROTOCOL"),
        ("$query_params# > 0 AND regexp_matches(lower($query_params.0), 'password|secret|token|key')", "SENSITIVE_QUERY_PARAM"),
        ("regexp_matches(lower($user_agent), 'bot|crawler|spider|scraper|scanner')", "BOT_USER_AGENT"),
        ("coalesce($timeout, 0) > 60", "HIGH_TIMEOUT"),
        ("$retry_count > 5", "HIGH_RETRY_COUNT"),
        ("$query_params# > 20", "LARGE_QUERY_PARAMS"),
        ("$request_id = ''", "MISSING_REQUEST_ID"),
        ("$method IN ('POST', 'PUT', 'PATCH') AND $content_type = ''", "MISSING_CONTENT_TYPE"),
        ("$method IN ('PUT', 'DELETE') AND NOT (($headers# >= 1 AND $headers.0 = 'If-Match') OR $headers# >= 2)",
         "MISSING_CONDITIONAL_HEADERS"),
        ("($rate_limit!) AND $rate_limit.remaining / 100.0 < 0.1", "RATE_LIMIT_WARNING"),
        (f"($rate_limit!) AND $rate_limit.reset - {NOW} < 60 AND $rate_limit.remaining / 100.0 < 0.5", "HIGH_RATE_USAGE"),
    ],
    field_count="15 + greatest($headers#, 0) + greatest($query_params#, 0) + greatest($path_params#, 0)",
)

_HEADERS = "X-Content-Type-Options X-Frame-Options X-XSS-Protection Strict-Transport-Security Location Cache-Control".split()
RESPONSE = Model(
    api.RESPONSE, "events", E,
    Spec(
        values={
            "status_code": f"CASE {E} % 9 WHEN 0 THEN 301 WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN 499 WHEN 4 THEN CASE WHEN {E} % 53 = 0 THEN 600 ELSE 304 END ELSE 200 END",
            "content_type": f"CASE WHEN {E} % 4 > 0 THEN 'application/json' END",
            "content_length": f"CASE {E} % 5 WHEN 0 THEN 10485760 WHEN 1 THEN 10485761 WHEN 2 THEN CASE WHEN {E} % 59 = 0 THEN -1 ELSE 0 END END",
            "duration": f"CASE {E} % 7 WHEN 0 THEN 5000000000 WHEN 1 THEN 5000000001 WHEN 2 THEN CASE WHEN {E} % 61 = 0 THEN 0 ELSE 7 END ELSE cast(value * 1000 AS bigint) * 1000 + 1 END",
            "cache_status": f"CASE WHEN {E} % 3 = 0 THEN 'hit' END",
            "errors.0.code": "event_type", "errors.0.message": f"'failed at ' || {E}",
            "errors.0.detail": f"CASE WHEN {E} % 6 = 1 THEN 'Bad API Key' ELSE props END",
            "links.0.rel": "'next'", "links.0.href": f"'https://example.com/' || {E}",
            "pagination.page": "1", "pagination.first_page": "1", "pagination.last_page": f"{E} % 9 + 1",
            "pagination.per_page": f"CASE WHEN {E} % 10 = 0 THEN 1000 WHEN {E} % 67 = 0 THEN 1001 ELSE 50 END",
            "pagination.has_next": f"{E} % 2 = 0",
            "pagination.links.first": "'https://example.com/1'", "pagination.links.last": "'https://example.com/9'",
            "pagination.links.self": "'https://example.com/1'",
            "pagination.links.next": f"CASE WHEN {E} % 8 = 0 THEN 'https://example.com/2' END",
        },
        sizes={
            "headers": f"{E} % 8 - 1", "errors": f"CASE WHEN {E} % 3 = 0 THEN -1 ELSE {E} % 2 END",
            "warnings": "-1", "links": f"{E} % 2",
        },
        items={"headers": [f"'{h}'" for h in _HEADERS]},
        present={"pagination": f"{E} % 2 = 0", "pagination.links": f"{E} % 4 = 0"},
    ),
    warnings=[
        ("$status_code >= 400 AND $status_code < 500", "CLIENT_ERROR"),
        ("$status_code >= 500", "SERVER_ERROR"),
        ("$status_code >= 300 AND $status_code < 400 AND $headers# < 5", "MISSING_LOCATION"),
        ("$duration > 5000000000", "SLOW_RESPONSE"),
        ("$content_length > 10485760", "LARGE_RESPONSE"),
        ("$status_code = 200 AND $headers# < 6", "MISSING_CACHE_HEADERS"),
        ("$headers# < 4", "MISSING_SECURITY_HEADERS"),
        ("$status_code >= 400 AND $errors# > 0 AND regexp_matches(lower($errors.0.detail), 'password|token|secret|key')",
         "SENSITIVE_ERROR_DETAIL"),
        ("$content_type = '' AND $status_code = 200", "MISSING_CONTENT_TYPE"),
        ("($pagination!) AND $pagination.has_next AND (NOT ($pagination.links!) OR $pagination.links.next IS NULL)",
         "MISSING_PAGINATION_LINK"),
        ("($pagination!) AND $pagination.per_page > 1000", "LARGE_PAGE_SIZE"),
    ],
    field_count="15 + greatest($headers#, 0) + greatest($errors#, 0) + $links#",
)

D = "doc_id"
_Q = "lower($query)"
QUERY = Model(
    database.QUERY, "documents", D,
    Spec(
        values={
            "operation": f"CASE {D} % 5 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' WHEN 3 THEN 'DELETE' ELSE CASE WHEN {D} % 3 = 0 THEN 'MERGE' ELSE 'CREATE' END END",
            "table": f"CASE WHEN {D} % 41 = 0 THEN NULL ELSE source END", "database": "lang",
            "query": "CASE " + f"{D} % 12" + " WHEN 0 THEN 'SELECT * FROM t WHERE a = 1 ' WHEN 1 THEN 'DELETE FROM t '"
                     " WHEN 2 THEN 'update t set a = 1 ' WHEN 3 THEN 'SELECT a FROM (SELECT b FROM u) WHERE c LIKE ''%x'' '"
                     " WHEN 4 THEN 'DROP TABLE t; GRANT all to x ' WHEN 5 THEN 'CREATE INDEX i; create user y '"
                     " WHEN 6 THEN 'select ssn from p join q having count(*) > 1 ' WHEN 7 THEN 'select 1 /* ok */ union select 2 '"
                     " WHEN 8 THEN 'select a where b = ? group by c ' WHEN 9 THEN 'x'' OR ''1''=''1 ' ELSE '' END || text",
            "prepared_statement": f"{D} % 3 = 0",
            "duration": f"CASE {D} % 5 WHEN 0 THEN 5000000001 WHEN 1 THEN 5000000000 ELSE n_chars * 1000 END",
            "rows_affected": f"CASE {D} % 4 WHEN 0 THEN 100001 WHEN 1 THEN 100000 ELSE {D} END",
            "transaction_id": f"CASE WHEN {D} % 2 = 0 THEN 'tx-' || {D} END",
            "connection_info.port": f"CASE WHEN {D} % 43 = 0 THEN 70000 ELSE 5432 END",
            "execution_plan.estimated_cost": f"CASE {D} % 3 WHEN 0 THEN 1000.0 WHEN 1 THEN 1000.5 ELSE 1.0 END",
            "execution_plan.operations.0.type": f"CASE {D} % 4 WHEN 0 THEN 'Seq Scan' WHEN 1 THEN 'table scan' ELSE 'index scan' END",
            "execution_plan.operations.0.table": "source",
            "execution_plan.indexes.0.name": "'idx'", "execution_plan.indexes.0.table": "source",
            "execution_plan.indexes.0.type": "'btree'", "execution_plan.indexes.0.used": f"{D} % 3 = 0",
            "execution_plan.query_hash": f"CASE WHEN {D} % 47 = 0 THEN 'abc' ELSE md5(text) || md5(lang) END",
            "security.audit_logged": f"{D} % 5 < 3", "security.sensitive": f"{D} % 2 = 0", "security.encryption_used": f"{D} % 3 = 0",
        },
        sizes={"parameters": f"{D} % 3 - 1", "execution_plan.operations": f"{D} % 3", "execution_plan.indexes": f"{D} % 4 - 1"},
        present={"execution_plan": f"{D} % 2 = 0", "security": f"{D} % 3 > 0"},
    ),
    warnings=[
        (has(_Q, "' or '1'='1", "' or 1=1", "union select", "drop table", "delete from", "truncate table", "alter table",
             "create table", "exec ", "execute ", "sp_", "xp_", "--", "/*", "*/"), "SUSPICIOUS_SQL_PATTERNS"),
        (f"NOT $prepared_statement AND $parameters# <= 0 AND NOT {has('$query', '@', '$', '?', ':')} AND {has(_Q, 'where', 'having')}",
         "UNPREPARED_CONDITIONAL_QUERY"),
        (has(_Q, "select *"), "SELECT_ALL_COLUMNS"),
        (f"{has(_Q, 'delete from', 'update ')} AND NOT {has(_Q, 'where')}", "MISSING_WHERE_CLAUSE"),
        (has(_Q, "like '%"), "LEADING_WILDCARD_LIKE"),
        (f"len(string_split({_Q}, 'select')) > 2", "MULTIPLE_SUBQUERIES"),
        ("$duration > 5000000000", "SLOW_QUERY"),
        ("$rows_affected > 100000", "HIGH_ROW_COUNT"),
        (has(_Q, "create user", "drop user", "grant ", "revoke ", "alter user", "create role", "drop role",
             "create database", "drop database"), "ADMIN_OPERATION"),
        (has(_Q, "create table", "drop table", "alter table", "create index", "drop index", "create view", "drop view"),
         "SCHEMA_MODIFICATION"),
        (has(_Q, "password", "secret", "token", "ssn", "credit_card"), "SENSITIVE_DATA_ACCESS"),
        ("($security!) AND NOT $security.audit_logged", "NO_AUDIT_LOG"),
        ("($security!) AND $security.sensitive AND NOT $security.encryption_used", "UNENCRYPTED_SENSITIVE_ACCESS"),
        ("$operation IN ('INSERT', 'UPDATE', 'DELETE') AND $transaction_id = ''", "NO_TRANSACTION_CONTEXT"),
        ("strlen($query) > 10000", "LONG_QUERY_STRING"),
        (f"NOT {has(_Q, '--', '/*')} AND " + " + ".join(
            f"{has(_Q, w)}::int" for w in ["join", "union", "case when", "exists", "group by", "having"]) + " >= 2",
         "UNDOCUMENTED_COMPLEX_QUERY"),
        ("($execution_plan!) AND $execution_plan.estimated_cost > 1000", "HIGH_QUERY_COST"),
        *[(f"($execution_plan!) AND $execution_plan.operations# > {j} AND lower($execution_plan.operations.0.type) IN"
           " ('table scan', 'seq scan')", "TABLE_SCAN") for j in range(2)],
        *[(f"($execution_plan!) AND $execution_plan.indexes# > {j} AND NOT $execution_plan.indexes.{j}.used", "UNUSED_INDEX")
          for j in range(2)],
    ],
    field_count="15 + greatest($parameters#, 0) + CASE WHEN ($execution_plan!) THEN greatest($execution_plan.operations#, 0)"
                " + greatest($execution_plan.indexes#, 0) ELSE 0 END",
)

_DUR = f"cast(o_totalprice AS bigint)"
TRANSACTION = Model(
    database.TRANSACTION, "orders", K,
    Spec(
        values={
            "status": "CASE o_orderstatus WHEN 'F' THEN 'committed' WHEN 'O' THEN 'active' ELSE 'preparing' END",
            "isolation_level": f"CASE {K} % 4 WHEN 0 THEN 'serializable' WHEN 1 THEN 'read_uncommitted' WHEN 2 THEN 'read_committed' ELSE 'repeatable_read' END",
            "start_time": f"{NOW} - 600 - ({K} % 3) + 1",
            "end_time": f"CASE {K} % 5 WHEN 0 THEN {NOW} WHEN 1 THEN {NOW} - 300 - ({K} % 3) + 1 WHEN 2 THEN {NOW} - 1000 END",
            "read_only": f"{K} % 2 = 0", "auto_commit": f"{K} % 3 = 0",
            "queries.0.operation": f"CASE {K} % 3 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'UPDATE' ELSE 'CREATE' END",
            "queries.0.table": "'t'", "queries.0.database": "'d'", "queries.0.query": "'select 1'",
            "queries.0.security.sensitive": f"{K} % 2 = 1",
            "savepoints.0.name": f"'sp' || {K}",
            "locks.0.type": "'shared'", "locks.0.resource": "o_orderpriority", "locks.0.mode": "'row'",
            "locks.0.duration": f"CASE {K} % 3 WHEN 0 THEN 30000000000 ELSE 30000000000 + {_DUR} END",
            "locks.1.type": "'update'", "locks.1.resource": "'r'", "locks.1.mode": "'page'",
            "connection_info.port": "5432",
        },
        sizes={
            "queries": f"({K} + 1) % 4 - 1", "savepoints": f"CASE WHEN {K} % 7 = 0 THEN 11 WHEN {K} % 7 = 1 THEN 10 ELSE {K} % 2 END",
            "locks": f"CASE WHEN {K} % 8 = 0 THEN 6 WHEN {K} % 8 = 4 THEN 5 ELSE {K} % 3 - 1 END",
            "locks.0.blocking": f"{K} % 3 - 1", "locks.1.blocking": "-1",
        },
        items={"locks.0.blocking": [f"'tx' || {K}"]},
        present={"queries.0.security": f"{K} % 3 > 0"},
    ),
    warnings=[
        ("$auto_commit AND $queries# > 1", "AUTOCOMMIT_MULTIPLE_OPS"),
        ("$read_only AND $queries# > 0 AND $queries.0.operation IN ('INSERT', 'UPDATE', 'DELETE')", "WRITE_IN_READONLY"),
        ("$savepoints# > 10", "EXCESSIVE_SAVEPOINTS"),
        ("$locks# > 0 AND $locks.0.blocking# > 0", "BLOCKING_LOCKS"),
        ("$locks# > 0 AND $locks.0.duration > 30000000000", "LONG_HELD_LOCK"),
        ("$isolation_level = 'serializable' AND $locks# > 5", "HIGH_ISOLATION_CONTENTION"),
        ("$isolation_level = 'read_uncommitted' AND $queries# > 0 AND ($queries.0.security!) AND $queries.0.security.sensitive",
         "UNSAFE_ISOLATION_SENSITIVE"),
        ("$end_time IS NOT NULL AND $end_time - $start_time > 300", "LONG_RUNNING_TRANSACTION"),
        (f"$end_time IS NULL AND {NOW} - $start_time > 600", "STALE_TRANSACTION"),
    ],
    field_count="15 + greatest($queries#, 0) + $savepoints# + greatest($locks#, 0)",
)

C = "c_custkey"
_T = "lower($pull_request.title)"
_B = "lower(coalesce($pull_request.body, ''))"
_CH = "($pull_request.additions + $pull_request.deletions)"
_SECURITY = ("password|secret|key|token|credential|auth|security|vulnerability|exploit|backdoor|hardcode")
_MISSING = " + ".join(f"(NOT contains({_B}, '{w}'))::int" for w in "summary changes testing checklist".split())
PULL_REQUEST = Model(
    github.PULL_REQUEST_EVENT, "customer", C,
    Spec(
        values={
            "action": f"CASE {C} % 4 WHEN 0 THEN 'opened' WHEN 1 THEN 'closed' WHEN 2 THEN 'reopened' ELSE CASE WHEN {C} % 23 = 0 THEN 'edited' ELSE 'synchronize' END END",
            "pull_request.title": f"CASE {C} % 9 WHEN 0 THEN 'WIP: ' || c_name WHEN 1 THEN 'Fix Dockerfile for ' || c_mktsegment WHEN 2 THEN 'Temporary draft'"
                                  f" WHEN 3 THEN 'Rotate auth token' WHEN 4 THEN 'Update config' ELSE c_name END",
            "pull_request.body": f"CASE {C} % 6 WHEN 0 THEN NULL WHEN 1 THEN 'short' WHEN 2 THEN 'Summary and changes and more' WHEN 3 THEN 'Nothing of the usual'"
                                 f" WHEN 4 THEN 'Summary only; fixes a vulnerability' ELSE 'summary changes testing checklist' END",
            "pull_request.draft": f"{C} % 5 = 0",
            "pull_request.additions": f"cast(abs(c_acctbal) AS bigint) % 2000", "pull_request.deletions": f"({C} * 37) % 4000",
            "pull_request.changed_files": f"{C} % 60",
            "pull_request.commits": f"CASE WHEN {C} % 29 = 0 THEN 0 ELSE {C} % 25 + 1 END",
            "pull_request.created_at": f"{NOW} - 7 * 86400 - ({C} % 3) + 1",
            "pull_request.updated_at": f"CASE WHEN {C} % 31 = 0 THEN {NOW} - 30 * 86400 ELSE {NOW} END",
            "pull_request.user.login": f"'user-' || ({C} % 5)", "sender.login": f"CASE WHEN {C} % 37 = 0 THEN 'bad--name' ELSE 'user-' || ({C} % 3) END",
            "pull_request.assignees.0.login": f"'user-' || ({C} % 5)",
            "pull_request.labels.0.color": f"CASE WHEN {C} % 41 = 0 THEN 'red' ELSE 'ff00aa' END",
            "pull_request.head.repo.owner.type": f"CASE WHEN {C} % 43 = 0 THEN 'Robot' ELSE 'User' END",
            "repository.fork": f"{C} % 3 = 0", "repository.stargazers_count": f"({C} % 4) * 20", "repository.forks_count": f"{C} % 8",
            "repository.open_issues_count": f"{C} % 203",
        },
        sizes={
            "pull_request.assignees": f"{C} % 3", "pull_request.requested_reviewers": f"CASE WHEN {C} % 4 = 0 THEN -1 ELSE {C} % 2 END",
            "pull_request.requested_teams": f"CASE WHEN {C} % 7 = 0 THEN 1 ELSE 0 END", "pull_request.labels": f"{C} % 2",
        },
        present={"organization": f"{C} % 2 = 0"},
    ),
    warnings=[
        (has(_T, "wip:", "[wip]", "work in progress", "do not merge", "dnm:", "[dnm]", "draft:", "[draft]", "temporary",
             "temp:", "fixup!", "squash!"), "WIP_DETECTED"),
        (f"$pull_request.draft AND NOT {has(_T, 'wip', 'draft')}", "DRAFT_TITLE_MISMATCH"),
        (f"{_CH} > 1000", "LARGE_CHANGESET"),
        ("$pull_request.changed_files > 50", "MANY_FILES_CHANGED"),
        (f"{_CH} > 0 AND $pull_request.deletions / {_CH} > 0.7", "HIGH_DELETION_RATIO"),
        ("coalesce(strlen($pull_request.body), 0) < 10", "MISSING_DESCRIPTION"),
        (f"coalesce(strlen($pull_request.body), 0) >= 10 AND {_MISSING} > 2", "INCOMPLETE_TEMPLATE"),
        (f"regexp_matches({_T}, '{_SECURITY}') OR regexp_matches({_B}, '{_SECURITY}')", "SECURITY_KEYWORDS"),
        (f"$pull_request.changed_files > 0 AND {has(_T, 'dockerfile', 'docker-compose', '.env', 'config')}", "CONFIG_FILE_CHANGES"),
        ("$repository.fork", "FORK_CONTRIBUTION"),
        ("$repository.stargazers_count = 0 AND $repository.forks_count = 0", "LOW_ENGAGEMENT"),
        ("$repository.open_issues_count > 100 AND $repository.stargazers_count < 50", "HIGH_ISSUE_RATIO"),
        ("$pull_request.user.login = $sender.login AND $pull_request.assignees# = 1"
         " AND $pull_request.assignees.0.login = $pull_request.user.login", "SELF_ASSIGNED"),
        (f"greatest($pull_request.requested_reviewers#, 0) = 0 AND $pull_request.requested_teams# = 0"
         f" AND ({_CH} > 100 OR $pull_request.changed_files > 5)", "NO_REVIEWERS"),
        (f"{NOW} - $pull_request.created_at > 7 * 86400", "STALE_PR"),
        ("$pull_request.commits > 20", "MANY_COMMITS"),
    ],
    field_count="50",
)

MODELS = {
    "v1_w01_w05_incidents": INCIDENT,
    "v2_w06_w09_deployments": DEPLOYMENT,
    "v3_w10_w23_generic_payloads": GENERIC,
    "v4_w24_w33_api_calls": API_CALL,
    "v5_w34_w45_api_requests": REQUEST,
    "v6_w46_w56_api_responses": RESPONSE,
    "v7_w57_w75_database_queries": QUERY,
    "v8_w76_w84_database_transactions": TRANSACTION,
    "v9_w85_w100_pull_request_events": PULL_REQUEST,
}


def all_queries() -> list[Query]:
    out = []
    for name, model in MODELS.items():
        out.append(model.row_query(name))
        v, a, b, *_ = name.split("_")
        out.append(model.code_query(f"{a}_{b}_code_counts"))
    return out
