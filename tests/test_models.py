"""Golden records per model, decoded from JSON. The evaluation instant is fixed."""

import json

import pytest
from pyspark.sql import functions as F

from tamis import CATALOG, decode, report, validate
from tamis.sources.records import explode_array, record_identifier

AS_OF = "2025-02-01T00:00:00Z"


def incident(i, **changes):
    record = dict(
        id=f"INC-20250104-{i:04d}", title="Payment page shows a blank screen for some users of the shop",
        description="Some users of the shop see a blank screen after they confirm the payment", severity="critical",
        status="open", priority=5, category="bug", environment="production", reported_by="ops@example.com",
        assigned_to="team@example.com", reported_at="2025-01-04T10:00:00Z")
    record.update(changes)
    return {k: v for k, v in record.items() if v is not None}


def request(**changes):
    record = dict(id="API-1", request_id="req-1", url="https://api.example.com/v1/users", method="GET",
                  timestamp="2025-01-04T10:00:00Z", user_agent="Mozilla/5.0", ip_address="192.168.1.100", status_code=200)
    record.update(changes)
    return {k: v for k, v in record.items() if v is not None}


def generic(n, **changes):
    record = dict(type=f"order.step{n}", version="1.0.0", timestamp="2025-01-04T10:00:00Z", source="https://api.example.com",
                  data={"id": str(n)}, status="completed")
    record.update(changes)
    return record


BAD_GENERIC = {"type": "", "version": "", "data": None}


def run(spark, kind, records, mode="strict"):
    df = spark.createDataFrame([(json.dumps(records),)], "value string")
    d = decode(explode_array(df), CATALOG[kind], mode=mode).withColumn("record_identifier", record_identifier())
    return validate(d, CATALOG[kind], as_of=AS_OF, root="record", undecodable="undecodable").orderBy("row_index")


def sizes(v):
    rows = v.select(F.size("errors").alias("e"), F.size("warnings").alias("w")).collect()
    return [r.e for r in rows], [r.w for r in rows]


def test_incidents(spark):
    # each breaks one rule of: title (min), description (min), severity, status, priority (max), time (required); the other also of the environment
    six = incident(71, id="no-incident-1", title="Broken", description="Gone", severity="huge", status="lost", priority=12, reported_at=None)
    seven = incident(72, id="no-incident-2", title="Broken", description="Gone again", severity="tiny", status="found", priority=6, environment="moon", reported_at=None)
    secure = incident(73, category="security", status="investigating")
    v = run(spark, "incident", [incident(70), incident(74, severity="high", priority=4), six, seven, secure])
    assert sizes(v) == ([0, 0, 6, 7, 0], [1, 1, 0, 0, 2])
    rows = v.collect()
    assert [e.field for e in rows[3].errors] == ["Title", "Description", "Severity", "Status", "Priority", "Environment", "ReportedAt"]
    assert rows[2].errors[4].message == "Field must be at most 5"
    assert rows[0].warnings[0].message == "Incident has been open for 662.0 hours"
    assert [r.record_identifier for r in rows] == ["INC-20250104-0070", "INC-20250104-0074", "no-incident-1", "no-incident-2", "INC-20250104-0073"]
    r = report(v, 80.0).first()
    assert (r.status, r.success_rate, r.total_tests_ran, r.warning_records) == ("failed", 60.0, 2, 3)
    assert r.successful_test_names == ["IncidentValidator:STALE_INCIDENT"]
    assert r.failed_test_names == ["IncidentValidator:VALIDATION_FAILED"]


def test_incident_errors_that_follow_the_field_rules(spark):
    v = run(spark, "incident", [incident(1, id="INC-001", priority=1), incident(2, status="in_progress", id="INC-001")])
    rows = v.collect()
    assert [e.code for e in rows[0].errors] == ["INVALID_ID_FORMAT", "PRIORITY_SEVERITY_MISMATCH"]
    assert rows[0].errors[1].message == "priority 1 is inconsistent with severity 'critical' (expected: [4 5])"
    assert rows[0].errors[1].value == "priority=1, severity=critical"
    assert [e.code for e in rows[1].errors] == ["VALIDATION_FAILED"]
    # warnings are given for invalid incidents too
    assert [w.code for w in rows[0].warnings] == ["PRODUCTION_LOW_PRIORITY", "STALE_INCIDENT"]


def test_missing_time_is_very_old(spark):
    v = run(spark, "incident", [incident(1, reported_at=None)])
    assert v.first().warnings[0].message == "Incident has been open for 2562047.8 hours"


def test_requests(spark):
    wrong = request(method="FETCH", url="no address", timestamp=None)
    v = run(spark, "api", [request(method="POST"), wrong, wrong, request()])
    assert sizes(v) == ([0, 3, 3, 0], [2, 0, 0, 1])
    rows = v.collect()
    assert [(e.field, e.code) for e in rows[1].errors] == [("Method", "oneof"), ("URL", "url"), ("Timestamp", "required")]
    assert rows[1].errors[1].path == "APIRequest.URL"
    assert rows[1].errors[1].message == "Field 'URL' must be a valid URL format"
    assert rows[1].test_name == "ApiValidator:oneof"
    assert report(v, 80.0).first().status == "failed"
    methods = run(spark, "api", [request(method=m) for m in ("POST", "GET", "PUT", "DELETE")])
    assert sizes(methods) == ([0] * 4, [2, 1, 3, 2])


def test_generic(spark):
    v = run(spark, "generic", [generic(1), generic(2), BAD_GENERIC])
    assert sizes(v) == ([0, 0, 4], [0, 0, 0])
    r = report(v).first()
    assert (r.status, round(r.success_rate, 2)) == ("success", 66.67)
    assert (r.successful_test_names, r.failed_test_names) == (["GenericValidator"], ["GenericValidator:required"])
    assert [x.record_identifier for x in v.collect()] == ["row_0", "row_1", "row_2"]


def test_generic_checks_in_detail(spark):
    v = run(spark, "generic", [generic(
        1, metadata={"b_token": "x", "a": "the Secret", "c": "plain"}, tags=["x y", "x y", "ü" * 16], data={}, checksum="a" * 64)])
    assert [(w.code, w.value) for w in v.first().warnings] == [
        ("CHECKSUM_WITHOUT_DATA", None), ("EMPTY_DATA", None), ("SENSITIVE_METADATA", "a"), ("SENSITIVE_METADATA", "b_token"),
        ("DUPLICATE_TAGS", "[x y]"), ("SPACED_TAG", "x y"), ("SPACED_TAG", "x y"), ("LONG_TAG", "ü" * 16)]


@pytest.mark.parametrize("kind, record, count, code", [
    ("generic", BAD_GENERIC, 4, "required"),
    # nothing but wrong or empty values: every field rule of the kind is broken
    ("incident", {"id": "", "title": "", "description": "few", "severity": "huge", "status": "lost", "priority": 17,
                  "category": "weather"}, 10, "VALIDATION_FAILED"),
    ("api", {"path": "", "method": "FETCH", "status_code": 7000}, 3, "oneof"),
    ("api", {"method": "GET", "timestamp": "2025-01-04T10:00:00Z"}, 1, "required"),
    ("deployment", {"application": "", "version": "", "status": "halfway"}, 9, "VALIDATION_FAILED"),
    ("deployment", {"application": "shop", "version": "v1.0.0", "environment": "production", "status": "success",
                    "deployed_by": "ci", "deployed_at": "2025-01-04T10:00:00Z"}, 7, "VALIDATION_FAILED"),
    ("database", {"query": "", "database": ""}, 10, "required"),
    ("database", {"query": "SELECT 1", "database": "shop", "rows_affected": 1, "timestamp": "2025-01-04T10:00:00Z"}, 7, "required"),
    ("github", {"action": "", "repository": "", "sender": ""}, 1, "JSON_UNMARSHAL_ERROR"),
])
def test_invalid_records(spark, kind, record, count, code):
    row = run(spark, kind, [record]).first()
    assert (row.is_valid, len(row.errors), row.errors[0].code, row.warnings) == (False, count, code, [])
    title = f"{kind.title()}Validator"
    assert row.test_name == (title if code == "JSON_UNMARSHAL_ERROR" else f"{title}:{code}")


def test_nested_paths_and_recursion(spark):
    deep = {"type": "scan", "children": [{"type": "", "join": {"type": "HASH", "condition": "a"}}]}
    row = run(spark, "database", [{"execution_plan": {"operations": [{"type": "x"}, deep]}}]).first()
    nested = {e.path: e.code for e in row.errors if "Operations" in e.path}
    assert nested == {
        "DatabaseQuery.ExecutionPlan.Operations[1].Children[0].Type": "required",
        "DatabaseQuery.ExecutionPlan.Operations[1].Children[0].Join.Type": "oneof"}


def nested(depth, step, below, value):
    """A structure nested ``depth`` times, the innermost of which is ``value``."""
    out = value
    for _ in range(depth):
        out = {**step, below: [out] if below == "children" else out}
    return out


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 12, 40])
def test_plans_nest_to_any_depth(spark, depth):
    good = nested(depth, {"type": "x"}, "children", {"type": "x"})
    bad = nested(depth, {"type": "x"}, "children", {"type": "", "rows": -1, "join": {"type": "odd", "condition": "c"}})
    wrong = nested(depth, {"type": "x"}, "children", {"type": 5})
    odd = nested(depth, {"type": "x"}, "children", {"type": "x", "children": {"type": "x"}})
    plans = [{"execution_plan": {"operations": [p]}} for p in (good, bad, wrong, odd)]
    rows = [[(e.path, e.code) for e in r.errors if e.path is None or "Operations" in e.path] for r in run(spark, "database", plans).collect()]
    path = "DatabaseQuery.ExecutionPlan.Operations[0]" + ".Children[0]" * depth
    assert rows[0] == []
    assert rows[1] == [(f"{path}.Type", "required"), (f"{path}.Rows", "gte"), (f"{path}.Join.Type", "oneof")]
    assert rows[2] == rows[3] == [(None, "JSON_UNMARSHAL_ERROR")]


def test_deep_errors_come_in_the_order_of_their_paths(spark):
    leaf = {"type": ""}
    plan = nested(3, {"type": "x"}, "children", {"type": "", "children": [leaf, {"type": "", "children": [leaf, None]}, {"type": "y", "cost": -1}]})
    row = run(spark, "database", [{"execution_plan": {"operations": [plan]}}]).first()
    top = "DatabaseQuery.ExecutionPlan.Operations[0]" + ".Children[0]" * 3
    assert [e.path for e in row.errors if "Operations" in e.path] == [
        f"{top}.Type", f"{top}.Children[0].Type", f"{top}.Children[1].Type", f"{top}.Children[1].Children[0].Type", f"{top}.Children[1].Children[1].Type", f"{top}.Children[2].Cost"]


@pytest.mark.parametrize("depth", [1, 4, 15])
def test_schemas_and_teams_nest_to_any_depth(spark, depth):
    from tamis.models.api import SCHEMA
    from tamis.models.github import TEAM
    from tamis.operators.validate import validate
    from tamis.sources.decode import decode

    def errors(rules, record):
        import json
        df = decode(spark.createDataFrame([(json.dumps(record),)], "value string"), rules)
        return [(e.field, e.code) for e in validate(df, rules, root="record", undecodable="undecodable").first().errors]

    assert errors(SCHEMA, nested(depth, {"type": "array"}, "items", {"type": "string"})) == []
    # the fields declared after the nested one are reported after what is nested
    two = errors(SCHEMA, nested(depth, {"type": "array", "required": [""]}, "items", {"type": "odd", "min_length": -1}))
    assert [f for f, _ in two] == ["Type", "MinLength"] + ["Required[0]"] * depth
    assert errors(SCHEMA, nested(depth, {"type": "array"}, "items", {"type": 1}))[0][1] == "JSON_UNMARSHAL_ERROR"
    team = {"id": 1, "node_id": "n", "url": "http://a.b/", "html_url": "http://a.b/", "name": "n", "slug": "s", "privacy": "closed", "permission": "pull",
            "members_url": "http://a.b/", "repositories_url": "http://a.b/"}
    assert errors(TEAM, nested(depth, team, "parent", team)) == []
    assert [f for f, _ in errors(TEAM, nested(depth, team, "parent", {**team, "id": 0, "privacy": "open"}))] == ["ID", "Privacy"]


def test_empty_input(spark):
    v = run(spark, "generic", [])
    r = report(v, 50.0).first()
    assert (r.total_records, r.success_rate, r.status, r.successful_test_names) == (0, 0.0, "failed", [])
    assert report(v).first().status == "success"
