"""General event payloads, generic API call and database records, and the common base record."""

from tamis.functions.scalars import contains_any, duration_text, has_prefix, hours_between, seconds_between, sorted_keys
from tamis.functions.text import count_of
from tamis.plans.ruleset import (
    Check, PerElement, anything, duration, flag, integer, optional, record, records, required, rule_set, text,
    text_map, texts, time, value_map, values,
)

# fixed values: words that hint at secrets
METADATA_SECRETS = ("password", "secret", "token", "key", "credential")
PARAMETER_SECRETS = ("password", "secret", "token")

# fixed values: payload types that may be empty
QUIET_TYPES = ("heartbeat", "ping")

_QUIET = ", ".join(f"'{t}'" for t in QUIET_TYPES)
_DUPLICATES = "filter($tags, (t, i) -> array_position($tags, t) < i + 1)"

GENERIC = rule_set(
    "GenericPayload",
    text("id", optional),
    text("type", required, min=1, max=100),
    text("version", optional, semver=True),
    time("timestamp", required),
    text("source", required, url=True),
    value_map("data", required),
    text_map("metadata", optional),
    texts("tags", optional, each=dict(min=1, max=50)),
    text("priority", optional, priority_level=True),
    text("status", optional, oneof="pending processing completed failed"),
    text("checksum", optional, len=64, hexadecimal=True),
    checks=[
        Check("FUTURE_TIMESTAMP", f"{seconds_between('$now', '$timestamp')} > 300", "Timestamp",
              "Timestamp is in the future: {$timestamp}", "$timestamp",
              "Verify system clock synchronization", "temporal"),
        Check("OLD_TIMESTAMP", f"{hours_between('$timestamp', '$now')} > 8760", "Timestamp",
              "Very old timestamp: {$timestamp}", "$timestamp",
              "Verify if this is historical data or a timestamp error", "temporal"),
        Check("CHECKSUM_WITHOUT_DATA", f"$checksum != '' AND {count_of('$data')} = 0", "Checksum",
              "Checksum provided but data is empty", None,
              "Remove checksum or add data content", "integrity"),
        Check("LARGE_DATA_PAYLOAD", f"{count_of('$data')} > 100", "Data",
              "Large data payload: {size($data)} fields", "size($data)",
              "Consider pagination or data chunking for large payloads", "performance"),
        Check("EMPTY_DATA", f"{count_of('$data')} = 0 AND $type NOT IN ({_QUIET})", "Data",
              "Data field is empty for non-heartbeat payload", None,
              "Verify if payload should contain data", "completeness"),
        Check("SENSITIVE_METADATA",
              f"{contains_any('lower(e)', METADATA_SECRETS)}"
              f" OR {contains_any('lower(coalesce(element_at($metadata, e), ' + chr(39) * 2 + '))', METADATA_SECRETS)}",
              "Metadata", "Potentially sensitive information in metadata: {e}", "e",
              "Avoid storing sensitive information in metadata", "security", each=sorted_keys("$metadata")),
        Check("EXCESSIVE_METADATA", f"{count_of('$metadata')} > 50", "Metadata",
              "Large number of metadata fields: {size($metadata)}", "size($metadata)",
              "Consider consolidating or restructuring metadata", "maintainability"),
        Check("CRITICAL_PENDING", "$priority = 'critical' AND $status = 'pending'", "Priority",
              "Critical priority item still pending", None,
              "Critical items should be processed immediately", "workflow"),
        Check("LOW_PRIORITY_FAILED", "$priority = 'low' AND $status = 'failed'", "Status",
              "Low priority item has failed status", None,
              "Review if failed low priority items need attention", "workflow"),
        Check("HIGH_PRIORITY_COMPLETED", "$status = 'completed' AND $priority IN ('urgent', 'critical')", "Status",
              "High priority item completed successfully", None,
              "Good - high priority items should be completed quickly", "workflow"),
        Check("DUPLICATE_TAGS", f"{count_of('$tags')} > size(array_distinct(coalesce($tags, cast(array() AS ARRAY<STRING>))))",
              "Tags", "Duplicate tags found: {array_join(" + _DUPLICATES + ", ', ')}", _DUPLICATES,
              "Remove duplicate tags", "data-quality"),
        Check("EXCESSIVE_TAGS", f"{count_of('$tags')} > 20", "Tags",
              "Large number of tags: {size($tags)}", "size($tags)",
              "Consider using fewer, more specific tags", "maintainability"),
        PerElement("$tags", (
            Check("SPACED_TAG", "contains(e, ' ')", "Tags", "Tag contains spaces: '{e}'", "e",
                  "Use hyphens or underscores instead of spaces in tags", "data-quality"),
            Check("LONG_TAG", "octet_length(e) > 30", "Tags", "Very long tag: '{e}'", "e",
                  "Use shorter, more concise tags", "maintainability"),
        )),
    ],
    title="GenericValidator",
    model_type="GenericPayload",
    provider="generic_validator",
    style="generic",
    field_count=f"10 + {count_of('$data')} + {count_of('$metadata')} + {count_of('$tags')}",
)

API_MODEL = rule_set(
    "APIModel",
    text("method", required, oneof="GET POST PUT PATCH DELETE HEAD OPTIONS"),
    text("url", required, url=True),
    text_map("headers", optional),
    value_map("parameters", optional),
    anything("body", optional),
    integer("status_code", optional, gte=100, lte=599),
    anything("response", optional),
    time("timestamp", required),
    duration("duration", optional),
    text("user_agent", optional, max=500),
    text("remote_ip", optional, ip=True),
    text("request_id", optional),
    text("trace_id", optional),
    checks=[
        Check("GET_WITH_BODY", "$method = 'GET' AND $body IS NOT NULL", "Body", "GET request contains body", None,
              "GET requests should not contain request body", "http-semantics"),
        Check("MISSING_BODY", "$method IN ('POST', 'PUT') AND $body IS NULL", "Body", "{$method} request missing body",
              None, "POST/PUT requests typically require a request body", "http-semantics"),
        Check("DELETE_WITH_BODY", "$method = 'DELETE' AND $body IS NOT NULL", "Body", "DELETE request contains body",
              None, "DELETE requests typically should not contain body", "http-semantics"),
        Check("POST_WRONG_STATUS", "$method = 'POST' AND $status_code = 200", "StatusCode",
              "POST request returned 200 instead of 201", "$status_code",
              "POST requests should typically return 201 for created resources", "http-semantics"),
        Check("PUT_STATUS_AMBIGUOUS", "$method = 'PUT' AND $status_code = 200", "StatusCode",
              "PUT request returned 200 (update) vs 201 (create)", "$status_code",
              "Consider using 201 for creation, 200 for updates", "http-semantics"),
        Check("DELETE_WITH_RESPONSE", "$method = 'DELETE' AND $status_code = 200 AND $response IS NOT NULL", "Response",
              "DELETE request with response body", None,
              "Consider using 204 No Content for DELETE operations", "http-semantics"),
        Check("INSECURE_HTTP", has_prefix("$url", "http://"), "URL", "API request using insecure HTTP protocol", "$url",
              "Use HTTPS for API requests", "security"),
        Check("SENSITIVE_QUERY_PARAM", contains_any("lower(e)", PARAMETER_SECRETS), "Parameters",
              "Potentially sensitive parameter: {e}", "e",
              "Move sensitive data to request body or headers", "security", each=sorted_keys("$parameters")),
        Check("SLOW_API_RESPONSE", "$duration > 5000000000L", "Duration",
              "Slow API response: {" + duration_text("$duration") + "}", "$duration",
              "Optimize API performance or implement caching", "performance"),
        Check("LARGE_PARAMETER_SET", f"{count_of('$parameters')} > 20", "Parameters",
              "Large number of parameters: {size($parameters)}", "size($parameters)",
              "Consider using request body for complex data", "performance"),
    ],
    title="APIModelValidator",
    model_type="APIModel",
    provider="generic_validator",
    style="generic",
    field_count=f"12 + {count_of('$headers')} + {count_of('$parameters')}",
)

DATABASE_CONNECTION = rule_set(
    "DatabaseConnection",
    text("host", required, hostname=True),
    integer("port", required, gte=1, lte=65535),
    text("database", required, min=1, max=255),
    text("username", required, min=1, max=255),
    text("ssl_mode", optional, oneof="disable allow prefer require"),
    text("connection_pool", optional, min=1, max=255),
    text("connection_id", optional),
    text("driver", optional, oneof="postgres mysql sqlite oracle sqlserver"),
    text("version", optional),
    style="generic",
)
DATABASE_PRIMARY_KEY = rule_set(
    "DatabasePrimaryKey", text("field", required, min=1), text("type", required, min=1), flag("unique"), flag("not_null"),
    style="generic",
)
DATABASE_UNIQUE_CONSTRAINT = rule_set(
    "DatabaseUniqueConstraint", texts("fields", required, each=dict(min=1)), text("name", required, min=1),
    style="generic",
)
DATABASE_FOREIGN_KEY_REFERENCE = rule_set(
    "DatabaseForeignKeyReference", text("table", required, min=1), text("field", required, min=1), style="generic",
)
# fixed values: the list is split at blanks, so SET, NULL, DEFAULT, NO and ACTION are words of their own
REFERENTIAL_ACTIONS = "CASCADE RESTRICT SET NULL SET DEFAULT NO ACTION"
DATABASE_FOREIGN_KEY = rule_set(
    "DatabaseForeignKey",
    text("field", required, min=1),
    record("references", DATABASE_FOREIGN_KEY_REFERENCE, required),
    text("on_delete", optional, oneof=REFERENTIAL_ACTIONS),
    text("on_update", optional, oneof=REFERENTIAL_ACTIONS),
    style="generic",
)
DATABASE_CHECK_CONSTRAINT = rule_set(
    "DatabaseCheckConstraint", text("name", required, min=1), text("condition", required, min=1), style="generic",
)
DATABASE_CONSTRAINTS = rule_set(
    "DatabaseConstraints",
    record("primary_key", DATABASE_PRIMARY_KEY, optional),
    records("unique_constraints", DATABASE_UNIQUE_CONSTRAINT, optional),
    records("foreign_keys", DATABASE_FOREIGN_KEY, optional),
    records("check_constraints", DATABASE_CHECK_CONSTRAINT, optional),
    texts("not_null_fields", optional, each=dict(min=1)),
    text_map("data_types", optional),
    style="generic",
)
DATABASE_INDEX = rule_set(
    "DatabaseIndex",
    text("name", required, min=1),
    texts("fields", required, each=dict(min=1)),
    text("type", required, oneof="btree hash gin gist spgist brin"),
    flag("unique"),
    style="generic",
)
DATABASE_ROLLBACK_INFO = rule_set(
    "DatabaseRollbackInfo", flag("available"), integer("retention_days", optional, gt=0), text("backup_id", optional),
    style="generic",
)
DATABASE_AUDIT_TRAIL = rule_set(
    "DatabaseAuditTrail",
    text("operation_type", required),
    text("performed_by", required, min=1),
    time("performed_at", required),
    text("source_application", optional),
    text("source_ip", optional, ip=True),
    integer("affected_rows", gte=0),
    record("rollback_info", DATABASE_ROLLBACK_INFO, optional),
    value_map("context", optional),
    style="generic",
)
DATABASE_MODEL = rule_set(
    "DatabaseModel",
    text("operation", required, oneof="SELECT INSERT UPDATE DELETE CREATE DROP ALTER"),
    text("table", required, min=1, max=255),
    text("database", required, min=1, max=255),
    text("schema", optional, min=1, max=255),
    text("query", optional, max=10000),
    values("parameters", optional),
    time("timestamp", required),
    duration("duration", optional),
    integer("rows_affected", optional, gte=0),
    text("transaction_id", optional),
    record("connection_info", DATABASE_CONNECTION, required),
    value_map("record_data", optional),
    record("constraints", DATABASE_CONSTRAINTS, optional),
    records("indexes", DATABASE_INDEX, optional),
    record("audit_trail", DATABASE_AUDIT_TRAIL, optional),
    style="generic",
)
BASE_MODEL = rule_set(
    "BaseModel",
    text("id", optional),
    text("type", required, min=1),
    text("version", optional, semver=True),
    time("created_at", required),
    time("updated_at", optional, gtefield="created_at"),
    value_map("metadata", optional),
    texts("tags", optional, each=dict(min=1, max=50)),
    text("status", optional, oneof="active inactive pending archived"),
    style="generic",
)
