"""HTTP requests, responses and the descriptions of an HTTP interface."""

from tamis.functions.scalars import (
    contains_any, duration_text, first_contained, has_key, has_prefix, ratio, seconds_between, sorted_keys,
)
from tamis.functions.text import count_of, quote
from tamis.plans.ruleset import (
    Check, RuleSet, anything, deep, duration, flag, integer, optional, real, record, records, required, rule_set, text,
    text_map, texts, time, value_map, values,
)

# fixed values: word lists
METHODS = "GET POST PUT PATCH DELETE HEAD OPTIONS"
AUTH_TYPES = "Bearer Basic ApiKey OAuth JWT"
QUERY_SECRETS = ("password", "secret", "token", "key")
DETAIL_SECRETS = ("password", "token", "secret", "key")
BOT_WORDS = ("bot", "crawler", "spider", "scraper", "scanner")
SECURITY_HEADERS = ("X-Content-Type-Options", "X-Frame-Options", "X-XSS-Protection", "Strict-Transport-Security")

AUTHORIZATION = rule_set(
    "APIAuthorization",
    text("type", required, oneof=AUTH_TYPES),
    text("token", required, min=1),
    text("scheme", optional),
    text("realm", optional),
    texts("scope", optional, each=dict(min=1)),
    time("expires_at", optional, nullable=True),
    text("issuer", optional, url=True),
    texts("audience", optional, each=dict(min=1)),
    text("subject", optional, min=1),
    value_map("claims", optional),
    text("algorithm", optional, oneof="HS256 HS384 HS512 RS256 RS384 RS512 ES256 ES384 ES512"),
    style="api",
)
RATE_LIMIT = rule_set(
    "APIRateLimit",
    integer("limit", required, gt=0),
    integer("remaining", gte=0),
    time("reset", required),
    text("window", required, oneof="second minute hour day month"),
    text("policy", optional, oneof="sliding_window fixed_window token_bucket"),
    integer("retry_after", optional, nullable=True, label="Retry", gt=0),
    style="api",
)

_REMAINING = ratio("$rate_limit.remaining", "$rate_limit.limit")
_NO_CONDITION = f"NOT {has_key('$headers', 'If-Match')} AND NOT {has_key('$headers', 'If-Unmodified-Since')}"

REQUEST = rule_set(
    "APIRequest",
    text("method", required, oneof=METHODS + " TRACE CONNECT"),
    text("url", required, url=True),
    text_map("headers", optional),
    value_map("query_params", optional),
    text_map("path_params", optional),
    anything("body", optional),
    time("timestamp", required),
    text("request_id", optional, min=1, max=255),
    text("user_agent", optional, max=1000),
    text("remote_ip", optional, ip=True),
    text("content_type", optional, api_content_type=True),
    text("accept", optional),
    record("authorization", AUTHORIZATION, optional, nullable=True),
    record("rate_limit", RATE_LIMIT, optional, nullable=True),
    integer("timeout", optional, nullable=True, gt=0, lte=300),
    integer("retry_count", gte=0, lte=10),
    text("source", optional, oneof="web mobile api cli automation test"),
    text("version", optional, api_version=True),
    text("trace_id", optional),
    text("span_id", optional),
    checks=[
        Check("MISSING_AUTHORIZATION", "$authorization IS NULL AND $source != 'test'", "Authorization",
              "API request missing authorization header", None,
              "Include appropriate authorization for authenticated endpoints", "security"),
        Check("INSECURE_PROTOCOL", f"{has_prefix('$url', 'http://')} AND $source != 'test'", "URL",
              "API request using insecure HTTP protocol", "$url", "Use HTTPS for production API requests", "security"),
        Check("SENSITIVE_QUERY_PARAM", contains_any("lower(e)", QUERY_SECRETS), "QueryParams",
              "Potentially sensitive parameter in query string: {e}", "e",
              "Move sensitive data to request body or headers", "security", each=sorted_keys("$query_params")),
        Check("BOT_USER_AGENT", contains_any("lower($user_agent)", BOT_WORDS), "UserAgent",
              "Bot-like user agent detected: {" + first_contained("lower($user_agent)", BOT_WORDS) + "}", "$user_agent",
              "Implement appropriate bot handling and rate limiting", "security"),
        Check("HIGH_TIMEOUT", "coalesce($timeout, 0) > 60", "Timeout", "Very high timeout value: {$timeout} seconds",
              "$timeout", "Consider optimizing request or using asynchronous processing", "performance"),
        Check("HIGH_RETRY_COUNT", "$retry_count > 5", "RetryCount", "High retry count: {$retry_count}", "$retry_count",
              "Consider exponential backoff and circuit breaker patterns", "performance"),
        Check("LARGE_QUERY_PARAMS", f"{count_of('$query_params')} > 20", "QueryParams",
              "Large number of query parameters: {size($query_params)}", "size($query_params)",
              "Consider using request body for complex data", "performance"),
        Check("MISSING_REQUEST_ID", "$request_id = ''", "RequestID", "Missing request ID for tracing", None,
              "Include unique request ID for debugging and tracing", "observability"),
        Check("MISSING_CONTENT_TYPE", "$method IN ('POST', 'PUT', 'PATCH') AND $content_type = ''", "ContentType",
              "Missing content type for request with body", None,
              "Specify appropriate content type for requests with body", "api-design"),
        Check("MISSING_CONDITIONAL_HEADERS", f"$method IN ('PUT', 'DELETE') AND {_NO_CONDITION}", "Headers",
              "Idempotent operation missing conditional headers", None,
              "Include If-Match or If-Unmodified-Since for safe idempotent operations", "api-design"),
        Check("RATE_LIMIT_WARNING", f"$rate_limit IS NOT NULL AND {_REMAINING} < 0.1D", "RateLimit.Remaining",
              "Approaching rate limit: {$rate_limit.remaining}/{$rate_limit.limit} remaining", "$rate_limit.remaining",
              "Implement rate limiting handling and consider request throttling", "rate-limiting"),
        Check("HIGH_RATE_USAGE",
              f"$rate_limit IS NOT NULL AND {seconds_between('$now', '$rate_limit.reset')} < 60 AND {_REMAINING} < 0.5D",
              "RateLimit.Reset", "High rate limit usage with short reset window", None,
              "Consider implementing request queuing or backoff strategies", "rate-limiting"),
    ],
    title="ApiValidator",
    model_type="APIRequest",
    provider="api_validator",
    style="api",
    field_count=f"15 + {count_of('$headers')} + {count_of('$query_params')} + {count_of('$path_params')}",
)

API_ERROR = rule_set(
    "APIError",
    text("code", required, min=1, max=100),
    text("message", required, min=1, max=1000),
    text("detail", optional, max=5000),
    text("field", optional, min=1, max=255),
    anything("value"),
    text("constraint", optional, max=500),
    text("path", optional, max=1000),
    time("timestamp", required),
    text("request_id", optional, min=1, max=255),
    text("trace_id", optional),
    value_map("context", optional),
    texts("suggestions", optional, each=dict(min=1, max=500)),
    text("docs_url", optional, url=True),
    style="api",
)
API_WARNING = rule_set(
    "APIWarning",
    text("code", required, min=1, max=100),
    text("message", required, min=1, max=1000),
    text("detail", optional, max=5000),
    text("field", optional, min=1, max=255),
    anything("value"),
    time("timestamp", required),
    value_map("context", optional),
    text("docs_url", optional, url=True),
    style="api",
)
LINK = rule_set(
    "APILink",
    text("rel", required, min=1, max=100),
    text("href", required, url=True),
    text("method", optional, oneof=METHODS),
    text("type", optional, api_content_type=True),
    text("title", optional, max=255),
    text("description", optional, max=1000),
    flag("templated"),
    style="api",
)
PAGINATION_LINKS = rule_set(
    "APIPaginationLinks",
    text("first", required, url=True),
    text("last", required, url=True),
    text("next", optional, nullable=True, url=True),
    text("previous", optional, nullable=True, url=True),
    text("self", required, url=True),
    style="api",
)
PAGINATION = rule_set(
    "APIPagination",
    integer("page", required, gte=1),
    integer("per_page", required, gte=1, lte=1000),
    integer("total", gte=0),
    integer("total_pages", gte=0),
    flag("has_next"),
    flag("has_previous"),
    integer("next_page", optional, nullable=True, gt=0),
    integer("previous_page", optional, nullable=True, gt=0),
    integer("first_page", required, eq=1),
    integer("last_page", required, gte=1),
    record("links", PAGINATION_LINKS, optional, nullable=True),
    style="api",
)

_MISSING_SECURITY = "concat_ws(', ', " + ", ".join(
    f"if({has_key('$headers', h)}, NULL, {quote(h)})" for h in SECURITY_HEADERS) + ")"

RESPONSE = rule_set(
    "APIResponse",
    integer("status_code", required, gte=100, lte=599),
    text_map("headers", optional),
    anything("body", optional),
    text("content_type", optional, api_content_type=True),
    integer("content_length", optional, nullable=True, gte=0),
    time("timestamp", required),
    duration("duration", required, gt=0),
    text("request_id", optional, min=1, max=255),
    text("trace_id", optional),
    text("span_id", optional),
    text("cache_status", optional, oneof="hit miss bypass"),
    text("server_id", optional),
    text("version", optional, api_version=True),
    records("errors", API_ERROR, optional),
    records("warnings", API_WARNING, optional),
    value_map("metadata", optional),
    records("links", LINK, optional),
    record("pagination", PAGINATION, optional, nullable=True),
    checks=[
        Check("CLIENT_ERROR", "$status_code BETWEEN 400 AND 499", "StatusCode", "Client error response: {$status_code}",
              "$status_code", "Review request parameters and authentication", "http-status"),
        Check("SERVER_ERROR", "$status_code >= 500", "StatusCode", "Server error response: {$status_code}",
              "$status_code", "Check server health and implement retry logic", "http-status"),
        Check("MISSING_LOCATION", f"$status_code BETWEEN 300 AND 399 AND NOT {has_key('$headers', 'Location')}",
              "Headers", "Redirect response missing Location header", "$status_code",
              "Include Location header for redirect responses", "http-headers"),
        Check("SLOW_RESPONSE", "$duration > 5000000000L", "Duration",
              "Slow response time: {" + duration_text("$duration") + "}", "$duration",
              "Optimize API performance or consider caching", "performance"),
        Check("LARGE_RESPONSE", "coalesce($content_length, 0) > 10 * 1024 * 1024", "ContentLength",
              "Large response body: {$content_length} bytes", "$content_length",
              "Consider pagination or response compression", "performance"),
        Check("MISSING_CACHE_HEADERS",
              f"$status_code = 200 AND NOT {has_key('$headers', 'Cache-Control')} AND NOT {has_key('$headers', 'ETag')}",
              "Headers", "Cacheable response missing cache headers", None,
              "Include Cache-Control, ETag, or Last-Modified headers", "performance"),
        Check("MISSING_SECURITY_HEADERS", "NOT (" + " AND ".join(has_key("$headers", h) for h in SECURITY_HEADERS) + ")",
              "Headers", "Missing security headers: {" + _MISSING_SECURITY + "}", None,
              "Include security headers to protect against common attacks", "security"),
        Check("SENSITIVE_ERROR_DETAIL",
              "$status_code >= 400 AND coalesce(exists($errors, e -> "
              + contains_any("lower(coalesce(e.detail, ''))", DETAIL_SECRETS) + "), false)",
              "Errors.Detail", "Error message may contain sensitive information", None,
              "Sanitize error messages to avoid exposing sensitive data", "security"),
        Check("MISSING_CONTENT_TYPE", "$content_type = '' AND $status_code = 200", "ContentType",
              "Response missing content type", None, "Include appropriate content type header", "http-headers"),
        Check("MISSING_PAGINATION_LINK", "$pagination.has_next AND $pagination.links.next IS NULL",
              "Pagination.Links.Next", "Pagination indicates next page but missing next link", None,
              "Include pagination links for better API navigation", "api-design"),
        Check("LARGE_PAGE_SIZE", "$pagination.per_page > 1000", "Pagination.PerPage",
              "Very large page size: {$pagination.per_page}", "$pagination.per_page",
              "Consider smaller page sizes for better performance", "performance"),
    ],
    title="ApiresponseValidator",
    model_type="APIResponse",
    provider="api_validator",
    style="api",
    field_count=(f"15 + {count_of('$headers')} + {count_of('$errors')} + {count_of('$warnings')}"
                 f" + {count_of('$links')}"),
)

WEBHOOK_RESPONSE = rule_set(
    "APIWebhookResponse",
    integer("status_code", required, gte=100, lte=599),
    text_map("headers", optional),
    text("body", optional),
    duration("duration", required, gt=0),
    time("timestamp", required),
    flag("success"),
    text("error", optional),
    integer("attempt", required, gte=1, lte=10),
    style="api",
)
WEBHOOK = rule_set(
    "APIWebhook",
    text("id", required, min=1, max=255),
    text("url", required, url=True),
    texts("events", required, min=1, each=dict(min=1, max=100)),
    text("secret", optional, min=8, max=255),
    text("content_type", required, oneof="application/json application/x-www-form-urlencoded"),
    flag("active"),
    flag("ssl"),
    time("created_at", required),
    time("updated_at", required, gtefield="created_at"),
    time("last_delivery", optional, nullable=True),
    record("last_response", WEBHOOK_RESPONSE, optional, nullable=True),
    value_map("config", optional),
    text_map("headers", optional),
    integer("timeout", optional, gt=0, lte=30),
    integer("retries", optional, gte=0, lte=5),
    style="api",
)
ENDPOINT_AUTH = rule_set(
    "APIEndpointAuth",
    flag("required"),
    texts("types", optional, each=dict(oneof=AUTH_TYPES)),
    texts("scopes", optional, each=dict(min=1)),
    style="api",
)
PARAMETER = rule_set(
    "APIParameter",
    text("name", required, min=1, max=255),
    text("in", required, oneof="query header path cookie"),
    text("description", optional, max=1000),
    flag("required"),
    text("type", required, oneof="string number integer boolean array object"),
    text("format", optional),
    text("pattern", optional),
    integer("min_length", optional, nullable=True, gte=0),
    integer("max_length", optional, nullable=True, gte=0),
    real("minimum", nullable=True),
    real("maximum", nullable=True),
    values("enum", optional),
    anything("default"),
    anything("example"),
    style="api",
)
REQUEST_BODY = rule_set(
    "APIRequestBody",
    text("description", optional, max=1000),
    flag("required"),
    value_map("content", required, min=1),  # media types by name; map values are not descended into
    style="api",
)
EXAMPLE = rule_set(
    "APIExample",
    text("summary", optional, max=255),
    text("description", optional, max=1000),
    anything("value", required),
    text("external_value", optional, url=True),
    style="api",
)


SCHEMA_STEP = rule_set(
    "APISchema",
    text("type", optional, oneof="string number integer boolean array object null"),
    text("format", optional),
    text("pattern", optional),
    integer("min_length", optional, nullable=True, gte=0),
    integer("max_length", optional, nullable=True, gte=0),
    real("minimum", nullable=True),
    real("maximum", nullable=True),
    values("enum", optional),
    value_map("properties", optional),  # map values are not descended into
    texts("required", optional, each=dict(min=1)),
    text("description", optional, max=1000),
    anything("example"),
    anything("default"),
    flag("read_only"),
    flag("write_only"),
    flag("deprecated"),
    style="api",
)
BEFORE_ITEMS = 9


def schema_rules(levels: int = 1) -> RuleSet:
    """A JSON schema description; ``items`` nests to any depth, of which ``levels`` are unrolled into structs."""
    items = (record("items", schema_rules(levels - 1), optional, nullable=True) if levels
             else deep("items", SCHEMA_STEP, BEFORE_ITEMS))
    fields = SCHEMA_STEP.fields
    return SCHEMA_STEP.with_(name=f"APISchema{levels}", fields=(*fields[:BEFORE_ITEMS], items, *fields[BEFORE_ITEMS:]))


SCHEMA = schema_rules().with_(name="APISchema")
MEDIA_TYPE = rule_set(
    "APIMediaType",
    record("schema", SCHEMA, optional, nullable=True),
    anything("example"),
    value_map("examples", optional),
    value_map("encoding", optional),
    style="api",
)
RESPONSE_SPEC = rule_set(
    "APIResponseSpec",
    text("description", required, min=1, max=1000),
    value_map("headers", optional),
    value_map("content", optional),
    value_map("links", optional),
    style="api",
)
ENCODING = rule_set(
    "APIEncoding",
    text("content_type", optional, api_content_type=True),
    value_map("headers", optional),
    text("style", optional, oneof="form simple spaceDelimited pipeDelimited deepObject"),
    flag("explode"),
    flag("allow_reserved"),
    style="api",
)
ENDPOINT = rule_set(
    "APIEndpoint",
    text("path", required, min=1, max=1000),
    text("method", required, oneof=METHODS),
    text("version", optional, api_version=True),
    text("description", optional, max=1000),
    texts("tags", optional, each=dict(min=1, max=50)),
    flag("deprecated"),
    flag("public"),
    record("rate_limit", RATE_LIMIT, optional, nullable=True),
    record("auth", ENDPOINT_AUTH, optional, nullable=True),
    records("parameters", PARAMETER, optional),
    record("request_body", REQUEST_BODY, optional, nullable=True),
    value_map("responses", optional),  # map values are not descended into
    records("examples", EXAMPLE, optional),
    time("created_at", required),
    time("updated_at", required, gtefield="created_at"),
    style="api",
)
