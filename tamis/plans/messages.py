"""Wording and codes of rule errors, one style per model family."""

from __future__ import annotations

from tamis.plans.ruleset import Rule

# fixed values: error codes
VALIDATION_FAILED = "VALIDATION_FAILED"
REQUIRED_FIELD_MISSING = "REQUIRED_FIELD_MISSING"
VALUE_TOO_SHORT = "VALUE_TOO_SHORT"
VALUE_TOO_LONG = "VALUE_TOO_LONG"
INVALID_FORMAT = "INVALID_FORMAT"
INVALID_EMAIL_FORMAT = "INVALID_EMAIL_FORMAT"
INVALID_URL_FORMAT = "INVALID_URL_FORMAT"
INVALID_ENUM_VALUE = "INVALID_ENUM_VALUE"
JSON_UNMARSHAL_ERROR = "JSON_UNMARSHAL_ERROR"

# fixed values: code per rule in the base style
BASE_CODES = {
    "required": REQUIRED_FIELD_MISSING,
    "min": VALUE_TOO_SHORT,
    "max": VALUE_TOO_LONG,
    "oneof": INVALID_ENUM_VALUE,
    "email": INVALID_EMAIL_FORMAT,
    "url": INVALID_URL_FORMAT,
    "uuid": INVALID_FORMAT,
    "numeric": INVALID_FORMAT,
    "alpha": INVALID_FORMAT,
    "alphanum": INVALID_FORMAT,
}

# fixed values: message texts; {f} is the field label, {p} the rule parameter
_AT_LEAST = "Field '{f}' must be at least {p} characters long"
_AT_MOST = "Field '{f}' must be at most {p} characters long"
_ONE_OF = "Field '{f}' must be one of: {p}"
_URL = "Field '{f}' must be a valid URL format"
_EMAIL = "Field '{f}' must be a valid email address"
_IP = "Field '{f}' must be a valid IP address"
_GT = "Field '{f}' must be greater than {p}"
_GTE = "Field '{f}' must be greater than or equal to {p}"
_LTE = "Field '{f}' must be less than or equal to {p}"
_SEMVER = "Field '{f}' must be a valid semantic version"
_LEN = "Field '{f}' must be exactly {p} characters long"
_HEX = "Field '{f}' must contain only hexadecimal characters"
_OTHER = "Field '{f}' failed validation: {tag}"
_RAW = "Key: '{path}' Error:Field validation for '{f}' failed on the '{tag}' tag"

MESSAGES: dict[str, dict[str, str]] = {
    "incident": {
        "oneof": "Field must be one of: {p}",
        "min": "Field must be at least {p}{unit}",
        "max": "Field must be at most {p}{unit}",
        "": _RAW,
    },
    "deployment": {
        "deployment_name": "App name must start with a letter and contain only letters, numbers, and hyphens",
        "semver": "Version must follow semantic versioning format (e.g., 1.0.0, 2.1.3-alpha.1)",
        "hexadecimal": "Commit hash must be a valid hexadecimal string",
        "len": "Field must be exactly {p} characters long",
        "oneof": "Field must be one of: {p}",
        "": _RAW,
    },
    "generic": {
        "required": "Field '{f}' is required",
        "priority_level": "Field '{f}' must be a valid priority level (low, normal, high, urgent, critical, or 1-5)",
        "semver": _SEMVER, "url": _URL, "email": _EMAIL, "ip": _IP, "oneof": _ONE_OF, "min": _AT_LEAST,
        "max": _AT_MOST, "gt": _GT, "gte": _GTE, "lte": _LTE, "len": _LEN, "hexadecimal": _HEX, "": _OTHER,
    },
    "api": {
        "required": "Field '{f}' is required for API validation",
        "api_content_type": "Field '{f}' must be a valid API content type",
        "api_version": "Field '{f}' must be a valid API version format",
        "url": _URL, "email": _EMAIL, "ip": _IP, "oneof": _ONE_OF, "min": _AT_LEAST, "max": _AT_MOST,
        "gt": _GT, "gte": _GTE, "lte": _LTE, "": _OTHER,
    },
    "database": {
        "required": "Field '{f}' is required for database validation",
        "hostname_rfc1123": "Field '{f}' must be a valid hostname according to RFC 1123",
        "semver": _SEMVER, "oneof": _ONE_OF, "min": _AT_LEAST, "max": _AT_MOST, "gt": _GT, "gte": _GTE,
        "lte": _LTE, "": _OTHER,
    },
    "github": {
        "required": "Field '{f}' is required for GitHub webhook validation",
        "github_username": "Field '{f}' must be a valid GitHub username (1-39 chars, alphanumeric and hyphens)",
        "hexcolor": "Field '{f}' must be a valid 6-character hexadecimal color code",
        "url": _URL, "email": _EMAIL, "oneof": _ONE_OF, "min": _AT_LEAST, "max": _AT_MOST, "gt": _GT,
        "gte": _GTE, "len": _LEN, "hexadecimal": _HEX, "": _OTHER,
    },
    "base": {
        "required": "Field '{f}' is required",
        "min": "Field '{f}' must be at least {p}{unit}",
        "max": "Field '{f}' must be at most {p}{unit}",
        "oneof": _ONE_OF,
        "email": _EMAIL,
        "url": "Field '{f}' must be a valid URL",
        "uuid": "Field '{f}' must be a valid UUID",
        "numeric": "Field '{f}' must be numeric",
        "alpha": "Field '{f}' must contain only letters",
        "alphanum": "Field '{f}' must contain only letters and numbers",
        "": "Field '{f}' failed validation for {context} context: " + _RAW,
    },
}

# styles whose errors carry expected, constraint, path and severity, and use the rule name as code
DETAILED = {"generic", "api", "database", "github"}
# styles whose errors all carry one code
UNIFORM = {"incident", "deployment"}


def code_of(style: str, rule: Rule) -> str:
    if style in UNIFORM:
        return VALIDATION_FAILED
    if style in DETAILED:
        return rule.tag
    return BASE_CODES.get(rule.tag, VALIDATION_FAILED)


def message_parts(style: str, rule: Rule, kind: str, context: str) -> str:
    """Message text in which ``{f}`` and ``{path}`` are still open."""
    texts = MESSAGES[style]
    wording = texts.get(rule.tag, texts[""])
    unit = " characters long" if kind == "text" else ""
    return (wording.replace("{p}", rule.param_text).replace("{unit}", unit).replace("{tag}", rule.tag)
            .replace("{context}", context))
