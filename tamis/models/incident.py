"""Incident reports."""

from tamis.functions.predicates import PATTERNS, matches
from tamis.functions.scalars import contains_any, hours_between, word_count
from tamis.plans.ruleset import Check, RuleError, integer, optional, required, rule_set, text, texts, time

# fixed values: allowed words
SEVERITIES = "low medium high critical"

# fixed values: words that make a title generic
GENERIC_WORDS = ("issue", "problem", "error", "bug", "broken", "down", "failure")

# fixed values: lowest and highest priority per severity
PRIORITIES = {"low": (1, 2), "medium": (2, 3), "high": (3, 4), "critical": (4, 5)}

_LOW = "CASE $severity " + " ".join(f"WHEN '{s}' THEN {lo}" for s, (lo, _) in PRIORITIES.items()) + " END"
_HIGH = "CASE $severity " + " ".join(f"WHEN '{s}' THEN {hi}" for s, (_, hi) in PRIORITIES.items()) + " END"
_AGE = hours_between("$reported_at", "$now")

INCIDENT = rule_set(
    "IncidentPayload",
    text("id", required, min=3, max=50),
    text("title", required, min=10, max=200),
    text("description", required, min=20, max=1000),
    text("severity", required, oneof=SEVERITIES),
    text("status", required, oneof="open investigating resolved closed"),
    integer("priority", required, min=1, max=5),
    text("category", required, oneof="bug feature security performance"),
    text("environment", required, oneof="development staging production"),
    text("reported_by", required, min=3, max=100),
    text("assigned_to", optional, min=3, max=100),
    time("reported_at", required),
    time("updated_at"),
    texts("tags", optional, each=dict(min=2, max=20)),
    text("impact", optional, oneof=SEVERITIES),
    extra_errors=[
        RuleError(
            "INVALID_ID_FORMAT",
            f"NOT ({matches('$id', PATTERNS['incident_id'])})",
            "id",
            "incident ID must follow format INC-YYYYMMDD-NNNN (e.g., INC-20240924-0001), got: {$id}",
            "$id",
        ),
        RuleError(
            "PRIORITY_SEVERITY_MISMATCH",
            f"NOT ($priority BETWEEN {_LOW} AND {_HIGH})",
            "priority",
            "priority {$priority} is inconsistent with severity '{$severity}' (expected: [{" + _LOW + "} {" + _HIGH + "}])",
            "concat('priority=', $priority, ', severity=', $severity)",
        ),
    ],
    checks=[
        Check(
            "CRITICAL_INCIDENT_UNASSIGNED",
            "$severity = 'critical' AND $assigned_to = ''",
            "assigned_to",
            "Critical incident should be assigned to an engineer immediately",
            suggestion="Assign to on-call engineer or escalation team",
        ),
        Check(
            "PRODUCTION_LOW_PRIORITY",
            "$environment = 'production' AND $priority < 3",
            "priority",
            "Production incident has low priority ({$priority}), consider increasing",
            suggestion="Review if priority should be 3 or higher for production issues",
        ),
        Check(
            "STALE_INCIDENT",
            f"$status IN ('open', 'investigating') AND {_AGE} > 24",
            "status",
            "Incident has been {$status} for {format_string('%.1f', " + _AGE + ")} hours",
            suggestion="Review incident progress and update status or escalate",
        ),
        Check(
            "GENERIC_INCIDENT_TITLE",
            f"$severity IN ('high', 'critical') AND {contains_any('lower($title)', GENERIC_WORDS)}"
            f" AND {word_count('$title')} < 6",
            "title",
            "High/Critical severity incident has generic title",
            suggestion="Provide more specific description for high priority incidents",
        ),
        Check(
            "SECURITY_INCIDENT_NO_TAGS",
            "$category = 'security' AND if($tags IS NULL, 0, size($tags)) = 0",
            "tags",
            "Security incidents should have relevant tags for tracking and reporting",
            suggestion="Add tags like 'security-breach', 'vulnerability', 'compliance', etc.",
        ),
    ],
    title="IncidentValidator",
    model_type="incident",
    provider="incident_validator",
    style="incident",
    checks_when_invalid=True,
)
