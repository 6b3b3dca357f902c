"""Tamis: declarative data quality for Spark tables and streams."""

from tamis.functions.predicates import register_rule
from tamis.models import CATALOG, STRUCTURES
from tamis.operators.quarantine import bad_rows, good_rows, write_split
from tamis.operators.report import report, summarize
from tamis.operators.routing import route
from tamis.operators.validate import codes, validate
from tamis.plans.ruleset import Check, RuleSet, rule_set
from tamis.sources.decode import decode

__all__ = [
    "CATALOG", "STRUCTURES", "Check", "RuleSet", "bad_rows", "codes", "decode", "good_rows", "register_rule",
    "report", "route", "rule_set", "summarize", "validate", "write_split",
]
