"""Small helpers for writing Spark SQL expression text.

Rule sets compile to SQL expression text and enter a plan through one ``F.expr`` call per output
column. A set of a few hundred rules is thereby one round trip to the JVM instead of thousands of
``Column`` calls, and Catalyst sees ordinary built-in expressions.
"""

from __future__ import annotations

import datetime as dt
import re


def quote(value: object) -> str:
    """A Spark SQL string literal."""
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    text = text.replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f"'{text}'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def count_of(expr: str) -> str:
    """Number of elements of an array or map; NULL counts as none."""
    return f"if({expr} IS NULL, 0, size({expr}))"


def any_of(conditions: list[str]) -> str:
    if not conditions:
        return "false"
    return "(" + " OR ".join(f"({c})" for c in conditions) + ")"


_SEGMENT = re.compile(r"\{\{|\}\}|\{([^{}]*)\}")


def template(text: str) -> str:
    """Turn ``"age is {expr} days"`` into a concat of literals and SQL expressions."""
    parts, literal, at = [], "", 0
    for m in _SEGMENT.finditer(text):
        literal += text[at:m.start()]
        at = m.end()
        if m.group(0) in ("{{", "}}"):
            literal += m.group(0)[0]
            continue
        if literal:
            parts.append(quote(literal))
            literal = ""
        parts.append(f"coalesce(cast({m.group(1)} AS STRING), '')")
    literal += text[at:]
    if literal or not parts:
        parts.append(quote(literal))
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def moment(as_of: dt.datetime | str | None) -> str:
    """SQL for the evaluation instant. Naive values are UTC; None means the start of the query."""
    if as_of is None:
        return "current_timestamp()"
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of.replace("Z", "+00:00"))
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    micros = (as_of - epoch) // dt.timedelta(microseconds=1)
    return f"timestamp_micros({micros}L)"


# The instant that stands for an absent time: 0001-01-01T00:00:00Z.
ZERO_TIME = "timestamp_seconds(-62135596800L)"
