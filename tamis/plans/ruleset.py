"""Declarations: fields, rule sets and business checks.

A rule set is plain data. ``tamis.plans.compiler`` turns it into SQL expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

# kind -> Spark type; `record` and `records` take their type from the nested rule set
SCALARS = {
    "text": "STRING",
    "integer": "BIGINT",
    "natural": "BIGINT",  # decoding refuses negative numbers
    "real": "DOUBLE",
    "flag": "BOOLEAN",
    "time": "TIMESTAMP",
    "duration": "BIGINT",  # nanoseconds
    "any": "STRING",  # any JSON value, kept as text
    "deep": "STRING",  # the rest of a structure that nests in itself, kept as JSON text
    "texts": "ARRAY<STRING>",
    "values": "ARRAY<STRING>",
    "text_map": "MAP<STRING, STRING>",
    "value_map": "MAP<STRING, STRING>",
}
# kinds that know null by nature; the others have a zero value unless declared nullable
NULL_AWARE = {"any", "deep", "texts", "values", "records", "text_map", "value_map"}

required = "required"
optional = "optional"

# fixed values: words written in capitals inside a field label
CAPITALS = {"id", "url", "html", "ip", "sha", "ssl", "ssh", "cpu", "io", "sql"}


def label_of(name: str) -> str:
    """``html_url`` -> ``HTMLURL``, ``reported_by`` -> ``ReportedBy``."""
    return "".join(w.upper() if w in CAPITALS else w[:1].upper() + w[1:] for w in name.split("_"))


@dataclass(frozen=True)
class Rule:
    name: str
    param: object = None

    @property
    def tag(self) -> str:
        return "semver" if self.name == "loose_semver" else self.name

    @property
    def param_text(self) -> str:
        if self.param is None or self.param is True:
            return ""
        if self.name == "gtefield":
            return label_of(str(self.param))
        if self.name == "required_if":
            other, value = self.param
            return f"{label_of(other)} {value}"
        return str(self.param)


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    rules: tuple[Rule, ...] = ()
    omit_empty: bool = False
    nullable: bool = False
    each: tuple[Rule, ...] = ()  # rules for the elements of `texts`
    of: "RuleSet | None" = None  # nested rule set of `record` / `records`
    dive: bool = True  # `records` without dive are not descended into
    label: str = ""
    many: bool = False  # `deep`: an array of structures, else one structure
    place: int = 0  # `deep`: how many fields of the structure precede the nested one

    @property
    def null_aware(self) -> bool:
        return self.nullable or self.kind in NULL_AWARE


def _rules(presence: str | None, named: dict[str, object]) -> tuple[Rule, ...]:
    out = [Rule("required")] if presence == required else []
    for name, param in named.items():
        if isinstance(param, list):
            out += [Rule(name, p) for p in param]
        else:
            out.append(Rule(name, param))
    return tuple(out)


def _maker(kind: str):
    def make(name: str, presence: str | None = None, *, nullable: bool = False, each: dict | None = None,
             label: str = "", **named: object) -> Field:
        return Field(name, kind, _rules(presence, named), presence == optional, nullable,
                     _rules(None, each or {}), label=label or label_of(name))

    make.__doc__ = f"Declare a field of kind `{kind}`; keyword rules apply in the order given."
    return make


text = _maker("text")
integer = _maker("integer")
natural = _maker("natural")
real = _maker("real")
flag = _maker("flag")
time = _maker("time")
duration = _maker("duration")
anything = _maker("any")
texts = _maker("texts")
values = _maker("values")
text_map = _maker("text_map")
value_map = _maker("value_map")


def record(name: str, of: "RuleSet", presence: str | None = None, *, nullable: bool = False, label: str = "") -> Field:
    """A nested structure. ``nullable`` ones are skipped when null; others are always checked inside."""
    return Field(name, "record", _rules(presence, {}), presence == optional, nullable, of=of,
                 label=label or label_of(name))


def records(name: str, of: "RuleSet", presence: str | None = None, *, dive: bool = True, label: str = "",
            **named: object) -> Field:
    """An array of structures; with ``dive`` every element is checked."""
    return Field(name, "records", _rules(presence, named), presence == optional, of=of, dive=dive,
                 label=label or label_of(name))


def deep(name: str, step: "RuleSet", place: int, *, many: bool = False, label: str = "") -> Field:
    """A structure that nests in itself to any depth under ``name``; ``step`` holds its other fields, the first ``place``
    of which are declared before the nested one."""
    return Field(name, "deep", (), True, not many, of=step, many=many, place=place, label=label or label_of(name))


@dataclass(frozen=True)
class Check:
    """A business check. ``when`` and ``{...}`` parts are SQL in which ``$a.b`` is a zero-filled field.

    With ``each`` (SQL for an array) the check runs per element, named ``e``.
    """

    code: str
    when: str
    field: str = ""
    message: str = ""
    value: str | None = None
    suggestion: str = ""
    category: str = ""
    each: str | None = None


@dataclass(frozen=True)
class PerElement:
    """Several checks that run side by side for every element of one array."""

    each: str
    checks: tuple[Check, ...]


@dataclass(frozen=True)
class RuleError:
    """An extra error that is tested only when no field rule failed."""

    code: str
    when: str
    field: str
    message: str
    value: str


@dataclass(frozen=True)
class RuleSet:
    name: str  # structure name, the root of error paths
    fields: tuple[Field, ...] = ()
    checks: tuple[Check | PerElement, ...] = ()
    extra_errors: tuple[RuleError, ...] = ()
    title: str = ""  # prefix of test names, e.g. "IncidentValidator"
    provider: str = ""
    model_type: str = ""
    style: str = "base"  # wording and codes of errors, see plans/messages.py
    checks_when_invalid: bool = False
    field_count: str | None = None  # SQL for the per-row field count metric
    lets: tuple[tuple[str, str], ...] = ()  # values shared by several checks, named $:name there

    def __post_init__(self) -> None:
        object.__setattr__(self, "by_name", {f.name: f for f in self.fields})

    def with_(self, **changes: object) -> "RuleSet":
        return replace(self, **changes)

    @property
    def ddl(self) -> str:
        """Column list for a typed decode, e.g. ``id STRING, tags ARRAY<STRING>``."""
        return ", ".join(f"`{f.name}` {type_of(f)}" for f in self.fields)

    @property
    def struct_type(self) -> str:
        return "STRUCT<" + ", ".join(f"`{f.name}`: {type_of(f)}" for f in self.fields) + ">"


def type_of(f: Field) -> str:
    if f.kind == "record":
        return f.of.struct_type
    if f.kind == "records":
        return f"ARRAY<{f.of.struct_type}>"
    return SCALARS[f.kind]


def title_case(name: str) -> str:
    """``api`` -> ``Api``, ``my_model`` -> ``My_Model``."""
    return re.sub(r"(^|[\s_-])([^\s_-])([^\s_-]*)", lambda m: m[1] + m[2].upper() + m[3].lower(), name)


def rule_set(name: str, *fields: Field, **kw: object) -> RuleSet:
    checks = tuple(kw.pop("checks", ()))
    extra = tuple(kw.pop("extra_errors", ()))
    kw["lets"] = tuple(kw.pop("lets", {}).items())
    return RuleSet(name, tuple(fields), checks, extra, **kw)
