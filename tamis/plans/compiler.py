"""Turn a rule set into SQL expressions: errors, warnings, test name.

Shape of the plan: one projection computes ``errors``, the next the verdict and ``warnings``, the last
``test_name``. There is no shuffle, no Python and no second pass. Inside ``errors`` a cheap guard (an OR
of all rule predicates, generated code, no allocation) decides whether the error array is built at all,
so that clean rows, normally almost all, cost only the predicates.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from tamis.functions import predicates
from tamis.functions.text import ZERO_TIME, any_of, ident, moment, quote, template
from tamis.plans import messages, nesting
from tamis.plans.ruleset import Check, Field, PerElement, Rule, RuleSet

ERROR_TYPE = (
    "STRUCT<field: STRING, message: STRING, code: STRING, value: STRING, expected: STRING,"
    " constraint: STRING, path: STRING, severity: STRING>"
)
WARNING_TYPE = (
    "STRUCT<field: STRING, message: STRING, code: STRING, value: STRING, suggestion: STRING, category: STRING>"
)
NO_ERRORS = f"cast(array() AS ARRAY<{ERROR_TYPE}>)"
NO_WARNINGS = f"cast(array() AS ARRAY<{WARNING_TYPE}>)"

NO_TEXT = "cast(NULL AS STRING)"


# RFC 3339 with up to nine decimals; a custom pattern also switches off the lenient time parser
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX"


def error_struct(field: str, message: str, code: str, value: str = NO_TEXT, expected: str = NO_TEXT,
                 constraint: str = NO_TEXT, path: str = NO_TEXT, severity: str = NO_TEXT) -> str:
    return (
        f"named_struct('field', {field}, 'message', {message}, 'code', {code}, 'value', {value},"
        f" 'expected', {expected}, 'constraint', {constraint}, 'path', {path}, 'severity', {severity})"
    )


# A text under construction: literal pieces and SQL pieces.
Pieces = tuple[tuple[str, str], ...]


def lit(text: str) -> Pieces:
    return (("lit", text),)


def to_sql(pieces: Pieces) -> str:
    merged: list[list[str]] = []
    for kind, s in pieces:
        if kind == "lit" and merged and merged[-1][0] == "lit":
            merged[-1][1] += s
        elif s:
            merged.append([kind, s])
    out = [quote(s) if kind == "lit" else s for kind, s in merged] or ["''"]
    return out[0] if len(out) == 1 else f"concat({', '.join(out)})"


def raw(x: str, name: str) -> str:
    return f"{x}.{ident(name)}" if x else ident(name)


def filled(f: Field, r: str) -> str:
    """The value with an absent one replaced by the zero value of its kind."""
    if f.null_aware or f.kind == "record":
        return r
    zero = {"text": "''", "integer": "0L", "natural": "0L", "duration": "0L", "real": "0D", "flag": "false", "time": ZERO_TIME}
    return f"coalesce({r}, {zero[f.kind]})"


def absent(f: Field, r: str) -> str:
    if f.null_aware:
        return f"{r} IS NULL"
    v = filled(f, r)
    if f.kind == "record":
        return f"({r} IS NULL OR ({' AND '.join(absent(g, raw(r, g.name)) for g in f.of.fields)}))"
    if f.kind == "flag":
        return f"NOT {v}"
    return {"text": f"{v} = ''", "time": f"{v} = {ZERO_TIME}"}.get(f.kind, f"{v} = 0")


def broken(rule: Rule, f: Field, rs: RuleSet, x: str) -> str | None:
    """SQL that is true when the field breaks the rule; None if the rule cannot break."""
    r = raw(x, f.name)
    if rule.name == "required":
        return None if f.kind == "record" else absent(f, r)
    if rule.name == "required_if":
        other, value = rule.param
        g = rs.by_name[other]
        return f"{filled(g, raw(x, other))} = {quote(value)} AND {absent(f, r)}"
    if rule.name == "gtefield":
        g = rs.by_name[str(rule.param)]
        return f"{filled(f, r)} < {filled(g, raw(x, g.name))}"
    return predicates.breaks(rule.name, filled(f, r), f.kind, rule.param)


@dataclass
class Segment:
    """A part of an array: one nullable element (``one``; ``array`` is the same as an array of one or none) or a whole array (``many``)."""

    kind: str
    sql: str
    array: str = ""


def assemble(segments: list[Segment], empty: str) -> str:
    arrays, run = [], []

    def close() -> None:
        if run:
            arrays.append(f"filter(array({', '.join(run)}), z -> z IS NOT NULL)")
            run.clear()

    for s in segments:
        if s.kind == "one":
            run.append(s.sql)
        else:
            close()
            arrays.append(s.sql)
    close()
    if not arrays:
        return empty
    return arrays[0] if len(arrays) == 1 else f"concat({', '.join(arrays)})"


def join_arrays(segments: list[Segment], empty: str) -> str:
    """As ``assemble``, for places outside of lambdas: Spark generates code for ``concat``, but interprets ``filter`` with all below it."""
    arrays = [s.array if s.kind == "one" else s.sql for s in segments]
    if not arrays:
        return empty
    return arrays[0] if len(arrays) == 1 else f"concat({', '.join(arrays)})"


# elements of an array that have generated code of their own; longer arrays go through a lambda, which Spark interprets
UNROLLED = 2
# wider elements, and those that nest, are left to the lambda, which keeps generated code small
MAX_UNROLLED_FIELDS = 16


def _unrolls(rs: RuleSet) -> bool:
    return len(rs.fields) <= MAX_UNROLLED_FIELDS and not any(f.kind in ("record", "records", "deep") for f in rs.fields)


@dataclass
class Scope:
    """Where a structure is being compiled."""

    top: bool = True  # on a plain path from the root, outside of arrays
    gone: list[str] = field(default_factory=list)  # conditions under which a nullable parent is absent
    holes: int | None = None  # inside a shared expression: shared structures met so far


def _count(rs: RuleSet, counts: dict[str, list], top: bool = True) -> None:
    for f in rs.fields:
        if f.kind == "record" or (f.kind == "records" and f.dive and top):
            counts.setdefault(f.of.name, [f.of, 0])[1] += 1
            if f.kind == "record":
                _count(f.of, counts, top)


def _spot(x: str, gone: list[str], prefix: Pieces, inner: list[str]) -> str:
    skip = " OR ".join(gone) or "false"
    holes = f", 'h', array({', '.join(inner)})" if inner else ""
    return f"named_struct('x', {x}, 'skip', {skip}, 'p', {to_sql(prefix)}{holes})"


@dataclass
class Compiler:
    rules: RuleSet
    root: str = ""  # SQL of the struct that holds the record; empty = top-level columns
    as_of: dt.datetime | str | None = None
    tag: str = ""  # keeps helper columns of several rule sets in one plan apart
    spots: dict[str, list[str]] = field(default_factory=dict)  # places of each shared structure
    shared: dict[str, RuleSet] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.now = moment(self.as_of)
        counts: dict[str, list] = {}
        _count(self.rules, counts)
        # A structure found at several places is checked by one shared expression over all its places
        # instead of one copy per place.
        self.shared = {name: rs for name, (rs, n) in counts.items() if n > 1 and len(rs.fields) > 4}
        self._parts, self._fails = self._structure(self.rules, self.root, lit(self.rules.name + "."), 0, Scope())

    # -- errors --------------------------------------------------------------------------------
    def _error(self, rule: Rule, kind: str, label: Pieces, path: Pieces, value: str) -> str:
        style = self.rules.style
        text = messages.message_parts(style, rule, kind, self.rules.model_type)
        pieces: Pieces = ()
        for part in re.split(r"(\{f\}|\{path\})", text):
            pieces += label if part == "{f}" else path if part == "{path}" else lit(part)
        code = quote(messages.code_of(style, rule))
        if style in messages.DETAILED:
            detail = [quote(rule.param_text), quote(rule.tag), to_sql(path), "'error'"]
        else:
            detail = [NO_TEXT] * 4
        return error_struct(to_sql(label), to_sql(pieces), code, f"cast({value} AS STRING)", *detail)

    def _field(self, f: Field, rs: RuleSet, x: str, prefix: Pieces, level: int, scope: "Scope"
               ) -> tuple[list[Segment], list[str]]:
        r = raw(x, f.name)
        label, path = lit(f.label), prefix + lit(f.label)
        tests = [(rule, broken(rule, f, rs, x)) for rule in f.rules]
        tests = [(rule, sql) for rule, sql in tests if sql is not None]
        segments: list[Segment] = []
        fails: list[str] = []
        skip = absent(f, r) if f.omit_empty else None
        if tests:
            shown = "''" if f.kind == "record" else filled(f, r)
            found = [(sql, self._error(rule, f.kind, label, path, shown)) for rule, sql in tests]
            whens = [f"WHEN {skip} THEN NULL"] if skip else []
            whens += [f"WHEN {sql} THEN {error}" for sql, error in found]
            arrays = [f"WHEN {skip} THEN {NO_ERRORS}"] if skip else []
            arrays += [f"WHEN {sql} THEN array({error})" for sql, error in found]
            segments.append(Segment("one", f"CASE {' '.join(whens)} END", f"CASE {' '.join(arrays)} ELSE {NO_ERRORS} END"))
            own = any_of([sql for _, sql in tests])
            fails.append(f"NOT ({skip}) AND {own}" if skip else own)
        inner = self._inner(f, r, prefix, level, scope)
        if inner:
            segment, inner_fails = inner
            # elements are looked at only when the field's own rules hold
            gate = [f"NOT ({skip})"] if skip else []
            if tests:
                gate.append(f"NOT {any_of([sql for _, sql in tests])}")
            if gate and segment.kind == "many":
                segments.append(Segment("many", f"CASE WHEN {' AND '.join(gate)} THEN {segment.sql} ELSE {NO_ERRORS} END"))
                fails.append(f"{' AND '.join(gate)} AND ({inner_fails})")
            else:
                segments.append(segment)
                fails.append(inner_fails)
        return segments, fails

    def _inner(self, f: Field, r: str, prefix: Pieces, level: int, scope: "Scope") -> tuple[Segment, str] | None:
        e, i = f"e{level}", f"i{level}"
        element = f"{f.label}["
        if f.kind == "texts" and f.each:
            item = Field(f.name, "text", f.each, label=f.label)
            v = f"coalesce({e}, '')"
            tests = [(rule, f"{v} = ''" if rule.name == "required" else
                      predicates.breaks(rule.name, v, "text", rule.param)) for rule in f.each]
            label = lit(element) + (("sql", f"cast({i} AS STRING)"),) + lit("]")
            whens = " ".join(
                f"WHEN {sql} THEN {self._error(rule, item.kind, label, prefix + label, v)}" for rule, sql in tests)
            fails = f"coalesce(exists({r}, {e} -> {any_of([s for _, s in tests])}), false)"
            sql = f"filter(transform({r}, ({e}, {i}) -> CASE {whens} END), z -> z IS NOT NULL)"
            return Segment("many", f"coalesce({sql}, {NO_ERRORS})"), fails
        if f.kind == "records" and f.dive:
            place = prefix + lit(element) + (("sql", f"cast({i} AS STRING)"),) + lit("].")
            if scope.top and f.of.name in self.shared and not self._holes(f.of):
                ref = self._add_spot(f.of, f"transform({r}, ({e}, {i}) -> {_spot(e, [], place, [])})")
                return Segment("many", ref), f"size({ref}) > 0"
            parts, fails = self._structure(f.of, e, place, level + 1, Scope(top=False))
            if fails == "false":
                return None
            found = f"coalesce(exists({r}, {e} -> {fails}), false)"
            sql = f"coalesce(flatten(transform({r}, ({e}, {i}) -> {assemble(parts, NO_ERRORS)})), {NO_ERRORS})"
            if scope.top and _unrolls(f.of):
                sql, found = self._unrolled(f, r, prefix + lit(element), level, sql, found)
            return Segment("many", sql), found
        if f.kind == "record":
            place = prefix + lit(f.label + ".")
            gone = [*scope.gone, f"{r} IS NULL"] if f.nullable else scope.gone
            if f.of.name in self.shared and (scope.top or scope.holes is not None):
                if scope.holes is not None:
                    ref = f"o.h[{scope.holes}]"
                    scope.holes += 1
                else:
                    ref = self._place(f.of, r, place, gone)
                return Segment("many", ref), f"size({ref}) > 0"
            inner = scope if scope.holes is not None else Scope(scope.top, gone)
            parts, fails = self._structure(f.of, r, place, level, inner)
            if fails == "false":
                return None
            sql = join_arrays(parts, NO_ERRORS) if scope.top else assemble(parts, NO_ERRORS)
            if f.nullable:
                return Segment("many", f"CASE WHEN {r} IS NOT NULL THEN {sql} ELSE {NO_ERRORS} END"), f"{r} IS NOT NULL AND {fails}"
            return Segment("many", sql), fails
        if f.kind == "deep":
            return Segment("many", self._deep(f, r, prefix, level)), f"{r} IS NOT NULL"
        return None

    def _unrolled(self, f: Field, r: str, element: Pieces, level: int, many: str, any_fails: str) -> tuple[str, str]:
        """Errors and guard of the elements of ``r``, given those of the lambda over all of them, which only long arrays take."""
        arrays, guards = [], []
        for j in range(UNROLLED):
            parts, fails = self._structure(f.of, f"get({r}, {j})", element + lit(f"{j}]."), level + 1, Scope(top=False))
            arrays.append(f"CASE WHEN size({r}) > {j} THEN {join_arrays(parts, NO_ERRORS)} ELSE {NO_ERRORS} END")
            guards.append(f"size({r}) > {j} AND {fails}")
        few = f"{r} IS NULL OR size({r}) <= {UNROLLED}"
        return (f"CASE WHEN {few} THEN concat({', '.join(arrays)}) ELSE {many} END",
                f"coalesce(CASE WHEN {few} THEN {any_of(guards)} ELSE {any_fails} END, false)")

    def _deep(self, f: Field, r: str, prefix: Pieces, level: int) -> str:
        """Errors of the steps below ``r`` in the order of their paths: the fields declared before the nested one, what is
        nested, the other fields."""
        d, e = f"d{level}", f"de{level}"
        halves = []
        for key, fields in ((f"{d}.k", f.of.fields[:f.place]), (f"concat({d}.k, array({nesting.LAST}))", f.of.fields[f.place:])):
            parts, fails = self._structure(f.of, f"{d}.x", (("sql", f"{d}.p"),), level + 1, Scope(top=False), fields)
            if fails != "false":
                halves.append(f"if({fails}, named_struct('k', {key}, 'e', {assemble(parts, NO_ERRORS)}), NULL)")
        steps = nesting.steps_sql(f, r, to_sql(prefix), level, {"timestampFormat": TIME_FORMAT})
        # only what is wrong is put in order
        wrong = f"filter(flatten(transform({steps}, {d} -> array({', '.join(halves)}))), {e} -> {e} IS NOT NULL)"
        return f"flatten(transform(array_sort({wrong}), {e} -> {e}.e))"

    def _structure(self, rs: RuleSet, x: str, prefix: Pieces, level: int, scope: "Scope", fields: tuple[Field, ...] | None = None
                   ) -> tuple[list[Segment], str]:
        segments: list[Segment] = []
        fails: list[str] = []
        for f in rs.fields if fields is None else fields:
            s, bad = self._field(f, rs, x, prefix, level, scope)
            segments += s
            fails += bad
        return segments, any_of(fails)

    # -- structures that occur at several places ------------------------------------------------
    def _holes(self, rs: RuleSet) -> list[tuple[list[Field], RuleSet]]:
        """Shared structures inside a shared structure: field path and rule set, in declaration order."""
        out: list[tuple[list[Field], RuleSet]] = []
        for f in rs.fields:
            if f.kind == "record":
                if f.of.name in self.shared:
                    out.append(([f], f.of))
                else:
                    out += [([f, *path], inner) for path, inner in self._holes(f.of)]
        return out

    def _place(self, rs: RuleSet, x: str, prefix: Pieces, gone: list[str]) -> str:
        """Register one place of a shared structure; returns SQL of the errors found there."""
        inner = []
        for path, nested in self._holes(rs):
            at, label, skip = x, prefix, list(gone)
            for f in path:
                at, label = raw(at, f.name), label + lit(f.label + ".")
                if f.nullable:
                    skip.append(f"{at} IS NULL")
            inner.append(self._place(nested, at, label, skip))
        return self._add_spot(rs, f"array({_spot(x, gone, prefix, inner)})")

    def _add_spot(self, rs: RuleSet, sql: str) -> str:
        spots = self.spots.setdefault(rs.name, [])
        spots.append(sql)
        return f"{ident(self._column(rs.name))}[{len(spots) - 1}]"

    def _column(self, name: str) -> str:
        return f"__{self.tag}{name}"

    def helpers(self) -> list[list[tuple[str, str]]]:
        """Stages of columns to compute before the errors, inner structures first."""
        stages: dict[int, list[tuple[str, str]]] = {}
        for name, spots in self.spots.items():
            rs = self.shared[name]
            parts, fails = self._structure(rs, "o.x", (("sql", "o.p"),), 50, Scope(top=False, holes=0))
            body = f"CASE WHEN o.skip OR NOT {fails} THEN {NO_ERRORS} ELSE {assemble(parts, NO_ERRORS)} END"
            each = f"coalesce(flatten(transform(s, o -> {body})), {NO_ERRORS})"
            sql = f"transform(array({', '.join(spots)}), s -> {each})"
            stages.setdefault(self._height(rs), []).append((self._column(name), sql))
        return [stages[h] for h in sorted(stages)]

    def _height(self, rs: RuleSet) -> int:
        return 1 + max((self._height(nested) for _, nested in self._holes(rs)), default=-1)

    def errors(self) -> str:
        whens = f"WHEN {self._fails} THEN {join_arrays(self._parts, NO_ERRORS)}"
        extra = self.rules.extra_errors
        if extra:
            tests = [(x, self.resolve(x.when)) for x in extra]
            items = ", ".join(
                f"CASE WHEN {cond} THEN "
                + error_struct(quote(x.field), self.resolve(template(x.message)), quote(x.code), self.resolve(x.value))
                + " END"
                for x, cond in tests)
            whens += f" WHEN {any_of([c for _, c in tests])} THEN filter(array({items}), z -> z IS NOT NULL)"
        return f"CASE {whens} ELSE {NO_ERRORS} END"

    # -- warnings ------------------------------------------------------------------------------
    def resolve(self, sql: str) -> str:
        """Replace ``$a.b`` by the zero-filled field, ``$:x`` by a shared value, ``$now`` by the evaluation instant."""

        def one(m: re.Match) -> str:
            if m[1] == "now":
                return self.now
            if m[1].startswith(":"):
                return ident(self._column("let_" + m[1][1:]))
            rs, x = self.rules, self.root
            names = m[1].split(".")
            for name in names[:-1]:
                x, rs = raw(x, name), rs.by_name[name].of
            return filled(rs.by_name[names[-1]], raw(x, names[-1]))

        return re.sub(r"\$(:?[a-z_]+(?:\.[a-z_]+)*)", one, sql)

    def lets(self) -> list[tuple[str, str]]:
        """Columns with values that several checks share, to compute before the warnings."""
        return [(self._column("let_" + name), self.resolve(sql)) for name, sql in self.rules.lets]

    def _warning(self, c: Check) -> str:
        value = f"cast({c.value} AS STRING)" if c.value else "cast(NULL AS STRING)"
        return self.resolve(
            f"named_struct('field', {quote(c.field)}, 'message', {template(c.message)}, 'code', {quote(c.code)},"
            f" 'value', {value}, 'suggestion', {quote(c.suggestion)}, 'category', {quote(c.category)})")

    def warnings(self, extra: tuple[Check, ...] = ()) -> tuple[str, str]:
        """SQL of the warnings array and of the guard that tells whether there are any."""
        segments, guards = [], []
        for c in (*self.rules.checks, *extra):
            if isinstance(c, PerElement):
                arr = self.resolve(c.each)
                conds = [self.resolve(k.when) for k in c.checks]
                items = ", ".join(f"CASE WHEN {w} THEN {self._warning(k)} END" for k, w in zip(c.checks, conds, strict=True))
                found = f"coalesce(exists({arr}, e -> {any_of(conds)}), false)"
                sql = f"filter(flatten(transform({arr}, e -> array({items}))), z -> z IS NOT NULL)"
                segments.append(Segment("many", f"CASE WHEN {found} THEN {sql} ELSE {NO_WARNINGS} END"))
                guards.append(found)
            elif c.each:
                arr, cond = self.resolve(c.each), self.resolve(c.when)
                found = f"coalesce(exists({arr}, e -> {cond}), false)"
                sql = f"transform(filter({arr}, e -> {cond}), e -> {self._warning(c)})"
                segments.append(Segment("many", f"CASE WHEN {found} THEN {sql} ELSE {NO_WARNINGS} END"))
                guards.append(found)
            else:
                cond = self.resolve(c.when)
                segments.append(Segment("one", f"CASE WHEN {cond} THEN {self._warning(c)} END"))
                guards.append(cond)
        return assemble(segments, NO_WARNINGS), any_of(guards)
