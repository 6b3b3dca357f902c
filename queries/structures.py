"""One query per declared structure: records built from a table, every rule of the structure broken by some.

Each leaf gets good, absent, boundary and bad values in turn, decided by the row's key. The checking SQL
evaluates every rule on the same flat values with its own predicates and lists the findings in order as
``path:code``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.base import Query, seed, seed_sql
from tamis.models import STRUCTURES
from tamis.operators.validate import validate
from tamis.plans.messages import code_of
from tamis.plans.ruleset import Field, Rule, RuleSet

# table and key column; wide structures use the smaller table
NARROW = ("orders", "o_orderkey")
WIDE = ("customer", "c_custkey")
PERIOD = 41  # a leaf is good for most keys
BASE_TIME = 1735689600  # 2025-01-01
JVM_METHOD_LIMIT = 8000


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def good_text(rules: dict[str, object], k: str) -> str:
    if "oneof" in rules:
        words = str(rules["oneof"]).split()
        whens = " ".join(f"WHEN {i} THEN {q(w)}" for i, w in enumerate(words))
        return f"CASE {k} % {len(words)} {whens} END"
    if "url" in rules:
        return f"'https://example.com/item/' || {k}"
    if "email" in rules:
        return f"'user' || {k} || '@example.com'"
    if "ip" in rules:
        return f"'10.0.' || ({k} % 250) || '.' || ({k} % 99)"
    if "hostname" in rules or "hostname_rfc1123" in rules:
        return f"'db-' || {k} || '.example.com'"
    if rules.get("len") == 40:
        return f"md5(cast({k} AS string)) || substr(md5(cast({k} + 1 AS string)), 1, 8)"
    if rules.get("len") == 64:
        return f"md5(cast({k} AS string)) || md5(cast({k} + 1 AS string))"
    if "semver" in rules or "loose_semver" in rules:
        return f"({k} % 9) || '.' || ({k} % 7) || '.0-rc.' || ({k} % 5)"
    if "api_version" in rules:
        return f"'v' || ({k} % 9) || '.' || ({k} % 7)"
    if "api_content_type" in rules:
        return f"CASE {k} % 3 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/html; charset=utf-8' ELSE 'image/svg' END"
    if "priority_level" in rules:
        return f"CASE {k} % 3 WHEN 0 THEN 'Urgent' WHEN 1 THEN '4' ELSE 'low' END"
    if "deployment_name" in rules:
        return f"'app-' || {k}"
    if "github_username" in rules:
        return f"'user-' || {k}"
    if "hexcolor" in rules:
        return f"'#' || substr(md5(cast({k} AS string)), 1, 6)"
    low = int(str(rules.get("min", 0)))
    return f"'value ' || {k} || {q(' and more of it'[: max(0, low - 7)])}" if low < 22 else f"'value ' || {k} || {q(' with some further words')}"


def bad_texts(rules: dict[str, object], k: str) -> list[str]:
    out = []
    if int(str(rules.get("min", 1))) > 1:
        out.append("'x'")
    if "max" in rules:
        out.append(f"repeat('é', {int(str(rules['max'])) + 1})")
        out.append(f"repeat('y', {rules['max']})")  # the boundary itself is fine for length
    wrong = {
        "oneof": "'zzz'", "url": "'not a url'", "email": "'nobody.example.com'", "ip": "'10.0.0.256'",
        "hostname": "'-db'", "hostname_rfc1123": "'db-.example'", "semver": "'01.2.3'", "loose_semver": "'1.2'",
        "api_version": "'version one'", "api_content_type": "'json'", "priority_level": "'6'",
        "deployment_name": "'-app-'", "github_username": "'two--hyphens'", "hexcolor": "'#ff00f'",
    }
    out += [v for r, v in wrong.items() if r in rules]
    if "len" in rules:
        out.append("'abc123'")
        if "hexadecimal" in rules:
            out.append(f"repeat('g', {rules['len']})")
    return out


def leaf_value(f: Field, i: int, k: str, spoil: bool = True) -> tuple[str, str]:
    """Shared SQL of the leaf's value and its SQL type; NULL means absent."""
    rules = {r.name: r.param for r in f.rules}
    mode = f"(({k} + {i * 7}) % {PERIOD})"
    if f.kind == "text":
        good, bad, typ = good_text(rules, k), bad_texts(rules, k), "string"
        if not f.nullable:
            bad.append("''")
    elif f.kind in ("integer", "duration"):
        low = int(str(rules.get("gte", rules.get("min", 1))))
        high = int(str(rules.get("lte", rules.get("max", max(low, 1) + 50))))
        good, typ = f"({max(low, 1)} + {k} % {max(1, high - max(low, 1) + 1)})", "bigint"
        bad = ["0", "-3", str(high), str(high + 1)]
        if "eq" in rules:
            good = str(rules["eq"])
            bad = ["0", "7"]
    elif f.kind == "real":
        good, typ, bad = f"(({k} % 90) / 100.0)", "double", ["-0.5", "1.0", "1.5", "0.0"]
    elif f.kind == "flag":
        return f"CASE WHEN {mode} = 0 THEN NULL ELSE {k} % 2 = 0 END", "boolean"
    elif f.kind == "deep":
        return "cast(NULL AS string)", "string"  # deeper nesting has a query of its own
    elif f.kind == "any":
        return f"CASE WHEN {mode} = 0 THEN NULL ELSE '{{\"k\": ' || {k} || '}}' END", "string"
    else:
        raise ValueError(f.kind)
    if not spoil:
        return good, typ
    whens = " ".join(f"WHEN {n + 1} THEN {b}" for n, b in enumerate(bad))
    return f"cast(CASE {mode} WHEN 0 THEN NULL {whens} ELSE {good} END AS {typ})", typ


# ---- checking predicates, written for the checking database ------------------------------------
URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[a-zA-Z0-9.:-]+(/([^?#%]|%[0-9a-fA-F][0-9a-fA-F])*)?(\?[^#]*)?(#([^%]|%[0-9a-fA-F][0-9a-fA-F])*)?$"
DUCK = {
    "url": lambda c, p: f"NOT regexp_matches({c}, '{URL}')",
    "email": lambda c, p: f"NOT regexp_matches({c}, '^[a-z0-9]+@[a-z]+[.][a-z]+$')",
    "ip": lambda c, p: (f"NOT (regexp_matches({c}, '^2001:db8::[0-9]+$') OR regexp_matches({c}, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$')"
                        f" AND list_bool_and(list_transform(string_split({c}, '.'), lambda x: coalesce(try_cast(x AS int) <= 255, false))))"),
    "hostname": lambda c, p: f"NOT regexp_matches({c}, '^[a-z][a-z0-9-]+([.][a-z0-9-]+)*[a-z0-9]$')",
    "hostname_rfc1123": lambda c, p: f"NOT regexp_matches({c}, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?([.][a-z0-9]([a-z0-9-]*[a-z0-9])?)*$')",
    "hexadecimal": lambda c, p: f"NOT regexp_matches({c}, '^(0[xX])?[0-9a-fA-F]+$')",
    "semver": lambda c, p: f"NOT regexp_matches({c}, '^(0|[1-9][0-9]*)[.](0|[1-9][0-9]*)[.](0|[1-9][0-9]*)(-[0-9a-z.]+)?$')",
    "loose_semver": lambda c, p: f"NOT regexp_matches({c}, '^[0-9]+[.][0-9]+[.][0-9]+(-[0-9A-Za-z.]+)?$')",
    "api_version": lambda c, p: f"NOT regexp_matches({c}, '^(v?[0-9]+([.][0-9]+)*|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})$')",
    "api_content_type": lambda c, p: f"NOT regexp_matches(split_part({c}, ';', 1), '^[a-z]+/[a-z]+$')",
    "priority_level": lambda c, p: f"lower({c}) NOT IN ('low', 'normal', 'high', 'urgent', 'critical', '1', '2', '3', '4', '5')",
    "deployment_name": lambda c, p: f"NOT regexp_matches({c}, '^[a-zA-Z]([a-zA-Z0-9-]*[a-zA-Z0-9])?$')",
    "github_username": lambda c, p: f"NOT regexp_matches({c}, '^[a-z0-9]+(-[a-z0-9]+)*$')",
    "hexcolor": lambda c, p: f"NOT regexp_matches({c}, '^#?[0-9a-fA-F]{{6}}$')",
    "oneof": lambda c, p: f"{c} NOT IN ({', '.join(q(w) for w in str(p).split())})",
    "boolean": lambda c, p: "false",
}
SIZE = {"min": "<", "max": ">", "len": "<>", "gt": "<=", "gte": "<", "lte": ">", "eq": "<>"}


def duck_rule(rule: Rule, f: Field, c: str) -> str:
    if rule.name in SIZE:
        subject = f"length({c})" if f.kind == "text" else f"len({c})" if f.kind in ("texts", "values", "records") else (
            f"cardinality({c})" if f.kind in ("text_map", "value_map") else c)
        return f"{subject} {SIZE[rule.name]} {rule.param}"
    return DUCK[rule.name](c, rule.param)


@dataclass
class Spec:
    """Chosen inputs of a record, by field path; what is not chosen is good if required, else absent.

    ``values``: SQL of scalars (times in epoch seconds). ``sizes``: SQL of the size of a collection, -1 for
    null. ``items``: SQL of its first elements (keys, for a map). ``map_values``: SQL of a map's first values.
    ``present``: SQL condition under which a nullable structure is there.
    """

    values: dict[str, str] = field(default_factory=dict)
    sizes: dict[str, str] = field(default_factory=dict)
    items: dict[str, list[str]] = field(default_factory=dict)
    map_values: dict[str, list[str]] = field(default_factory=dict)
    present: dict[str, str] = field(default_factory=dict)


@dataclass
class Flat:
    """A structure laid out as flat seed columns, with the Spark record and the checking SQL.

    ``names`` maps a field path to its zero-filled value, ``path#`` to the size of a collection, ``path.0`` to
    an element and ``path!`` to the presence of a nullable structure, for use in further checking SQL.
    """

    rules: RuleSet
    key: str
    spec: Spec | None = None
    names: dict[str, str] = field(default_factory=dict)
    columns: dict[str, str] = field(default_factory=dict)
    findings: list[str] = field(default_factory=list)
    n: int = 0

    def column(self, sql: str) -> str:
        name = f"c{self.n}"
        self.n += 1
        self.columns[name] = sql
        return name

    def _mode(self) -> str:
        return f"(({self.key} + {self.n * 7}) % {PERIOD})"

    def _finding(self, cases: list[tuple[str, str]], path: str, gate: str) -> None:
        if cases:
            whens = " ".join(f"WHEN {c} THEN {q(path + ':' + code)}" for c, code in cases)
            inner = f"CASE {whens} END"
            self.findings.append(f"CASE WHEN {gate} THEN {inner} END" if gate else inner)

    def structure(self, rs: RuleSet, prefix: str, gate: str, at: str = "") -> tuple[str, list[str]]:
        """Spark SQL of the record and the zero tests of its leaves."""
        items, zeros = [], []
        filled: dict[str, str] = {}
        for f in rs.fields:
            sql, zero = self._field(f, rs, prefix, gate, filled, at + f.name)
            items.append(f"'{f.name}', {sql}")
            zeros.append(zero)
        return f"named_struct({', '.join(items)})", zeros

    def _field(self, f: Field, rs: RuleSet, prefix: str, gate: str, filled: dict[str, str], at: str
               ) -> tuple[str, str]:
        path = prefix + f.label
        style = self.rules.style
        if f.kind == "time":
            # epoch seconds; NULL is the zero time
            if self.spec:
                sql = self.spec.values.get(at, f"{BASE_TIME}" if f.rules and not f.omit_empty else "NULL")
            else:
                sql = (f"CASE {self._mode()} WHEN 0 THEN NULL WHEN 1 THEN {BASE_TIME}"
                       f" ELSE {BASE_TIME} + 60 * (1000 + {self.key} % 500 + {self.n}) END")
            c = self.column(f"cast({sql} AS bigint)")
            self.names[at] = c
            filled[f.name] = f"coalesce({c}, -62135596800)"
            cases = []
            for r in f.rules:
                if r.name == "required":
                    cases.append((f"{c} IS NULL", code_of(style, r)))
                else:
                    cases.append((f"{filled[f.name]} < {filled[str(r.param)]}", code_of(style, r)))
            if f.omit_empty:
                cases = [(f"{c} IS NOT NULL AND {w}", code) for w, code in cases]
            self._finding(cases, path, gate)
            return f"timestamp_seconds({c})", f"{c} IS NULL"
        if f.kind == "record":
            return self._record(f, prefix, gate, at)
        if f.kind == "records":
            return self._records(f, path, gate, at)
        if f.kind in ("texts", "values", "text_map", "value_map"):
            return self._collection(f, path, gate, at)
        sql, typ = leaf_value(f, self.n, self.key, self.spec is None)
        if self.spec:
            needed = any(r.name in ("required", "min", "eq") for r in f.rules) and not f.omit_empty
            sql = f"cast({self.spec.values.get(at, sql if needed else 'NULL')} AS {typ})"
        c = self.column(sql)
        zero = {"string": "''", "bigint": "0", "double": "0", "boolean": "false"}[typ]
        pointer = f.nullable or f.kind in ("any", "deep")
        v = c if pointer else f"coalesce({c}, {zero})"
        absent = f"{c} IS NULL" if pointer else f"{v} = {zero}"
        self.names[at] = v
        filled[f.name] = v
        cases = []
        for r in f.rules:
            if r.name == "required":
                cases.append((absent, code_of(style, r)))
            elif r.name == "required_if":
                other, value = r.param
                cases.append((f"{filled[other]} = '{value}' AND {absent}", code_of(style, r)))
            else:
                cases.append((duck_rule(r, f, v), code_of(style, r)))
        if f.omit_empty:
            cases = [(f"NOT ({absent}) AND {w}", code) for w, code in cases]
        self._finding(cases, path, gate)
        return c, absent

    def _record(self, f: Field, prefix: str, gate: str, at: str) -> tuple[str, str]:
        gone = f"{self._mode()} IN (0, 1, 2, 3)"
        if self.spec:
            there = self.spec.present.get(at, "false" if f.nullable or f.omit_empty else "true")
            gone = f"NOT ({there})"
            if f.nullable and there == "false":
                return f"cast(NULL AS {f.of.struct_type})", "true"
        gone = self.column(gone)
        self.names[at + "!"] = f"NOT {gone}"
        start = len(self.findings)
        if f.nullable:
            inner_gate = f"NOT {gone}" + (f" AND {gate}" if gate else "")
            sql, _ = self.structure(f.of, f"{prefix}{f.label}.", inner_gate, at + ".")
            return f"CASE WHEN NOT {gone} THEN {sql} END", gone
        # an absent plain structure is all zero: its leaves count as absent
        mark = set(self.columns)
        sql, zeros = self.structure(f.of, f"{prefix}{f.label}.", gate, at + ".")
        for c in set(self.columns) - mark:
            if self.columns[c].startswith("cast(") or self.columns[c].startswith("CASE WHEN"):
                self.columns[c] = f"CASE WHEN {self.columns[gone]} THEN NULL ELSE {self.columns[c]} END"
        zero = "(" + " AND ".join(f"({z})" for z in zeros) + ")"
        if f.omit_empty:
            self.findings[start:] = [f"CASE WHEN NOT {zero} THEN {x} END" for x in self.findings[start:]]
        return sql, zero

    def _records(self, f: Field, path: str, gate: str, at: str) -> tuple[str, str]:
        style = self.rules.style
        size = f"CASE {self._mode()} WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END"
        if self.spec:
            size = self.spec.sizes.get(at, "-1")
            if size == "-1":
                self.names[at + "#"] = "-1"
                return f"cast(NULL AS ARRAY<{f.of.struct_type}>)", "true"
        size = self.column(f"cast({size} AS int)")
        self.names[at + "#"] = size
        own = [(f"{size} = -1", code_of(style, r)) for r in f.rules if r.name == "required"]
        self._finding(own, path, gate)
        elements = []
        nests = len(f.of.fields) >= 20 or any(g.kind in ("record", "records") for g in f.of.fields)
        for j in range(1 if nests else 2):
            inner = f"{size} > {j}" + (f" AND {gate}" if gate else "")
            sql, _ = self.structure(f.of, f"{path}[{j}].", inner if f.dive else "false", f"{at}.{j}.")
            elements.append(sql)
        array = f"array({', '.join(elements)})"
        if self.spec:  # sizes beyond the laid-out elements repeat the last one
            array = f"concat({array}, array_repeat({elements[-1]}, greatest({size} - {len(elements)}, 0)))"
        return f"CASE WHEN {size} >= 0 THEN slice({array}, 1, {size}) END", f"{size} = -1"

    def _collection(self, f: Field, path: str, gate: str, at: str) -> tuple[str, str]:
        style = self.rules.style
        size = f"CASE {self._mode()} WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END"
        if self.spec:
            size = self.spec.sizes.get(at, "0" if f.rules and not f.omit_empty else "-1")
        size = self.column(f"cast({size} AS int)")
        self.names[at + "#"] = size
        cases = []
        for r in f.rules:
            cases.append((f"{size} = -1" if r.name == "required" else f"greatest({size}, 0) {SIZE[r.name]} {r.param}",
                          code_of(style, r)))
        if f.omit_empty:
            cases = [(f"{size} >= 0 AND {w}", code) for w, code in cases]
        self._finding(cases, path, gate)
        item = Field(f.name, "text", f.each, label=f.label)
        elements = []
        given = self.spec.items.get(at, []) if self.spec else [None, None]
        for j, chosen in enumerate(given):
            sql, _ = leaf_value(item, self.n, self.key)
            c = self.column(chosen or sql)
            elements.append(c)
            self.names[f"{at}.{j}"] = f"coalesce({c}, '')"
            tests = [(duck_rule(r, item, f"coalesce({c}, '')"), code_of(style, r)) for r in f.each]
            self._finding(tests, f"{path}[{j}]", f"{size} > {j}" + (f" AND {gate}" if gate else ""))
        if self.spec:
            values = [self.column(v) for v in self.spec.map_values.get(at, [])]
            for j, c in enumerate(values):
                self.names[f"{at}={j}"] = c
            more = f"transform(sequence(1, greatest({size}, 1)), i -> concat('extra', i))"
            keys = f"slice(concat(cast(array({', '.join(elements)}) AS ARRAY<STRING>), {more}), 1, greatest({size}, 0))"
            if f.kind in ("texts", "values"):
                sql = keys
            else:
                filled = f"concat(cast(array({', '.join(values)}) AS ARRAY<STRING>), array_repeat('plain', greatest({size}, 0)))"
                sql = f"map_from_arrays({keys}, slice({filled}, 1, greatest({size}, 0)))"
        elif f.kind in ("texts", "values"):
            sql = f"slice(array({', '.join(elements)}), 1, {size})"
        else:
            sql = f"map_from_arrays(slice(array('k1', 'k2'), 1, {size}), slice(array({', '.join(elements)}), 1, {size}))"
        return f"CASE WHEN {size} >= 0 THEN {sql} END", f"{size} = -1"


def structure_query(name: str, rs: RuleSet, wide: bool) -> Query:
    source, key = WIDE if wide else NARROW
    plain = rs.with_(checks=(), extra_errors=())
    flat = Flat(plain, key)
    record, _ = flat.structure(plain, "", "")
    columns = {"k": key, **flat.columns}

    def run(spark: SparkSession, sf: str) -> DataFrame:
        # dozens of columns make one method of a whole stage, which the JVM never compiles beyond 8,000 bytes; Spark then generates a
        # projection of many small methods instead
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", JVM_METHOD_LIMIT)
        df = seed(spark, sf, source, columns).select("k", F.expr(record).alias("record"))
        v = validate(df, plain, root="record")
        # paths are carried by the detailed styles only; the others name the field
        where = f"coalesce(replace(e.path, '{plain.name}.', ''), e.field)"
        found = F.expr(f"array_join(transform(errors, e -> concat({where}, ':', e.code)), ',')")
        return v.select("k", "is_valid", found.alias("findings"))

    listed = "concat_ws(',', " + ",\n  ".join(flat.findings or ["NULL"]) + ")"
    sql = (f"WITH s AS ({seed_sql(source, columns)}),\nr AS (SELECT k, {listed} AS findings FROM s)\n"
           "SELECT k, findings = '' AS is_valid, findings FROM r")
    return Query(name, run, sql)


WIDE_STRUCTURES = {
    "GitHubPayload", "PullRequest", "Reference", "Repository", "CommitData", "DatabaseTransaction", "DatabaseQuery",
    "DatabaseExecutionPlan", "DatabasePlanOperation", "Team", "Milestone", "User",
}

# inventory number of every structure
NUMBERS = {
    name: number for number, name in [
        *enumerate("IncidentPayload DeploymentPayload GenericPayload APIModel DatabaseModel DatabaseConnection"
                   " DatabaseConstraints DatabasePrimaryKey DatabaseUniqueConstraint DatabaseForeignKey"
                   " DatabaseForeignKeyReference DatabaseCheckConstraint DatabaseIndex DatabaseAuditTrail"
                   " DatabaseRollbackInfo BaseModel".split(), 1),
        *enumerate("APIRequest APIResponse APIAuthorization APIRateLimit APIError APIWarning APILink APIPagination"
                   " APIPaginationLinks APIWebhook APIWebhookResponse APIEndpoint APIEndpointAuth APIParameter"
                   " APIRequestBody APIMediaType APISchema APIResponseSpec APIExample APIEncoding DatabaseQuery"
                   " DatabaseConnectionInfo DatabaseExecutionPlan DatabasePlanOperation DatabaseJoinInfo"
                   " DatabaseIndexUsage DatabasePerformance DatabaseSecurity DatabaseAccessPattern DatabaseAnomaly"
                   " DatabaseTransaction DatabaseSavepoint DatabaseLock DatabaseMigration DatabaseMigrationRollback"
                   " DatabaseBackup DatabaseBackupEncryption DatabaseBackupCompression DatabaseRetentionPolicy"
                   " GitHubPayload PullRequest Repository User Reference Label Team Milestone CommitData Commit"
                   " CommitAuthor CommitReference CommitStats CommitFile Verification".split(), 20),
    ]
}


def snake(name: str) -> str:
    out = ""
    for i, c in enumerate(name):
        if c.isupper() and i and (not name[i - 1].isupper() or (i + 1 < len(name) and name[i + 1].islower())):
            out += "_"
        out += c.lower()
    return out


def all_queries() -> list[Query]:
    return [
        structure_query(f"m{number:02d}_{snake(name).replace('git_hub', 'github')}", STRUCTURES[name], name in WIDE_STRUCTURES)
        for name, number in NUMBERS.items()
    ]
