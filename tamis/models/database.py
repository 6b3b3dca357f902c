"""Database queries, transactions, migrations and backups."""

from tamis.functions.scalars import WordBits, duration_text, occurrences, seconds_between
from tamis.functions.text import count_of
from tamis.plans.ruleset import (
    Check, RuleSet, anything, deep, duration, flag, integer, optional, real, record, records, required, rule_set, text,
    texts, time, value_map, values,
)

# fixed values: query text patterns, all lower case
SUSPICIOUS = [
    "' or '1'='1", "' or 1=1", "union select", "drop table", "delete from", "truncate table", "alter table",
    "create table", "exec ", "execute ", "sp_", "xp_", "--", "/*", "*/",
]
ADMIN_OPERATIONS = [
    "create user", "drop user", "grant ", "revoke ", "alter user", "create role", "drop role", "create database",
    "drop database",
]
SCHEMA_OPERATIONS = [
    "create table", "drop table", "alter table", "create index", "drop index", "create view", "drop view",
]
SENSITIVE_COLUMNS = ("password", "secret", "token", "ssn", "credit_card")
COMPLEX_WORDS = ["join", "union", "case when", "exists", "group by", "having"]
PLACEHOLDERS = ("@", "$", "?", ":")
WRITES = "('INSERT', 'UPDATE', 'DELETE')"

CONNECTION_INFO = rule_set(
    "DatabaseConnectionInfo",
    text("host", required, hostname_rfc1123=True),
    integer("port", required, gte=1, lte=65535),
    text("database", required, min=1, max=255),
    text("username", required, min=1, max=255),
    text("driver", required, oneof="postgres mysql sqlite oracle sqlserver mongodb cassandra redis"),
    text("version", optional),
    text("ssl_mode", optional, oneof="disable allow prefer require verify-ca verify-full"),
    text("connection_pool", optional, min=1, max=255),
    text("connection_id", optional),
    text("server_id", optional),
    text("cluster_id", optional),
    text("timezone", optional),
    text("charset", optional),
    text("collation", optional),
    style="database",
)
JOIN_INFO = rule_set(
    "DatabaseJoinInfo",
    text("type", required, oneof="INNER LEFT RIGHT FULL CROSS"),
    text("condition", required, min=1),
    text("algorithm", optional, oneof="NESTED_LOOP HASH MERGE SORT"),
    style="database",
)


STEP = rule_set(
    "DatabasePlanOperation",
    text("type", required, min=1),
    text("table", optional, min=1),
    text("index", optional, min=1),
    integer("rows", optional, gte=0),
    real("cost", optional, gte=0),
    duration("duration", optional, gte=0),
    text("filter", optional),
    texts("sort", optional, each=dict(min=1)),
    record("join", JOIN_INFO, optional, nullable=True),
    style="database",
)


def plan_operation(levels: int = 2) -> RuleSet:
    """A step of a query plan; steps nest to any depth, of which ``levels`` are unrolled into structs."""
    children = (records("children", plan_operation(levels - 1), optional) if levels
                else deep("children", STEP, len(STEP.fields), many=True))
    return STEP.with_(name=f"DatabasePlanOperation{levels}", fields=(*STEP.fields, children))


PLAN_OPERATION = plan_operation().with_(name="DatabasePlanOperation")
INDEX_USAGE = rule_set(
    "DatabaseIndexUsage",
    text("name", required, min=1),
    text("table", required, min=1),
    text("type", required, oneof="btree hash gin gist spgist brin unique clustered"),
    flag("used"),
    real("selectivity", optional, gte=0, lte=1),
    integer("rows", optional, gte=0),
    integer("size", optional, gte=0),
    time("last_used", optional, nullable=True),
    real("hit_ratio", optional, gte=0, lte=1),
    text("suggestion", optional),
    style="database",
)
EXECUTION_PLAN = rule_set(
    "DatabaseExecutionPlan",
    text("plan_id", optional),
    text("query_hash", optional, len=64, hexadecimal=True),
    records("operations", PLAN_OPERATION, optional),
    real("estimated_cost", optional, gte=0),
    real("actual_cost", optional, nullable=True, gte=0),
    records("indexes", INDEX_USAGE, optional),
    texts("warnings", optional, each=dict(min=1)),
    texts("suggestions", optional, each=dict(min=1)),
    flag("cache_hit"),
    flag("parallel"),
    style="database",
)
PERFORMANCE = rule_set(
    "DatabasePerformance",
    duration("query_time", required, gte=0),
    *[duration(n, optional, gte=0) for n in
      "parse_time plan_time execute_time network_time lock_wait_time io_wait_time cpu_time".split()],
    *[integer(n, optional, gte=0) for n in
      "memory_used temp_space_used buffer_hits buffer_misses physical_reads logical_reads writes network_bytes".split()],
    duration("connection_time", optional, gte=0),
    integer("lock_count", optional, gte=0),
    integer("deadlock_count", optional, gte=0),
    style="database",
)
ACCESS_PATTERN = rule_set(
    "DatabaseAccessPattern",
    text("frequency", optional, oneof="low medium high"),
    text("time_pattern", optional, oneof="business_hours off_hours mixed"),
    text("location_pattern", optional, oneof="internal external mixed"),
    text("user_pattern", optional, oneof="single multiple automated"),
    text("data_volume", optional, oneof="small medium large bulk"),
    time("last_access", optional),
    integer("access_count", optional, gte=0),
    integer("unique_users", optional, gte=0),
    style="database",
)
ANOMALY = rule_set(
    "DatabaseAnomaly",
    text("type", required, oneof="unusual_access suspicious_query high_volume unusual_time unauthorized_access"),
    text("severity", required, oneof="low medium high critical"),
    text("description", required, min=1, max=1000),
    real("confidence", required, gte=0, lte=1),
    time("detected_at", required),
    texts("evidence", optional, each=dict(min=1)),
    text("recommendation", optional, max=1000),
    style="database",
)
SECURITY = rule_set(
    "DatabaseSecurity",
    text("user_role", optional, min=1),
    texts("permissions", optional, each=dict(min=1)),
    text("access_level", optional, oneof="read write admin"),
    flag("encryption_used"),
    flag("ssl_used"),
    flag("audit_logged"),
    flag("sensitive"),
    text("data_classification", optional, oneof="public internal confidential restricted"),
    texts("compliance_flags", optional, each=dict(oneof="GDPR HIPAA SOX PCI-DSS")),
    record("access_pattern", ACCESS_PATTERN, optional),
    record("anomaly", ANOMALY, optional, nullable=True),
    style="database",
)

_WORDS = WordBits(
    "words", "lower($query)", SUSPICIOUS, ADMIN_OPERATIONS, SCHEMA_OPERATIONS, SENSITIVE_COLUMNS, COMPLEX_WORDS, PLACEHOLDERS,
    ["where", "having", "select *", "delete from", "update ", "like '%", "--", "/*"])
_SELECTS = "$:selects"
_PLAN = "$execution_plan"

QUERY = rule_set(
    "DatabaseQuery",
    text("id", optional),
    text("operation", required, oneof="SELECT INSERT UPDATE DELETE CREATE DROP ALTER TRUNCATE GRANT REVOKE"),
    text("table", required_if=[("operation", op) for op in "SELECT INSERT UPDATE DELETE".split()], min=1, max=255),
    text("database", required, min=1, max=255),
    text("schema", optional, min=1, max=255),
    text("query", required, min=1, max=100000),
    values("parameters", optional),
    flag("prepared_statement"),
    time("timestamp", required),
    duration("duration", optional, gte=0),
    integer("rows_affected", optional, gte=0),
    integer("rows_returned", optional, gte=0),
    text("transaction_id", optional),
    record("connection_info", CONNECTION_INFO, required),
    record("execution_plan", EXECUTION_PLAN, optional, nullable=True),
    record("performance", PERFORMANCE, optional, nullable=True),
    record("security", SECURITY, optional, nullable=True),
    value_map("context", optional),
    lets={**_WORDS.let, "selects": f"transform(array(lower($query)), t -> {occurrences('t', 'select')})[0]"},
    checks=[
        Check("SUSPICIOUS_SQL_PATTERNS", _WORDS.any(SUSPICIOUS), "Query",
              "Potentially dangerous SQL patterns detected: {" + _WORDS.all(SUSPICIOUS) + "}", None,
              "Use parameterized queries and validate all inputs", "security"),
        Check("UNPREPARED_CONDITIONAL_QUERY",
              f"NOT $prepared_statement AND {count_of('$parameters')} = 0 AND NOT {_WORDS.any(PLACEHOLDERS)}"
              f" AND {_WORDS.any(['where', 'having'])}",
              "PreparedStatement", "Query with conditions not using prepared statements", None,
              "Use prepared statements to prevent SQL injection", "security"),
        Check("SELECT_ALL_COLUMNS", _WORDS.any(["select *"]), "Query", "SELECT * query detected", None,
              "Specify only required columns for better performance", "performance"),
        Check("MISSING_WHERE_CLAUSE",
              f"{_WORDS.any(['delete from', 'update '])} AND NOT {_WORDS.any(['where'])}",
              "Query", "DELETE/UPDATE query without WHERE clause", None,
              "Add WHERE clause to limit affected rows", "performance"),
        Check("LEADING_WILDCARD_LIKE", _WORDS.any(["like '%"]), "Query",
              "LIKE query with leading wildcard detected", None,
              "Leading wildcards prevent index usage - consider full-text search", "performance"),
        Check("MULTIPLE_SUBQUERIES", f"{_SELECTS} > 1", "Query",
              "Multiple SELECT statements detected: {" + _SELECTS + "}", None,
              "Consider using JOINs instead of subqueries for better performance", "performance"),
        Check("SLOW_QUERY", "$duration > 5000000000L", "Duration",
              "Slow query execution: {" + duration_text("$duration") + "}", "$duration",
              "Optimize query performance with indexes or query restructuring", "performance"),
        Check("HIGH_ROW_COUNT", "$rows_affected > 100000", "RowsAffected",
              "High number of rows affected: {$rows_affected}", "$rows_affected",
              "Consider batch processing for large data operations", "performance"),
        Check("ADMIN_OPERATION", _WORDS.any(ADMIN_OPERATIONS), "Query",
              "Administrative operation detected: {" + _WORDS.first(ADMIN_OPERATIONS) + "}", None,
              "Ensure proper authorization for administrative operations", "security"),
        Check("SCHEMA_MODIFICATION", _WORDS.any(SCHEMA_OPERATIONS), "Query",
              "Schema modification detected: {" + _WORDS.first(SCHEMA_OPERATIONS) + "}", None,
              "Schema changes should be managed through migration scripts", "security"),
        Check("SENSITIVE_DATA_ACCESS", _WORDS.any(SENSITIVE_COLUMNS), "Query",
              "Query accesses potentially sensitive data", None,
              "Ensure proper authorization and audit logging for sensitive data", "security"),
        Check("NO_AUDIT_LOG", "$security IS NOT NULL AND NOT $security.audit_logged", "Security.AuditLogged",
              "Query execution not logged for audit", None,
              "Enable audit logging for compliance and security", "security"),
        Check("UNENCRYPTED_SENSITIVE_ACCESS", "$security.sensitive AND NOT $security.encryption_used",
              "Security.EncryptionUsed", "Sensitive data accessed without encryption", None,
              "Use encryption for sensitive data access", "security"),
        Check("NO_TRANSACTION_CONTEXT", f"$operation IN {WRITES} AND $transaction_id = ''", "TransactionID",
              "Data modification query not within a transaction", None,
              "Use transactions for data consistency", "best-practices"),
        Check("LONG_QUERY_STRING", "octet_length($query) > 10000", "Query",
              "Very long query string: {octet_length($query)} characters", "octet_length($query)",
              "Consider breaking down complex queries or using stored procedures", "maintainability"),
        Check("UNDOCUMENTED_COMPLEX_QUERY",
              f"NOT {_WORDS.any(['--', '/*'])} AND {_WORDS.count(COMPLEX_WORDS)} >= 2",
              "Query", "Complex query without documentation comments", None,
              "Add comments to explain complex query logic", "maintainability"),
        Check("HIGH_QUERY_COST", f"{_PLAN}.estimated_cost > 1000", "ExecutionPlan.EstimatedCost",
              "High estimated query cost: {format_string('%.2f', " + _PLAN + ".estimated_cost)}",
              f"{_PLAN}.estimated_cost", "Consider query optimization or index creation", "performance"),
        Check("TABLE_SCAN", "lower(e.type) IN ('table scan', 'seq scan')", "ExecutionPlan.Operations",
              "Table scan detected on table: {e.table}", "coalesce(e.table, '')",
              "Consider adding appropriate indexes", "performance", each=f"{_PLAN}.operations"),
        Check("UNUSED_INDEX", "NOT coalesce(e.used, false)", "ExecutionPlan.Indexes", "Index not used: {e.name}",
              "coalesce(e.name, '')", "Review index necessity or query structure", "performance",
              each=f"{_PLAN}.indexes"),
    ],
    title="DatabaseValidator",
    model_type="DatabaseQuery",
    provider="database_validator",
    style="database",
    field_count=(f"15 + {count_of('$parameters')} + {count_of(_PLAN + '.operations')}"
                 f" + {count_of(_PLAN + '.indexes')}"),
)

SAVEPOINT = rule_set(
    "DatabaseSavepoint",
    text("name", required, min=1, max=255),
    time("created_at", required),
    flag("released"),
    flag("rolled_back"),
    style="database",
)
LOCK = rule_set(
    "DatabaseLock",
    text("type", required, oneof="shared exclusive update intention"),
    text("resource", required, min=1),
    text("mode", required, oneof="table row page extent database"),
    time("acquired_at", required),
    duration("duration", optional, gte=0),
    flag("granted"),
    flag("waiting"),
    texts("blocking", optional, each=dict(min=1)),
    texts("blocked_by", optional, each=dict(min=1)),
    style="database",
)

_IS_WRITE = f"coalesce(q.operation, '') IN {WRITES}"
_BLOCKING = "size(filter($locks, l -> " + count_of("l.blocking") + " > 0))"
_LASTED = seconds_between("$start_time", "$end_time")
_RUNNING = seconds_between("$start_time", "$now")

TRANSACTION = rule_set(
    "DatabaseTransaction",
    text("id", required, min=1),
    text("status", required, oneof="active committed rolled_back preparing prepared"),
    text("isolation_level", required, oneof="read_uncommitted read_committed repeatable_read serializable"),
    time("start_time", required),
    time("end_time", optional, nullable=True, gtefield="start_time"),
    duration("duration", optional, gte=0),
    records("queries", QUERY, optional),
    flag("read_only"),
    flag("auto_commit"),
    duration("lock_timeout", optional, gte=0),
    records("savepoints", SAVEPOINT, optional),
    records("locks", LOCK, optional),
    record("performance", PERFORMANCE, optional, nullable=True),
    record("connection_info", CONNECTION_INFO, required),
    value_map("context", optional),
    checks=[
        Check("AUTOCOMMIT_MULTIPLE_OPS", f"$auto_commit AND {count_of('$queries')} > 1", "AutoCommit",
              "Multiple operations in autocommit transaction", None,
              "Use explicit transactions for multiple related operations", "best-practices"),
        Check("WRITE_IN_READONLY", f"$read_only AND coalesce(exists($queries, q -> {_IS_WRITE}), false)", "ReadOnly",
              "Write operation in read-only transaction", f"get(filter($queries, q -> {_IS_WRITE}), 0).operation",
              "Remove read-only flag or change to read operations", "consistency"),
        Check("EXCESSIVE_SAVEPOINTS", f"{count_of('$savepoints')} > 10", "Savepoints",
              "High number of savepoints: {size($savepoints)}", "size($savepoints)",
              "Consider simplifying transaction logic", "performance"),
        Check("BLOCKING_LOCKS", f"coalesce({_BLOCKING}, 0) > 0", "Locks",
              "Transaction has {" + _BLOCKING + "} blocking locks", _BLOCKING,
              "Consider reducing lock duration or changing isolation level", "concurrency"),
        Check("LONG_HELD_LOCK", "coalesce(e.duration, 0L) > 30000000000L", "Locks.Duration",
              "Long-held lock: {" + duration_text("e.duration") + "} on {e.resource}", "e.duration",
              "Optimize transaction to reduce lock duration", "concurrency", each="$locks"),
        Check("HIGH_ISOLATION_CONTENTION", f"$isolation_level = 'serializable' AND {count_of('$locks')} > 5",
              "IsolationLevel", "Serializable isolation with high lock count may cause contention", None,
              "Consider lower isolation level if data consistency allows", "concurrency"),
        Check("UNSAFE_ISOLATION_SENSITIVE",
              "$isolation_level = 'read_uncommitted'"
              " AND coalesce(exists($queries, q -> coalesce(q.security.sensitive, false)), false)",
              "IsolationLevel", "Read uncommitted isolation with sensitive data", None,
              "Use higher isolation level for sensitive data operations", "security"),
        Check("LONG_RUNNING_TRANSACTION", f"$end_time IS NOT NULL AND {_LASTED} > 300", "Duration",
              "Long-running transaction: {" + duration_text(f"cast({_LASTED} * 1000000000D AS BIGINT)") + "}",
              f"cast({_LASTED} * 1000000000D AS BIGINT)",
              "Break down into smaller transactions to reduce lock time", "performance"),
        Check("STALE_TRANSACTION", f"$end_time IS NULL AND {_RUNNING} > 600", "StartTime",
              "Transaction running for: {" + duration_text(f"cast({_RUNNING} * 1000000000D AS BIGINT)") + "}",
              f"cast({_RUNNING} * 1000000000D AS BIGINT)",
              "Review transaction state and consider timeout mechanisms", "reliability"),
    ],
    title="DatabasetransactionValidator",
    model_type="DatabaseTransaction",
    provider="database_validator",
    style="database",
    field_count=f"15 + {count_of('$queries')} + {count_of('$savepoints')} + {count_of('$locks')}",
)

MIGRATION_ROLLBACK = rule_set(
    "DatabaseMigrationRollback",
    flag("available"),
    text("sql", optional, min=1),
    flag("automatic"),
    time("executed_at", optional, nullable=True),
    flag("success"),
    text("error", optional),
    style="database",
)
MIGRATION = rule_set(
    "DatabaseMigration",
    text("id", required, min=1),
    text("version", required, semver=True),
    text("name", required, min=1, max=255),
    text("description", optional, max=1000),
    text("type", required, oneof="schema data both"),
    text("direction", required, oneof="up down"),
    text("sql", required, min=1),
    text("checksum", required, len=64, hexadecimal=True),
    time("executed_at", optional, nullable=True),
    duration("duration", optional, gte=0),
    flag("success"),
    text("error", optional),
    record("rollback", MIGRATION_ROLLBACK, optional, nullable=True),
    texts("dependencies", optional, each=dict(min=1)),
    texts("tags", optional, each=dict(min=1, max=50)),
    text("environment", optional, oneof="development staging production"),
    text("author", optional, min=1, max=255),
    value_map("context", optional),
    style="database",
)
BACKUP_ENCRYPTION = rule_set(
    "DatabaseBackupEncryption",
    flag("enabled"),
    text("algorithm", optional, oneof="AES256 AES128"),
    text("key_id", optional, min=1),
    style="database",
)
BACKUP_COMPRESSION = rule_set(
    "DatabaseBackupCompression",
    flag("enabled"),
    text("algorithm", optional, oneof="gzip lz4 zstd"),
    integer("level", optional, gte=1, lte=9),
    real("ratio", optional, gte=0, lte=1),
    style="database",
)
RETENTION_POLICY = rule_set(
    "DatabaseRetentionPolicy",
    integer("days", required, gt=0),
    integer("weeks", optional, gt=0),
    integer("months", optional, gt=0),
    integer("years", optional, gt=0),
    integer("max_backups", optional, gt=0),
    text("policy", optional, oneof="time_based count_based size_based"),
    flag("auto_delete"),
    style="database",
)
BACKUP = rule_set(
    "DatabaseBackup",
    text("id", required, min=1),
    text("type", required, oneof="full incremental differential transaction_log"),
    text("status", required, oneof="pending running completed failed canceled"),
    time("start_time", required),
    time("end_time", optional, nullable=True, gtefield="start_time"),
    duration("duration", optional, gte=0),
    integer("size", optional, gte=0),
    integer("compressed_size", optional, gte=0),
    text("location", required, min=1),
    text("checksum", optional, len=64, hexadecimal=True),
    record("encryption", BACKUP_ENCRYPTION, optional, nullable=True),
    record("compression", BACKUP_COMPRESSION, optional, nullable=True),
    record("retention_policy", RETENTION_POLICY, optional, nullable=True),
    texts("tables", optional, each=dict(min=1)),
    texts("excluded_tables", optional, each=dict(min=1)),
    text("error", optional),
    value_map("metadata", optional),
    record("connection_info", CONNECTION_INFO, required),
    style="database",
)
