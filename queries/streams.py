"""Streaming queries: the events table read as a stream, run over what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.base import Query, table, utc
from queries.models import GENERIC
from queries.reports import DAY, E, EVENT_RULES, RUNS, SESSION_STATE, control, events, restarts
from tamis.operators.validate import codes, validate
from tamis.streaming import continuous as cont
from tamis.streaming.sessions import EVENT, chunk_events, track_sessions

OK = "event_type IN ('click', 'view', 'purchase', 'signup') AND value >= 5"


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def validated_stream(spark: SparkSession, sf: str) -> DataFrame:
    df = event_stream(spark, sf).select(F.expr(DAY).alias("batch_id"), F.expr(utc("ts")).alias("ts"), E, "event_type", "value")
    return validate(df, EVENT_RULES)


def continuous_rows(spark, sf):
    """Continuous validation: same rows as in batch."""
    rows = cont.run_to_parquet(validated_stream(spark, sf), "rows")
    return rows.select(E, "is_valid", codes("errors").alias("error_codes"), codes("warnings").alias("warning_codes"), "test_name")


ROWS = f"""WITH v AS (SELECT event_id, event_type NOT IN ('click', 'view', 'purchase', 'signup') AS e1, coalesce(value, 0) < 5 AS e2,
  coalesce(value, 0) = 0 AS zero, value > 90 AS big FROM events)
SELECT event_id, NOT (e1 OR e2) AS is_valid, concat_ws(',', CASE WHEN e1 THEN 'oneof' END, CASE WHEN zero THEN 'required' WHEN e2 THEN 'gte' END) AS error_codes,
  CASE WHEN NOT (e1 OR e2) AND big THEN 'BIG_VALUE' ELSE '' END AS warning_codes,
  'EventValidator' || CASE WHEN e1 THEN ':oneof' WHEN zero THEN ':required' WHEN e2 THEN ':gte' WHEN big THEN ':BIG_VALUE' ELSE '' END AS test_name FROM v"""


def quarantine_and_report(spark, sf):
    """Good rows, quarantine and report of a stream, written per micro-batch."""
    folder = cont.work_folder(spark, "continuous")
    cont.start_validation(validated_stream(spark, sf), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{folder}/out/rows")
    reports = spark.read.parquet(f"{folder}/out/report")
    split = rows.agg(F.count_if(F.col("is_valid").cast("boolean")).alias("good"), F.count_if(~F.col("is_valid").cast("boolean")).alias("bad"))
    total = reports.agg(F.sum("total_records").alias("reported"), F.sum("validation_errors").alias("validation_errors"))
    # both sides are one row
    return split.withColumn("x", F.lit(1)).join(total.withColumn("x", F.lit(1)), "x").drop("x")


def generic_stream(spark, sf):
    """The generic payload rules over the stream."""
    columns = GENERIC.columns
    df = event_stream(spark, sf).selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()]).select("k", F.expr(GENERIC.record).alias("record"))
    v = cont.run_to_parquet(validate(df, GENERIC.rules, as_of="2024-02-01T00:00:00Z", root="record").select("k", "is_valid", "test_name"), "generic")
    return v


def running(spark, sf):
    """Running totals per session in update mode; the last value per session."""
    folder = cont.work_folder(spark, "running")
    cont.start_upsert(cont.running_counts(validated_stream(spark, sf)), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return cont.latest(spark, f"{folder}/out", ("batch_id",)).select("batch_id", "total_records", "valid_records", "invalid_records", "warning_records", "success_rate")


def windowed(spark, sf, length="1 hour", slide=None):
    folder = cont.work_folder(spark, "windows")
    if slide:  # the state and what is written are panes; windows are added up from them
        panes = cont.pane_counts(validated_stream(spark, sf), "ts", length, slide, watermark="10 minutes")
        cont.start_upsert(panes, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
        out = cont.windows_of_panes(cont.latest(spark, f"{folder}/out", ("pane_start",)), length, slide, 70.0)
        return out.select(F.expr("unix_seconds(window_start)").alias("window_start"), "total_records", "valid_records", "success_rate", "status")
    gated = cont.windowed_gate(validated_stream(spark, sf), "ts", length, slide, 70.0, watermark="10 minutes")
    cont.start_upsert(gated, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    out = cont.latest(spark, f"{folder}/out", ("window_start", "window_end"))
    return out.select(F.expr("unix_seconds(window_start)").alias("window_start"), "total_records", "valid_records", "success_rate", "status")


def window_sql(length: int, slide: int) -> str:
    n = length // slide
    return f"""WITH v AS (SELECT epoch_us(ts) // 1000000 AS s, {OK} AS ok FROM events),
w AS (SELECT (s // {slide} - i) * {slide} AS window_start, ok FROM v, range({n}) t(i)),
c AS (SELECT window_start, count(*) AS total_records, count(*) FILTER (ok) AS valid_records FROM w GROUP BY window_start)
SELECT *, valid_records / total_records * 100.0 AS success_rate,
  CASE WHEN valid_records / total_records * 100.0 < 70 THEN 'failed' ELSE 'success' END AS status FROM c"""


def batch_windows(spark, sf):
    out = cont.windowed_gate(events(spark, sf), "ts", "10 minutes", None, 70.0)
    return out.select(F.expr("unix_seconds(window_start)").alias("window_start"), "total_records", "valid_records", "success_rate", "status")


def idle(spark, sf):
    """Sessions cut at pauses of more than 30 minutes."""
    out = cont.idle_sessions(events(spark, sf), "ts")
    return out.select("batch_id", F.expr("unix_micros(started_at)").alias("started_at"), F.expr("unix_micros(expires_at)").alias("expires_at"),
                      "total_records", "valid_records")


IDLE = f"""WITH v AS (SELECT cast(ts AS date)::varchar AS batch_id, ts, {OK} AS ok FROM events),
g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY batch_id ORDER BY ts) > INTERVAL 30 MINUTE, true) AS cut FROM v),
n AS (SELECT *, sum(cut::int) OVER (PARTITION BY batch_id ORDER BY ts) AS part FROM g)
SELECT batch_id, min(epoch_us(ts)) AS started_at, max(epoch_us(ts)) + 1800000000 AS expires_at, count(*) AS total_records,
  count(*) FILTER (ok) AS valid_records FROM n GROUP BY batch_id, part"""


def tracked(spark, sf):
    """Sessions followed in streaming state; their final rows and rejected records."""
    folder = cont.work_folder(spark, "sessions")
    begin_end = control(spark, sf).selectExpr("batch_id", "kind", "ts", "threshold", "0L AS valid", "0L AS invalid", "0L AS warnings")
    begin_end.unionByName(chunk_events(events(spark, sf))).write.parquet(f"{folder}/in")
    followed = track_sessions(spark.readStream.schema(EVENT).parquet(f"{folder}/in"))
    out = cont.run_to_parquet(followed, "tracked").filter("status IN ('success', 'failed', 'rejected')")
    return out.groupBy("batch_id", "status").agg(F.sum("total_records").alias("total_records"), F.sum("valid_records").alias("valid_records"))


def restarted(spark, sf):
    """Restarted sessions followed in streaming state: how every run ended."""
    folder = cont.work_folder(spark, "restarts")
    begin_end = restarts(spark, sf).selectExpr("batch_id", "kind", "ts", "threshold", "0L AS valid", "0L AS invalid", "0L AS warnings")
    begin_end.unionByName(chunk_events(events(spark, sf))).write.parquet(f"{folder}/in")
    out = cont.run_to_parquet(track_sessions(spark.readStream.schema(EVENT).parquet(f"{folder}/in")), "restarted")
    return out.filter("status NOT IN ('accumulating', 'rejected')").select("batch_id", "status", "total_records", "valid_records")


TRACKED = SESSION_STATE.replace("SELECT batch_id,\n  CASE WHEN expired", ", q AS (SELECT batch_id,\n  CASE WHEN expired") + """),
y AS (SELECT ev.batch_id, ev.ok FROM ev LEFT JOIN c USING (batch_id) WHERE c.batch_id IS NULL OR ev.ts > c.done
  UNION ALL SELECT batch_id, ok FROM x WHERE dead)
SELECT batch_id, status, total_records, valid_records FROM q WHERE status IN ('success', 'failed')
UNION ALL SELECT batch_id, 'rejected', count(*), count(*) FILTER (ok) FROM y GROUP BY batch_id"""


def all_queries() -> list[Query]:
    return [
        Query("b09_continuous_rows", continuous_rows, ROWS),
        Query("b09_quarantine_and_report", quarantine_and_report,
              f"WITH v AS ({ROWS}) SELECT count(*) FILTER (is_valid) AS good, count(*) FILTER (NOT is_valid) AS bad, count(*) AS reported,"
              " sum(CASE WHEN error_codes = '' THEN 0 ELSE len(string_split(error_codes, ',')) END)::bigint AS validation_errors FROM v"),
        Query("b09_generic_stream", generic_stream, GENERIC.result_sql() + "SELECT k, is_valid, test_name FROM v"),
        Query("b02_running_totals_stream", running,
              f"WITH v AS ({ROWS}), c AS (SELECT cast(e.ts AS date)::varchar AS batch_id, count(*) AS total_records, count(*) FILTER (is_valid) AS valid_records,"
              " count(*) FILTER (NOT is_valid) AS invalid_records, count(*) FILTER (warning_codes <> '') AS warning_records"
              " FROM v JOIN events e USING (event_id) GROUP BY 1) SELECT *, valid_records / total_records * 100.0 AS success_rate FROM c"),
        Query("b10_windowed_gate_stream", windowed, window_sql(3600, 3600)),
        Query("b10_sliding_gate_stream", lambda s, d: windowed(s, d, "1 hour", "20 minutes"), window_sql(3600, 1200)),
        Query("b10_windowed_gate", batch_windows, window_sql(600, 600)),
        Query("b05_idle_sessions", idle, IDLE),
        Query("b01_b05_restarted_sessions_stream", restarted,
              RUNS + "SELECT batch_id, status, total_records, valid_records FROM q WHERE status <> 'in_progress'"),
        Query("b01_b08_tracked_sessions_stream", tracked, TRACKED),
    ]


