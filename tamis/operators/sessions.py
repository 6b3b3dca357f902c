"""Batch sessions on tables: many requests add chunks of records to a session, which is then completed.

Two inputs. ``control`` has one row per session event: ``batch_id, kind ('start' | 'complete'), ts,
threshold``. ``chunks`` has one row per accepted request: ``batch_id, ts, valid, invalid, warnings`` (see
``chunk_counts``).

Every start begins a run of its batch id; a chunk or completion belongs to the run whose start is the last not after it. At equal
times starts come first and completions last. A run ends by completion, by more than 30 minutes without an
update (expired) or by the next start (replaced). A chunk before any start is unknown, one after the end of its run is rejected; none is
dropped. ``tamis.streaming.sessions`` follows the same rules.

No step brings all rows of one session together, so a session that holds a third of all rows does no harm: rows are cut
into segments within short time slots, at every control event, and added up; only the segments of a session are put in order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import moment
from tamis.operators.report import gate, success_rate

IDLE_SECONDS = 30 * 60  # fixed value: a session without an update for longer is gone


def chunk_counts(validated: DataFrame, batch_id: str = "batch_id", ts: str = "ts") -> DataFrame:
    """Records of one request share its time; add them up to one chunk row."""
    return validated.groupBy(F.col(batch_id).alias("batch_id"), F.col(ts).alias("ts")).agg(
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.count_if(F.col("is_valid") & (F.size("warnings") > 0)).alias("warnings"),
    )


def start_sessions(control: DataFrame) -> DataFrame:
    """One row per run: threshold, start and expiry time."""
    began = control.filter("kind = 'start' AND batch_id IS NOT NULL").groupBy("batch_id", F.col("ts").alias("started_at")).agg(
        F.max("threshold").alias("threshold"))
    return began.select("batch_id", F.lit("active").alias("status"), "started_at",
                        (F.col("started_at") + F.expr(f"INTERVAL {IDLE_SECONDS} SECONDS")).alias("expires_at"),
                        "threshold")


SLOT_SECONDS = 60  # rows of one session and slot are put in order by one task
SUMS = ("valid", "invalid", "warnings")


def _slot(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000))


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _cut(control: DataFrame, chunks: DataFrame) -> DataFrame:
    """Control events and chunks, numbered by segments: every control event opens a new one within its slot."""
    none = [F.lit(0).cast("bigint").alias(c) for c in SUMS]
    # events of one kind and time are one event
    events = (control.filter("batch_id IS NOT NULL AND kind IN ('start', 'complete')").groupBy("batch_id", "ts", "kind")
              .agg(F.max("threshold").cast("double").alias("threshold")).select("batch_id", "ts", "kind", "threshold", *none))
    rows = chunks.select("batch_id", "ts", F.lit("chunk").alias("kind"), F.lit(None).cast("double").alias("threshold"), *[F.col(c).cast("bigint").alias(c) for c in SUMS])
    both = events.unionByName(rows).withColumn("slot", _slot(F.col("ts"), SLOT_SECONDS))
    rank = F.when(F.col("kind") == "start", 0).when(F.col("kind") == "chunk", 1).otherwise(2)
    order = Window.partitionBy("batch_id", "slot").orderBy("ts", rank)
    return both.withColumn("segment", F.sum((F.col("kind") != "chunk").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _segments(cut: DataFrame) -> DataFrame:
    """One row per segment: its run, sums, times, and whether its chunks are accepted, or else why not (``reason``)."""
    opener = F.max(F.when(F.col("kind") != "chunk", F.col("kind")))
    parts = cut.groupBy("batch_id", "slot", "segment").agg(
        opener.alias("opener"), F.max("threshold").alias("threshold"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        *[F.sum(c).alias(c) for c in SUMS])
    session = Window.partitionBy("batch_id").orderBy("slot", "segment")
    so_far = session.rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("run", F.sum((F.coalesce("opener", F.lit("")) == "start").cast("int")).over(so_far))
    run = Window.partitionBy("batch_id", "run").orderBy("slot", "segment")
    until = run.rowsBetween(Window.unboundedPreceding, 0)
    completes = (F.coalesce("opener", F.lit("")) == "complete").cast("int")
    parts = parts.withColumn("done", F.sum(completes).over(until)).withColumn("done_before", F.col("done") - completes)
    # two updates within a slot are never too far apart, so only steps between segments matter
    idle = _micros("first_ts") - F.lag(_micros("last_ts")).over(run) > IDLE_SECONDS * 1_000_000
    late = (F.col("run") > 0) & (F.col("done_before") == 0) & F.coalesce(idle, F.lit(False))
    parts = parts.withColumn("late", late.cast("int")).withColumn("dead", F.max("late").over(until) == 1)
    reason = F.when(F.col("run") == 0, "unknown").when(F.col("dead"), "expired").when(F.col("done") > 0, "completed")
    return parts.withColumn("reason", reason).drop("late", "done_before")


def sessions(control: DataFrame, chunks: DataFrame, as_of: dt.datetime | str | None = None) -> DataFrame:
    """State of every run (numbered from 1 per batch id) at ``as_of``: counts, success rate and status.

    Status is ``in_progress`` until completion, then ``success`` or ``failed`` by the run's threshold; ``expired`` when the
    run was idle for too long before it was completed, ``replaced`` when the next start came before that.
    """
    if as_of is not None:
        now = F.expr(moment(as_of))
        control = control.filter(F.col("ts").cast("timestamp") <= now)
        chunks = chunks.filter(F.col("ts").cast("timestamp") <= now)
    parts = _segments(_cut(control, chunks)).filter("run > 0")
    open_ = F.col("reason").isNull()
    closes = (F.col("opener") == "complete") & (F.col("done") == 1) & ~F.col("dead")
    runs = parts.groupBy("batch_id", "run").agg(
        F.min("first_ts").alias("started_at"), F.max(F.when(F.col("opener") == "start", F.col("threshold"))).alias("threshold"),
        *[F.sum(F.when(open_, F.col(c)).otherwise(0)).cast("bigint").alias(c) for c in SUMS],
        F.max(F.when(open_, F.col("last_ts"))).alias("last_chunk"), F.max("dead").alias("dead"), F.min(F.when(closes, F.col("first_ts"))).alias("completed_at"))
    next_start = F.lead("started_at").over(Window.partitionBy("batch_id").orderBy("run"))
    runs = runs.withColumn("next_start", next_start)
    end = F.coalesce(F.col("completed_at").cast("timestamp"), F.col("next_start").cast("timestamp"), *([F.expr(moment(as_of))] if as_of is not None else []))
    idle = F.unix_micros(end) - _micros("last_chunk") > IDLE_SECONDS * 1_000_000
    expired = F.col("dead") | (F.col("completed_at").isNull() & F.coalesce(idle, F.lit(False)))
    final = F.col("completed_at").isNotNull()
    out = runs.select(
        "batch_id", F.col("run").cast("int").alias("run"),
        (F.col("valid") + F.col("invalid")).alias("total_records"),
        F.col("valid").alias("valid_records"),
        F.col("invalid").alias("invalid_records"),
        F.col("warnings").alias("warning_records"),
        "threshold", "started_at",
        F.coalesce("completed_at", "last_chunk").alias("last_updated"),
        final.alias("is_final"), expired.alias("is_expired"),
        (~final & ~expired & F.col("next_start").isNotNull()).alias("is_replaced"),
    ).withColumn("success_rate", success_rate())
    verdict = gate(F.when(F.col("total_records") > 0, F.col("threshold")))
    status = (F.when(F.col("is_expired"), "expired").when(F.col("is_final"), verdict)
              .when(F.col("is_replaced"), "replaced").otherwise("in_progress"))
    return out.withColumn("status", status)


def live_sessions(state: DataFrame) -> DataFrame:
    """Runs that remain after completed, expired and replaced ones are deleted."""
    return state.filter(~F.col("is_final") & ~F.col("is_expired") & ~F.col("is_replaced"))


def _chunks_with_segments(control: DataFrame, chunks: DataFrame, keep: list[str]) -> DataFrame:
    """Every chunk with columns of its segment."""
    cut = _cut(control, chunks)
    parts = _segments(cut).select(F.col("batch_id").alias("__id"), F.col("slot").alias("__slot"), F.col("segment").alias("__segment"), *keep)
    rows = cut.filter("kind = 'chunk'").drop("kind", "threshold")
    same = F.col("batch_id").eqNullSafe(F.col("__id")) & (F.col("slot") == F.col("__slot")) & (F.col("segment") == F.col("__segment"))
    return rows.join(parts, same).drop("__id", "__slot", "__segment")


def rejected_chunks(control: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that belong to no live run, with the reason: ``unknown``, ``completed`` or ``expired``."""
    return _chunks_with_segments(control, chunks, ["reason"]).filter("reason IS NOT NULL").drop("slot", "segment")


def accepted_totals(control: DataFrame, chunks: DataFrame) -> DataFrame:
    """Accepted chunks with their run and the records in it after each (``records_count``); rejected ones do not count."""
    earlier = Window.partitionBy("batch_id", "run").orderBy("slot", "segment").rowsBetween(Window.unboundedPreceding, -1)
    cut = _cut(control, chunks)
    counted = F.sum(F.when(F.col("reason").isNull(), F.col("valid") + F.col("invalid"))).over(earlier)
    parts = _segments(cut).withColumn("earlier", F.coalesce(counted, F.lit(0))).filter("reason IS NULL")
    parts = parts.select(F.col("batch_id").alias("__id"), F.col("slot").alias("__slot"), F.col("segment").alias("__segment"), "run", "earlier")
    here = Window.partitionBy("batch_id", "slot", "segment").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.filter("kind = 'chunk'").withColumn("so_far", F.sum(F.col("valid") + F.col("invalid")).over(here)).drop("kind", "threshold")
    same = (F.col("batch_id") == F.col("__id")) & (F.col("slot") == F.col("__slot")) & (F.col("segment") == F.col("__segment"))
    return (rows.join(parts, same).withColumn("records_count", (F.col("earlier") + F.col("so_far")).cast("bigint"))
            .drop("__id", "__slot", "__segment", "slot", "segment", "earlier", "so_far"))


def running_totals(chunks: DataFrame, slot_seconds: int = 1) -> DataFrame:
    """Records of a batch id after each chunk, whatever its runs (see ``accepted_totals``).

    A prefix sum in two levels: inside a short slot, and over the slots of the session.
    """
    cut = chunks.withColumn("n", F.col("valid") + F.col("invalid")).withColumn("slot", _slot(F.col("ts"), slot_seconds))
    inside = Window.partitionBy("batch_id", "slot").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("batch_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = cut.groupBy("batch_id", "slot").agg(F.sum("n").alias("slot_n")).select(
        "batch_id", "slot", F.coalesce(F.sum("slot_n").over(before), F.lit(0)).alias("earlier"))
    return (cut.withColumn("so_far", F.sum("n").over(inside)).join(slots, ["batch_id", "slot"])
            .withColumn("records_count", (F.col("earlier") + F.col("so_far")).cast("bigint"))
            .drop("slot", "n", "earlier", "so_far"))


def idle_cuts(rows: DataFrame, ts: str, by: str, sums: list[Column], keep: list[str]) -> DataFrame:
    """Cut the rows of each group at pauses of more than 30 minutes and add up the ``keep`` columns per piece.

    Two rows of one 30-minute slot are never too far apart, so pieces are runs of slots and only slots, not
    rows, are put in order.
    """
    slots = rows.groupBy(by, _slot(F.col(ts), IDLE_SECONDS).alias("slot")).agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("last_ts"), *sums)
    order = Window.partitionBy(by).orderBy("slot")
    pause = F.unix_micros(F.col("started_at").cast("timestamp")) - F.lag(
        F.unix_micros(F.col("last_ts").cast("timestamp"))).over(order)
    cut = F.coalesce(pause > IDLE_SECONDS * 1_000_000, F.lit(True)).cast("int")
    pieces = slots.withColumn("cut", cut).withColumn(
        "piece", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return pieces.groupBy(by, "piece").agg(
        F.min("started_at").alias("started_at"), F.max("last_ts").alias("last_ts"),
        *[F.sum(c).cast("bigint").alias(c) for c in keep]).drop("piece")
