import random

import pytest
from pyspark.sql import functions as F

from tamis.operators import sessions as ses
from tamis.streaming.continuous import idle_sessions, run_to_parquet
from tamis.streaming.sessions import EVENT, final_status, track_sessions

CONTROL = [("a", "start", "00:00:00", 80.0), ("a", "complete", "01:00:00", None), ("b", "start", "00:00:00", None),
           ("c", "start", "00:00:00", 50.0), ("c", "complete", "00:20:00", None), ("d", "start", "00:00:00", 90.0),
           ("d", "complete", "00:10:00", None), ("e", "start", "00:00:00", None), ("e", "complete", "00:05:00", None)]
CHUNKS = [("a", "00:30:00", 3, 1, 1), ("a", "00:59:00", 3, 0, 1), ("a", "01:10:00", 1, 0, 0), ("b", "00:10:00", 1, 0, 0),
          ("b", "00:40:00", 1, 0, 0), ("b", "01:10:01", 1, 0, 0), ("z", "01:10:01", 1, 0, 0), ("d", "00:05:00", 5, 1, 0),
          ("e", "00:01:00", 0, 1, 0)]
FINAL = {"a": ("success", 7), "b": ("expired", 2), "c": ("success", 0), "d": ("failed", 6), "e": ("failed", 1)}
REJECTED = {("a", "completed"), ("b", "expired"), ("z", "unknown")}


def tables(spark, shuffle=None):
    control, chunks = list(CONTROL), list(CHUNKS)
    if shuffle is not None:
        random.Random(shuffle).shuffle(control)
        random.Random(shuffle).shuffle(chunks)
    to_time = F.to_timestamp(F.concat(F.lit("2024-01-01 "), "ts"))
    return (spark.createDataFrame(control, "batch_id string, kind string, ts string, threshold double").withColumn("ts", to_time),
            spark.createDataFrame(chunks, "batch_id string, ts string, valid long, invalid long, warnings long").withColumn("ts", to_time))


@pytest.mark.parametrize("shuffle", [None, 1, 2])
def test_states_do_not_depend_on_order(spark, shuffle):
    state = ses.sessions(*tables(spark, shuffle)).collect()
    assert {r.batch_id: (r.status, r.total_records) for r in state} == FINAL
    assert {(r.batch_id, r.reason) for r in ses.rejected_chunks(*tables(spark, shuffle)).collect()} == REJECTED


def test_a_large_session_is_spread_over_slots(spark):
    """Rows of one session meet in a task only within a slot of a minute."""
    control = spark.createDataFrame([("hot", "start", 0)], "batch_id string, kind string, s long").selectExpr(
        "batch_id", "kind", "timestamp_seconds(s) AS ts", "cast(null AS DOUBLE) AS threshold")
    chunks = spark.range(5000).selectExpr("'hot' AS batch_id", "timestamp_seconds(id) AS ts", "1L AS valid", "0L AS invalid", "0L AS warnings")
    assert ses._segments(ses._cut(control, chunks)).count() == 84
    assert ses.sessions(control, chunks).first().total_records == 5000


def log(spark, seed):
    """A random log of restarts, completions, early, late and lost chunks, at times that collide."""
    r = random.Random(seed)
    rows = []
    for b in "pqrstu":
        for _ in range(r.randint(0, 40)):
            at = r.choice([r.randint(0, 200) * 60, r.randint(0, 200) * 60 + r.randint(0, 59) + r.random()])
            kind = r.choices(["start", "chunk", "complete"], [1, 6, 1])[0]
            rows.append((b, kind, float(round(at, 6)), float(r.choice([50, 80])) if kind == "start" and r.random() < 0.7 else None, *([r.randint(0, 3) for _ in range(3)] if kind == "chunk" else [0, 0, 0])))
    rows += [(None, "chunk", 60.0, None, 1, 0, 0), ("u", "chunk", 0.0, None, 1, 1, 1)]
    unique = {(x[0], x[1], x[2]): x for x in rows}.values()  # one event per id, kind and time
    return spark.createDataFrame(r.sample(list(unique), len(unique)), "batch_id string, kind string, s double, threshold double, valid long, invalid long, warnings long").selectExpr(
        "batch_id", "kind", "timestamp_micros(cast(round(s * 1000000) AS BIGINT)) AS ts", "threshold", "valid", "invalid", "warnings")


def replayed(rows):
    """The rules, event by event."""
    runs, rejected, open_runs = {}, {}, {}
    rank = {"start": 0, "chunk": 1, "complete": 2}
    for e in sorted(rows, key=lambda e: (e.ts, rank[e.kind])):
        s = open_runs.get(e.batch_id)
        if s and (e.ts - s["last"]).total_seconds() > 1800:
            s["status"] = "expired"
            open_runs.pop(e.batch_id)
            s = None
        if e.kind == "start":
            if s:
                s["status"] = "replaced"
            n = sum(k[0] == e.batch_id for k in runs) + 1
            runs[e.batch_id, n] = open_runs[e.batch_id] = {"last": e.ts, "threshold": e.threshold, "valid": 0, "all": 0, "status": "in_progress"}
        elif s is None:
            if e.kind == "chunk":
                why = "unknown"
                if any(k[0] == e.batch_id for k in runs):
                    why = "expired" if runs[max(k for k in runs if k[0] == e.batch_id)]["status"] == "expired" else "completed"
                rejected[e.batch_id, e.ts] = why
        elif e.kind == "chunk":
            s["last"], s["valid"], s["all"] = e.ts, s["valid"] + e.valid, s["all"] + e.valid + e.invalid
        else:
            s["status"] = final_status(s["all"], s["valid"], s["all"] - s["valid"], s["threshold"])
            open_runs.pop(e.batch_id)
    return {k: (r["status"], r["all"]) for k, r in runs.items()}, rejected


@pytest.mark.parametrize("seed", range(6))
def test_tables_and_streams_follow_the_same_rules(spark, tmp_path, seed):
    events = log(spark, seed).cache()
    rows = events.collect()
    runs, rejected = replayed(rows)
    control = events.filter("kind <> 'chunk'").select("batch_id", "kind", "ts", "threshold")
    chunks = events.filter("kind = 'chunk'").select("batch_id", "ts", "valid", "invalid", "warnings")
    assert {(r.batch_id, r.run): (r.status, r.total_records) for r in ses.sessions(control, chunks).collect()} == runs
    assert {(r.batch_id, r.ts): r.reason for r in ses.rejected_chunks(control, chunks).collect()} == rejected
    totals = ses.accepted_totals(control, chunks).collect()
    assert len(totals) + len(rejected) == chunks.count()
    last = {}
    for r in totals:
        last[r.batch_id, r.run] = max(last.get((r.batch_id, r.run), 0), r.records_count)
    assert last == {k: n for k, (_, n) in runs.items() if n or k in last}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = run_to_parquet(track_sessions(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))), "test").collect()
    ended = sorted((r.batch_id, r.status, r.total_records) for r in out if r.status not in ("accumulating", "rejected"))
    assert ended == sorted((k[0], s, n) for k, (s, n) in runs.items() if s != "in_progress")
    assert {(r.batch_id, r.ts) for r in out if r.status == "rejected"} == set(rejected)


def test_late_and_early_chunks_are_answered(spark, tmp_path):
    """One file per micro-batch: nothing that comes late is lost."""
    steps = [[("a", "start", 3600, 0)], [("x", "chunk", 9000, 1)], [("a", "chunk", 3700, 9)], [("a", "chunk", 100, 2), ("y", "chunk", 5, 3)]]
    for i, step in enumerate(steps):
        spark.createDataFrame(step, "batch_id string, kind string, s long, valid long").selectExpr(
            "batch_id", "kind", "timestamp_seconds(s) AS ts", "cast(null AS DOUBLE) AS threshold", "valid", "0L AS invalid", "0L AS warnings"
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run_to_parquet(track_sessions(stream), "late").collect()
    assert sorted((r.batch_id, r.total_records) for r in out if r.status == "rejected") == [("a", 2), ("x", 1), ("y", 3)]
    assert [r.total_records for r in out if r.status == "accumulating"] == [9]


def test_status_over_time(spark):
    control, chunks = tables(spark)
    at = {t: {r.batch_id: r for r in ses.sessions(control, chunks, f"2024-01-01T{t}Z").collect()} for t in ("00:35:00", "01:10:00", "01:11:00")}
    assert (at["00:35:00"]["a"].status, at["00:35:00"]["a"].total_records) == ("in_progress", 4)
    assert at["01:10:00"]["b"].status == "in_progress"  # exactly 30 minutes idle is not too long
    assert at["01:11:00"]["b"].status == "expired"
    live = ses.live_sessions(ses.sessions(control, chunks, "2024-01-01T00:35:00Z"))
    assert {r.batch_id for r in live.collect()} == {"a", "b"}


def test_starts_and_running_totals(spark):
    control, chunks = tables(spark)
    starts = {r.batch_id: r for r in ses.start_sessions(control).collect()}
    assert (starts["a"].expires_at - starts["a"].started_at).total_seconds() == 1800
    running = ses.running_totals(chunks).filter("batch_id = 'a'").orderBy("ts").collect()
    assert [r.records_count for r in running] == [4, 7, 8]


def test_streaming_state_agrees(spark, tmp_path):
    control, chunks = tables(spark)
    events = control.selectExpr("batch_id", "kind", "ts", "threshold", "0L AS valid", "0L AS invalid", "0L AS warnings").unionByName(
        chunks.selectExpr("batch_id", "'chunk' AS kind", "ts", "cast(NULL AS DOUBLE) AS threshold", "valid", "invalid", "warnings"))
    events.write.parquet(str(tmp_path / "in"))
    rows = run_to_parquet(track_sessions(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))), "test").collect()
    final = {r.batch_id: (r.status, r.total_records) for r in rows if r.status in ("success", "failed", "expired")}
    assert final == FINAL
    assert {r.batch_id for r in rows if r.status == "rejected"} == {b for b, _ in REJECTED}


def test_idle_sessions_join_at_exactly_thirty_minutes(spark):
    _, chunks = tables(spark)
    rows = chunks.filter("batch_id = 'b'").select("batch_id", "ts", F.lit(True).alias("is_valid"), F.array().alias("errors"),
                                                  F.array().alias("warnings"))
    assert sorted(r.total_records for r in idle_sessions(rows, "ts").collect()) == [1, 2]


@pytest.mark.parametrize("total, valid, threshold, status", [
    (100, 57, 57.0, "failed"), (100, 20, 20.0, "success"), (0, 0, 50.0, "success"), (1, 0, None, "failed"), (2, 0, None, "success")])
def test_final_status(total, valid, threshold, status):
    assert final_status(total, valid, total - valid, threshold) == status
