"""Batch sessions in streaming state: start, add chunks, complete, expire, reject.

The input stream has ``batch_id, kind ('start' | 'chunk' | 'complete'), ts, threshold, valid, invalid,
warnings``. State per session is one small row.

The rules are those of ``tamis.operators.sessions``, applied to events in the order of arrival, within a micro-batch in the order
of their times. There is no watermark, so no event is ever dropped as late: a chunk that comes after its run has ended, or is
dated before its start, is answered by ``rejected``. A run expires when an event dated more than 30 minutes after its last
update arrives for its batch id and, with ``wall_clock``, when none arrives for 30 minutes by the clock.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# the functions below travel to the executors by value, so this package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

IDLE = pd.Timedelta(minutes=30)  # fixed value: a session without an update for longer is gone

EVENT = ("batch_id STRING, kind STRING, ts TIMESTAMP, threshold DOUBLE, valid BIGINT, invalid BIGINT,"
         " warnings BIGINT")
STATE = "started BIGINT, updated BIGINT, threshold DOUBLE, valid BIGINT, invalid BIGINT, warnings BIGINT"
OUTPUT = ("batch_id STRING, status STRING, ts TIMESTAMP, total_records BIGINT, valid_records BIGINT,"
          " invalid_records BIGINT, warning_records BIGINT, success_rate DOUBLE, threshold DOUBLE")


def chunk_events(validated: DataFrame, batch_id: str = "batch_id", ts: str = "ts") -> DataFrame:
    """Rows of a validated stream as chunk events."""
    ok = F.col("is_valid")
    return validated.select(
        F.col(batch_id).cast("string").alias("batch_id"), F.lit("chunk").alias("kind"),
        F.col(ts).cast("timestamp").alias("ts"), F.lit(None).cast("double").alias("threshold"),
        ok.cast("bigint").alias("valid"), (~ok).cast("bigint").alias("invalid"),
        (ok & (F.size("warnings") > 0)).cast("bigint").alias("warnings"))


_KEYS = ["batch_id", "kind", "ts"]
_SUMS = {"threshold": "max", "valid": "sum", "invalid": "sum", "warnings": "sum"}


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.groupby(_KEYS, sort=False, dropna=False, as_index=False).agg(_SUMS)


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    # add up before the shuffle: records of one request share their time
    for pdf in batches:
        yield _merge(pdf)


def final_status(total: int, valid: int, invalid: int, threshold: float | None) -> str:
    if threshold is not None and total > 0:
        return "failed" if valid / total * 100.0 < threshold else "success"
    return "failed" if total == 1 and invalid > 0 else "success"


def _answer(key: str, status: str, ts: pd.Timestamp, s: list | None, counts: tuple[int, int, int] | None = None) -> dict:
    valid, invalid, warnings = counts or (s[3], s[4], s[5])
    total = valid + invalid
    return {
        "batch_id": key, "status": status, "ts": ts, "total_records": total, "valid_records": valid,
        "invalid_records": invalid, "warning_records": warnings,
        "success_rate": valid / total * 100.0 if total else 0.0, "threshold": s[2] if s else None,
    }


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, wall_clock: bool = False) -> Iterator[pd.DataFrame]:
    batch_id, out = key[0], []
    s = list(state.get) if state.exists else None

    if state.hasTimedOut:
        out.append(_answer(batch_id, "expired", pd.Timestamp(s[1], unit="us"), s))
        state.remove()
        yield pd.DataFrame(out)
        return

    events = None
    for pdf in batches:  # merged as it comes: bounded by the distinct times of the micro-batch, not by its rows
        events = pdf if events is None else _merge(pd.concat([events, pdf]))
    events["rank"] = events["kind"].map({"start": 0, "chunk": 1, "complete": 2})
    accumulated = None
    for e in events.sort_values(["ts", "rank"], kind="stable").itertuples():
        at = int(e.ts.value // 1000)
        if s is not None and at - s[1] > IDLE.value // 1000:
            out.append(_answer(batch_id, "expired", pd.Timestamp(s[1], unit="us"), s))
            s, accumulated = None, None
        if e.kind == "start":
            if s is not None and at >= s[0]:
                out.append(_answer(batch_id, "replaced", e.ts, s))
            if s is None or at >= s[0]:
                s, accumulated = [at, at, None if pd.isna(e.threshold) else float(e.threshold), 0, 0, 0], None
        elif s is None or at < s[0]:
            if e.kind == "chunk":
                out.append(_answer(batch_id, "rejected", e.ts, None, (int(e.valid), int(e.invalid), int(e.warnings))))
        elif e.kind == "chunk":
            s[1] = max(s[1], at)
            s[3] += int(e.valid)
            s[4] += int(e.invalid)
            s[5] += int(e.warnings)
            accumulated = e.ts
        else:
            out.append(_answer(batch_id, final_status(s[3] + s[4], s[3], s[4], s[2]), e.ts, s))
            s, accumulated = None, None
    if s is None:
        if state.exists:
            state.remove()
    else:
        if accumulated is not None:
            out.append(_answer(batch_id, "accumulating", accumulated, s))
        state.update(tuple(s))
        if wall_clock:
            state.setTimeoutDuration(IDLE.value // 1_000_000)
    if out:
        yield pd.DataFrame(out)


def _advance_by_clock(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    return _advance(key, batches, state, wall_clock=True)


def track_sessions(events: DataFrame, wall_clock: bool = False) -> DataFrame:
    """Follow all sessions of an event stream (append mode). ``wall_clock`` is for streams that run on: with it a run over what is
    there now would not end, as Spark keeps waiting for the timers.

    Emits a row per micro-batch for every session that grew (``accumulating``), the final row on completion
    (``success`` or ``failed``), ``expired`` for a session idle for too long, ``replaced`` for one that a new start ended and
    ``rejected`` for chunks that belong to no live session.
    """
    chunks = events.mapInPandas(_combine, EVENT)
    timer = GroupStateTimeout.ProcessingTimeTimeout if wall_clock else GroupStateTimeout.NoTimeout
    return chunks.groupBy("batch_id").applyInPandasWithState(_advance_by_clock if wall_clock else _advance, OUTPUT, STATE, "append", timer)
