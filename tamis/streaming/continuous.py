"""Structured Streaming: continuous validation, windowed gates and running session totals."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tamis.operators.report import counters, counts, gate, success_rate, summarize
from tamis.operators.sessions import idle_cuts

IDLE = "30 minutes"  # fixed value: a session without an update for longer is gone


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share. Only a local session may leave the setting
    out, and then gets a temporary folder; anywhere else that is an error, since executors do not see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix=f"{name}-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder made by ``work_folder`` once its results have been read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _micros(length: str) -> int:
    return pd.Timedelta(length).value // 1000


def pane_counts(validated: DataFrame, ts: str, length: str, slide: str, by: tuple[str, ...] = (), watermark: str | None = None) -> DataFrame:
    """Counts per pane, for tables and streams: the panes are the largest pieces of time that sliding windows of this ``length`` and
    ``slide`` are made of. Every row falls into one pane, however much the windows overlap."""
    rows = validated.withWatermark(ts, watermark) if watermark else validated
    pane = math.gcd(_micros(length), _micros(slide))
    out = counts(rows, [F.window(ts, f"{pane} microseconds"), *by])
    return out.withColumn("pane_start", F.col("window.start")).drop("window")


def windows_of_panes(panes: DataFrame, length: str, slide: str, threshold: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, success rate and gate of every sliding window, added up from the (few) rows of ``pane_counts``."""
    size, step = _micros(length), _micros(slide)
    at = F.unix_micros("pane_start")
    last = at - F.pmod(at, F.lit(step))  # the start of the last window that holds the pane
    starts = F.filter(F.sequence(last - (-(-size // step) - 1) * step, last, F.lit(step)), lambda s: s + size > at)
    totals = [c for c in panes.columns if c not in ("pane_start", *by)]
    out = panes.select(*by, *totals, F.explode(starts).alias("start")).groupBy(*by, "start").agg(*[F.sum(c).cast("bigint").alias(c) for c in totals])
    out = out.withColumn("success_rate", success_rate()).withColumn("status", gate(threshold))
    return out.withColumn("window_start", F.timestamp_micros("start")).withColumn("window_end", F.timestamp_micros(F.col("start") + size)).drop("start")


def windowed_gate(validated: DataFrame, ts: str, length: str, slide: str | None = None,
                  threshold: float | None = None, by: tuple[str, ...] = (), watermark: str | None = None) -> DataFrame:
    """Counts, success rate and gate per time window (and group); for tables and streams.

    Sliding windows of a table are added up from panes. A stream in ``update`` mode cannot aggregate twice, so there its rows are
    copied into each of their windows; to avoid that, run ``pane_counts`` and apply ``windows_of_panes`` to what it wrote."""
    if slide and not validated.isStreaming:
        return windows_of_panes(pane_counts(validated, ts, length, slide, by), length, slide, threshold, by)
    rows = validated.withWatermark(ts, watermark) if watermark else validated
    out = counts(rows, [F.window(ts, length, slide), *by] if slide else [F.window(ts, length), *by])
    out = out.withColumn("success_rate", success_rate()).withColumn("status", gate(threshold))
    return out.withColumn("window_start", F.col("window.start")).withColumn("window_end", F.col("window.end")).drop("window")


def idle_sessions(validated: DataFrame, ts: str, by: str = "batch_id", watermark: str | None = None) -> DataFrame:
    """Sessions cut at pauses of more than 30 minutes, with their counts; for tables and streams.

    A stream uses ``session_window``; set spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition to
    have its rows merged before the shuffle. A table is cut by slots, which no large group can slow down.
    """
    if validated.isStreaming:
        rows = validated.withWatermark(ts, watermark) if watermark else validated
        out = counts(rows, [F.session_window(ts, IDLE), by]).withColumn(
            "started_at", F.col("session_window.start")).withColumn(
            "expires_at", F.col("session_window.end")).drop("session_window")
    else:
        numbers = ["total_records", "valid_records", "invalid_records", "warning_records", "validation_errors",
                   "validation_warnings"]
        out = idle_cuts(validated, ts, by, counters(), numbers).withColumn(
            "expires_at", F.col("last_ts") + F.expr(f"INTERVAL {IDLE}")).drop("last_ts")
    return out.withColumn("success_rate", success_rate())


def running_counts(validated: DataFrame, by: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Counters per session that grow with every micro-batch (output mode ``update`` or ``complete``)."""
    return counts(validated, by).withColumn("success_rate", success_rate())


def start_validation(validated: DataFrame, out: str, checkpoint: str, *, available_now: bool = True,
                     report_by: tuple[str, ...] = ()) -> StreamingQuery:
    """Write good rows, quarantine and report of a validated stream.

    Every micro-batch is written once, split by verdict, to ``out/rows/epoch=N``, and its report, computed
    from the written rows, to ``out/report/epoch=N``. Both replace the folder of their epoch, so a batch that
    is repeated after a failure leaves no duplicates.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = f"{out}/rows/epoch={epoch}"
        batch.write.mode("overwrite").partitionBy("is_valid").parquet(rows)
        written = batch.sparkSession.read.schema(batch.schema).option("basePath", rows).parquet(rows)
        summarize(written, report_by).write.mode("overwrite").parquet(f"{out}/report/epoch={epoch}")

    return _start(validated, write, checkpoint, "append", available_now)


def start_upsert(totals: DataFrame, out: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Write the changed rows of an ``update``-mode aggregate, one folder per epoch."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return _start(totals, write, checkpoint, "update", available_now)


def latest(spark: SparkSession, out: str, keys: tuple[str, ...]) -> DataFrame:
    """Current value per key of what ``start_upsert`` wrote."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("v")).select(*keys, "v.*").drop("epoch")


def compact(spark: SparkSession, out: str, keys: tuple[str, ...]) -> None:
    """Replace the epochs that ``start_upsert`` wrote by one that holds the current value per key; not while the stream runs."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(out).getFileSystem(conf)
    epochs = sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(out)) if f.getPath().getName().startswith("epoch="))
    if len(epochs) < 2:
        return
    merged = work_folder(spark, "compacted")
    latest(spark, out, keys).write.parquet(merged)
    spark.read.parquet(merged).write.mode("overwrite").parquet(f"{out}/epoch={epochs[-1]}")
    for epoch in epochs[:-1]:
        remove_folder(spark, f"{out}/epoch={epoch}")
    remove_folder(spark, merged)


def _start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str,
           available_now: bool) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_to_parquet(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what it wrote."""
    spark = df.sparkSession
    folder = work_folder(spark, name)
    query = (df.writeStream.outputMode(mode).format("parquet").option("path", os.path.join(folder, "out"))
             .option("checkpointLocation", os.path.join(folder, "checkpoint")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(os.path.join(folder, "out"))
