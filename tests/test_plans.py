"""The plans that scale: no shuffle, no Python, one scan."""

import contextlib
import io

from pyspark.sql import functions as F

from queries import models, reports
from tamis import CATALOG, report, route, validate
from tests.conftest import SF


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_validation_is_projections_only(spark):
    for model in (models.INCIDENT, models.QUERY, models.PULL_REQUEST):
        p = plan(model.validated(spark, SF))
        assert not [op for op in ("Exchange", "EvalPython", "InPandas", "HashJoin", "SortMergeJoin", "LoopJoin") if op in p]
        assert p.count("Scan parquet") == 2  # once in the tree, once in the details


def test_report_shuffles_partial_counts_only(spark):
    p = plan(report(reports.orders(spark, SF), 80.0))
    first = p.index("Exchange")
    assert "partial" in p or "HashAggregate" in p[first:]
    assert "Python" not in p


def test_only_used_columns_are_read(spark):
    p = plan(reports.orders(spark, SF).select("is_valid"))
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderpriority:string>" in p


def test_filters_on_input_columns_reach_the_scan(spark):
    p = plan(reports.orders(spark, SF).filter("o_custkey = 7"))
    assert "EqualTo(o_custkey,7)" in p


def test_sessions_read_twice_and_shuffle_little(spark):
    df = reports.session_state(spark, SF)
    df.collect()
    p = plan(df)
    p = p[p.index("== Physical Plan =="):]
    final = p[p.index("Final Plan"):p.index("Initial Plan")] if "Final Plan" in p else p
    tree = final.split("\n(1) ")[0]
    # control and chunks; by control event, by chunk, by slot, by session (and control's own grouping of days)
    assert tree.count("Scan parquet") <= 3 and tree.count("Exchange") <= 8


def test_routing_reads_the_table_once(spark):
    small = {t: CATALOG[t] for t in ("incident", "generic", "deployment")}
    df = spark.read.parquet(f"{SF}/events.parquet").select(F.lit("generic").alias("model_type"), F.col("props").alias("value"))
    p = plan(route(df, small))
    assert p.count("Scan parquet") == 2 and "Exchange" not in p


def test_validation_runs_on_a_stream(spark):
    schema = spark.read.parquet(f"{SF}/orders.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(SF)
    assert validate(stream.select("o_orderstatus", "o_totalprice", "o_orderpriority"), reports.order_rules()).isStreaming
