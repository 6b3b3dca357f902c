"""Reports over growing tables, fail-fast waves, shared panes, words found once."""

import contextlib
import io
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis import Check, report, rule_set, validate
from tamis.functions import scalars
from tamis.functions.text import quote
from tamis.operators import ledger, waves
from tamis.operators import report as rep
from tamis.plans.ruleset import integer, optional, required, text
from tamis.streaming import continuous as cont

RULES = rule_set("Row", integer("a", required, gte=0), text("b", optional, max=3), style="generic",
                 checks=[Check("BIG", "$a > 50", "A", "a is {$a}", "$a")], title="RowValidator")


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def rows(spark, days, n=200):
    data = [(f"d{d}", "xyz"[i % 3] if i % 7 else None, (i * 37 + d) % 120 - 20, "long" if i % 11 == 0 else "ok", "p") for d in days for i in range(n)]
    return spark.createDataFrame(data, "day string, grp string, a long, b string, name string")


def checked(df):
    return validate(df, RULES)


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert sorted(str([r[c] for c in columns]) for r in a.collect()) == sorted(str([r[c] for c in columns]) for r in b.collect())


# -- ledger ------------------------------------------------------------------------------------------
def test_kept_parts_equal_the_whole(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    everything = checked(rows(spark, range(6)))
    ledger.add(checked(rows(spark, [0, 1], n=13)), folder, "day", ("grp",))  # to be replaced
    assert sorted(ledger.parts(spark, folder)) == ["d0", "d1"]
    ledger.add(everything.where("day IN ('d0', 'd1', 'd2')"), folder, "day", ("grp",))
    assert ledger.add_missing(everything, folder, "day", ("grp",)) == ["d3", "d4", "d5"]
    assert ledger.add_missing(everything, folder, "day", ("grp",)) == []
    kept = ledger.read(spark, folder)
    same(ledger.report_of(kept, 60.0), report(everything, 60.0))
    same(ledger.report_of(kept, by=["grp"]), report(everything, by=["grp"]))
    same(ledger.report_of(kept, 60.0, ["part"]).withColumnRenamed("part", "day"), report(everything, 60.0, ["day"]))
    for column in ("errors", "warnings"):
        same(ledger.codes_of(kept, column, ["grp"]), rep.by_code(everything, column, ["grp"]))
    for cube in (False, True):
        same(ledger.rollup_of(kept, "part", "grp", cube=cube).withColumnRenamed("part", "day"), rep.rollup(everything, "day", "grp", cube=cube))
    assert kept.count() < 6 * 4 * 12  # a few rows per part and group, whatever the number of rows


def test_only_missing_partitions_are_validated(spark, tmp_path):
    table, folder = str(tmp_path / "table"), str(tmp_path / "ledger")
    rows(spark, range(10)).write.partitionBy("day").parquet(table)
    ledger.add_missing(checked(spark.read.parquet(table)), folder, "day")
    rows(spark, [10]).write.partitionBy("day").mode("append").parquet(table)
    now = checked(spark.read.parquet(table))
    p = plan(ledger.partials(now.where(F.col("day").isin(["d10"])), "day"))
    assert "PartitionFilters" in p and "d10" in p[p.index("PartitionFilters"):].split("\n")[0]
    assert p.split("\n\n")[0].count("Exchange") == 1 and "partial_count" in p  # one shuffle, of rows added up before
    assert ledger.add_missing(now, folder, "day") == ["d10"]
    same(ledger.report_of(ledger.read(spark, folder), 50.0), report(now, 50.0))


def test_ledger_of_nothing_and_null_parts(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    assert ledger.parts(spark, folder) == []
    none = checked(rows(spark, []))
    ledger.add(none, folder, "day")
    assert ledger.parts(spark, folder) == [] and ledger.add_missing(none, folder, "day") == []
    same(ledger.report_of(ledger.read(spark, folder), 50.0), report(none, 50.0))
    odd = checked(rows(spark, [1]).withColumn("day", F.when(F.col("a") > 0, F.lit("007"))))  # null, and text that looks like a number
    ledger.add(odd, folder, "day")
    ledger.add(odd, folder, "day")
    same(ledger.report_of(ledger.read(spark, folder)), report(odd))
    assert {r.part for r in ledger.read(spark, folder).select("part").distinct().collect()} == {None, "007"}


# -- waves -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("bad, budget, looked_at", [([], 1, 12), ([0], 1, 1), ([1], 1, 3), ([2, 5], 1, 3), ([5], 1, 7), ([11], 1, 12), ([0, 4, 9], 2, 7), ([0, 4, 9], 5, 12)])
def test_fail_fast(spark, tmp_path, bad, budget, looked_at):
    for i in range(12):
        spark.range(5, numPartitions=1).selectExpr("id", f"CASE WHEN {i} IN ({', '.join(map(str, bad)) or -1}) AND id = 3 THEN -1L ELSE id + 1 END AS a",
                                                   "'x' AS b", f"{i} AS file").write.parquet(str(tmp_path / f"f{i:02}"))
    files = [spark.read.parquet(str(tmp_path / f"f{i:02}")).inputFiles()[0] for i in range(12)]
    out = waves.fail_fast(spark, files, checked, "id", budget=budget)
    assert [(r.file, r.id) for r in out.failures.collect()] == [(i, 3) for i in bad[:budget]]
    assert (out.files, out.spent) == (looked_at, len(bad) >= budget)
    backwards = waves.fail_fast(spark, files[::-1], checked, "id", budget=budget)
    assert [r.file for r in backwards.failures.collect()] == bad[::-1][:budget]


# -- panes -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("length, slide", [("1 hour", "20 minutes"), ("50 minutes", "20 minutes"), ("7 minutes", "7 minutes"), ("90 seconds", "60 seconds")])
def test_sliding_gates_share_panes(spark, length, slide):
    at = spark.range(3000).selectExpr("timestamp_micros(id * 37000000 - 20000000000 + id % 7 * 1000001) AS ts", "id % 3 AS grp", "id % 90 - 10 AS a", "'b' AS b")
    v = checked(at)
    got = cont.windowed_gate(v, "ts", length, slide, 70.0, ("grp",))
    copied = rep.counts(v, [F.window("ts", length, slide), "grp"]).withColumn("success_rate", rep.success_rate()).withColumn("status", rep.gate(70.0))
    same(got, copied.withColumn("window_start", F.col("window.start")).withColumn("window_end", F.col("window.end")).drop("window"))
    p = plan(got)
    assert "Expand" not in p and p.index("Generate") < p.index("HashAggregate", p.index("Generate"))  # only pane rows are copied into windows
    tree = p.split("\n\n")[0]
    assert tree.index("Generate") < tree.index("Exchange", tree.index("Generate")) < tree.index("Scan" if "Scan" in tree else "Range")


# -- words -------------------------------------------------------------------------------------------
WORDS = ["ab", "b", "abc", "ca", "'", "a b"]


@settings(max_examples=30, deadline=None, database=None)
@given(st.lists(st.text("abc '", max_size=12), min_size=1, max_size=5))
def test_word_bits(spark, texts):
    bits = scalars.WordBits("w", "t", WORDS[:3], WORDS[2:])
    lists = [WORDS, WORDS[1:3], ["a b"], ["ca", "ab"]]
    made = {f"{kind}{i}": sql for i, ws in enumerate(lists) for kind, sql in {
        "any": bits.any(ws), "first": bits.first(ws), "all": bits.all(ws), "missing": bits.all(ws, missing=True), "count": bits.count(ws), "lacks": bits.count(ws, missing=True)}.items()}
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", f"{bits.let['w']} AS found")
    for r in df.selectExpr("t", *[f"{sql.replace('$:w', 'found')} AS {name}" for name, sql in made.items()]).collect():
        for i, ws in enumerate(lists):
            held = [w for w in ws if w in r.t]
            lacking = [w for w in ws if w not in r.t]
            assert (r[f"any{i}"], r[f"first{i}"], r[f"all{i}"], r[f"missing{i}"], r[f"count{i}"], r[f"lacks{i}"]) == (
                bool(held), held[0] if held else None, ", ".join(held), ", ".join(lacking), len(held), len(lacking))


def test_each_word_is_searched_once(spark):
    from queries import models
    p = plan(models.QUERY.validated(spark, "/root/testdata/sf0.001"))
    assert p.split("\n\n")[0].count("Project") <= 8
    words = list(itertools.chain(models.QUERY.rules.lets[0][1].split("array(")[2].split(")")[0].split("', '")))
    assert len(words) == len(set(words)) > 40
    checks = " ".join(str(c.when) + c.message for c in models.QUERY.rules.checks if isinstance(c, Check))
    assert "contains(" not in checks and quote("union select") in checks
