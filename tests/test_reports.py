import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis import Check, bad_rows, good_rows, report, rule_set, summarize, validate, write_split
from tamis.operators import report as rep
from tamis.plans.ruleset import integer, optional, real, required, text, texts, time

RULES = rule_set(
    "Row", integer("a", required, gte=0), text("b", optional, max=3), texts("c", optional, each=dict(min=1)), style="generic",
    checks=[Check("BIG", "$a > 50", "A", "a is {$a}", "$a")], title="RowValidator")
ROWS = st.lists(st.tuples(
    st.one_of(st.none(), st.integers(-5, 100)), st.one_of(st.none(), st.text("ab", max_size=5)),
    st.one_of(st.none(), st.lists(st.one_of(st.none(), st.sampled_from(["", "x"])), max_size=3))), max_size=30)


def expected(a, b, c):
    errors = ["required"] if not a else ["gte"] if a < 0 else []
    errors += ["max"] if b and len(b) > 3 else []
    errors += ["min" for x in c or [] if not x]
    warnings = ["BIG"] if not errors and a > 50 else []
    return errors, warnings


@settings(max_examples=8, deadline=None, database=None)
@given(ROWS)
def test_random_rows(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, a long, b string, c array<string>")
    v = validate(df, RULES)
    out = {r.k: r for r in v.collect()}
    for i, row in enumerate(rows):
        errors, warnings = expected(*row)
        assert [e.code for e in out[i].errors] == errors
        assert [w.code for w in out[i].warnings] == warnings
        assert out[i].is_valid == (not errors)
    s = summarize(v).first()
    assert s.valid_records + s.invalid_records == s.total_records == len(rows)
    assert s.validation_errors == sum(len(expected(*r)[0]) for r in rows)


@pytest.mark.parametrize("valid, invalid, threshold, status", [
    (20, 80, 20.0, "success"), (21, 79, 20.0, "success"), (19, 81, 20.0, "failed"), (50, 50, None, "success"), (1, 0, None, "success"),
    (0, 1, None, "failed"), (20001, 79999, 20.0, "success"), (19999, 80001, 20.0, "failed"), (57, 43, 57.0, "failed"), (0, 0, 50.0, "failed")])
def test_gate(spark, valid, invalid, threshold, status):
    df = spark.range(1).select(F.lit(valid).alias("valid_records"), F.lit(invalid).alias("invalid_records"),
                               F.lit(valid + invalid).alias("total_records")).withColumn("success_rate", rep.success_rate())
    assert df.select(rep.gate(threshold)).first()[0] == status


def sample(spark):
    return validate(spark.createDataFrame([(1, 5, "x"), (2, -1, "abcd"), (3, 60, "y"), (4, None, "z")], "k long, a long, b string").withColumn(
        "c", F.lit(None).cast("array<string>")), RULES)


def test_breakdowns(spark, tmp_path):
    v = sample(spark)
    assert {r.code: r.n for r in rep.by_code(v).collect()} == {"gte": 1, "max": 1, "required": 1}
    assert rep.by_code_map(v).first()[0] == {"gte": 1, "max": 1, "required": 1}
    assert [r.code for r in rep.common_errors(v, 2).collect()] == ["gte", "max"]
    assert rep.first_failure(v, "k").first().k == 2
    assert rep.has_failure(v) and not rep.has_failure(v.filter("is_valid"))
    assert {(r.field, r.code) for r in rep.by_field(v).collect()} == {("A", "gte"), ("B", "max"), ("A", "required")}
    assert [r.k for r in bad_rows(v).orderBy("k").collect()] == [2, 4]
    assert [r.k for r in bad_rows(v, include_warnings=True).orderBy("k").collect()] == [2, 3, 4]
    assert [r.k for r in good_rows(v, with_warnings=False).collect()] == [1]
    written = write_split(v, str(tmp_path / "out"))
    assert written.filter("is_valid").count() == 2
    assert report(written, 50.0).first().asDict() == report(v, 50.0).first().asDict()


def test_slow_and_batch(spark):
    v = sample(spark).withColumn("ms", F.col("k") * 40.0).withColumn("request", F.lit("r"))
    assert [(r.is_slow, len(r.warnings)) for r in rep.flag_slow(v, "ms").orderBy("k").collect()] == [(False, 0), (False, 0), (True, 2), (True, 1)]
    assert rep.batch_response(v, "request").first().asDict() == {
        "request": "r", "total_count": 4, "valid_count": 2, "invalid_count": 2, "oversized": False}


def test_result_names_are_protected(spark):
    with pytest.raises(ValueError):
        validate(spark.createDataFrame([(1,)], "errors int"), RULES)


def test_user_checks_and_base_style(spark):
    rules = rule_set("Order", real("total", required, gt=0), text("mail", optional, email=True), model_type="order")
    v = validate(spark.createDataFrame([(0.0, "x"), (5.0, None)], "total double, mail string"), rules,
                 checks=[Check("SMALL", "$total < 10", "Total", "only {$total}")], labels=True)
    rows = v.orderBy("total").collect()
    assert [e.code for e in rows[0].errors] == ["REQUIRED_FIELD_MISSING", "INVALID_EMAIL_FORMAT"]
    assert rows[0].errors[0].message == "Field 'Total' is required"
    assert [w.message for w in rows[1].warnings] == ["only 5.0"]


def test_columns_of_a_plain_table(spark):
    """Times without zone, decimals and short integers of an ordinary table are accepted."""
    rules = rule_set("T", time("at", required, gtefield="since"), time("since"), real("d", gt=0), integer("i", required), style="generic")
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' AS at, TIMESTAMP_NTZ '2024-01-02 00:00:00' AS since,"
                   " CAST(0 AS DECIMAL(10, 2)) AS d, CAST(1 AS SMALLINT) AS i")
    assert [e.code for e in validate(df, rules).first().errors] == ["gtefield", "gt"]
