"""Elements of short arrays have generated code of their own; arrays of any length give the same errors."""

import datetime as dt
import re

import pytest

from queries.structures import NARROW, Flat, structure_query
from tamis.functions import predicates
from tamis.models import STRUCTURES
from tamis.operators.validate import validate
from tamis.plans import compiler
from tamis.plans.ruleset import integer, optional, records, required, rule_set, text, texts

ITEM = rule_set("Item", text("code", required, min=2, max=5), text("link", optional, url=True), texts("tags", optional, each=dict(min=1)),
                integer("n", optional, nullable=True, gt=0))
BOX = rule_set("Box", text("name", required), records("items", ITEM, optional), text("note", optional, max=3), style="api")
TYPE = BOX.struct_type

GOOD = ("abc", "https://a.org/x", ["t"], 1)
BAD = ("x", "no link", ["t", ""], 0)
ARRAYS = [None, [], [GOOD], [BAD], [None], [GOOD, BAD], [BAD, None], [BAD, GOOD, BAD], [GOOD, GOOD, GOOD], [GOOD, None, GOOD, BAD, (None, None, None, None)]]


def found(spark, monkeypatch, unrolled):
    monkeypatch.setattr(compiler, "_unrolls", lambda rs: unrolled)
    rows = [(i, (name, items, note)) for i, items in enumerate(ARRAYS) for name, note in (("a", None), ("", "long"))]
    df = spark.createDataFrame(rows, f"k INT, record {TYPE}")
    return sorted(map(str, validate(df, BOX, root="record", as_of=dt.datetime(2025, 1, 1)).select("k", "is_valid", "errors").collect()))


def test_arrays_of_any_length_give_the_same_errors(spark, monkeypatch):
    ours = found(spark, monkeypatch, True)
    assert ours == found(spark, monkeypatch, False)
    assert any("Box.Items[1].Tags[1]" in r for r in ours) and any("Box.Items[3].Code" in r for r in ours)


@pytest.mark.parametrize("name", ["APIResponse", "APIEndpoint"])
def test_rules_of_fields_and_of_short_arrays_are_not_interpreted(spark, name):
    plain = STRUCTURES[name].with_(checks=(), extra_errors=())
    flat = Flat(plain, NARROW[1])
    record, _ = flat.structure(plain, "", "")
    sql = compiler.Compiler(plain, "`record`").errors()
    # what filter() and its like hold is interpreted: no rule of a field may lie there, save those of long arrays and of lists of texts
    assert not re.search(r"filter\(array\(CASE WHEN (\(|NOT |coalesce\()*`record`", sql)
    for f in plain.fields:
        if f.kind == "records":
            assert f"get(`record`.`{f.name}`, 0)" in sql and f"get(`record`.`{f.name}`, {compiler.UNROLLED - 1})" in sql


@pytest.mark.parametrize("value", ["", "a", "é", "éé", "abc", "ééé", "😀", "😀😀", "😀😀😀", "abcd", "éééé", "😀😀😀😀", "abcdefghijkl", "abcdefghijklm"])
def test_sizes_are_counted_in_code_points(spark, value):
    for name, wrong in {"min": len(value) < 3, "max": len(value) > 3, "gt": len(value) <= 3, "gte": len(value) < 3, "lte": len(value) > 3}.items():
        test = predicates.breaks(name, f"'{value}'", "text", 3)
        assert spark.sql(f"SELECT {test} AS b").first().b == wrong, name
    assert "octet_length" in predicates.breaks("max", "v", "text", 3)


def test_records_are_built_in_methods_the_jvm_compiles(spark, tmp_path):
    spark.range(100).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    assert len(structure_query("m31", STRUCTURES["APIEndpoint"], False).run(spark, str(tmp_path)).collect()) == 100
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
