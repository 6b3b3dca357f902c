import json

import pytest
from pyspark.sql import functions as F

from tamis import CATALOG, decode
from tamis.plans.ruleset import flag, integer, natural, real, record, records, rule_set, text, text_map, texts, value_map, values
from tamis.sources.records import read_requests, record_identifier, request_records, typed_identifier, with_row_index

MIXED = rule_set("Mixed", text("s"), integer("i"), real("f"), flag("b"), texts("l"), text_map("m"), value_map("v"), values("a"), natural("n"))


def one(spark, record, mode):
    df = spark.createDataFrame([(record if isinstance(record, str) else json.dumps(record),)], "value string")
    row = decode(df, MIXED, mode=mode).first()
    return None if row.undecodable else row.record.asDict()


STRICT_BAD = [
    {"s": 5}, {"s": True}, {"s": {}}, {"i": "5"}, {"i": 3.7}, {"i": 10**20}, {"i": True}, {"f": "1.5"}, {"b": "true"}, {"b": 1},
    {"l": "x"}, {"l": ["a", 5]}, {"m": {"k": 1}}, {"m": []}, {"v": "x"}, {"a": {}}, {"n": -1}, {"n": "1"}, [{"s": "x"}], "broken {", '"text"', "7"]


@pytest.mark.parametrize("record", STRICT_BAD, ids=str)
def test_strict_rejects(spark, record):
    assert one(spark, record, "strict") is None


@pytest.mark.parametrize("record, field, value", [
    ({"s": "x"}, "s", "x"), ({"s": None}, "s", None), ({"i": 5}, "i", 5), ({"f": 1}, "f", 1.0), ({"b": False}, "b", False),
    ({"l": ["a", None]}, "l", ["a", None]), ({"m": {"k": "v"}}, "m", {"k": "v"}), ({"v": {"k": 1}}, "v", {"k": "1"}),
    ({"a": [1, "x"]}, "a", ["1", "x"]), ({"unknown": 1}, "s", None)], ids=str)
def test_strict_accepts(spark, record, field, value):
    assert one(spark, record, "strict")[field] == value


@pytest.mark.parametrize("record, field, value", [
    ({"s": 5}, "s", "5"), ({"s": 1234567}, "s", "1.234567e+06"), ({"s": True}, "s", "true"), ({"i": 42.5}, "i", 42), ({"i": -3.9}, "i", -3),
    ({"i": "42"}, "i", 42), ({"i": "12abc"}, "i", 12), ({"i": " -7"}, "i", -7), ({"f": "42.5"}, "f", 42.5), ({"f": "1e3x"}, "f", 1000.0),
    ({"f": 42}, "f", 42.0), ({"l": ["a", 5, None]}, "l", ["a", "5", ""]), ({"m": {"k": 1}}, "m", {"k": "1"}), ({"b": True}, "b", True),
    ({"n": 42.5}, "n", 42), ({"n": 0}, "n", 0)], ids=str)
def test_lenient_converts(spark, record, field, value):
    assert one(spark, record, "lenient")[field] == value


@pytest.mark.parametrize("record", [{"i": "abc"}, {"i": True}, {"i": []}, {"i": "99999999999999999999"}, {"f": "abc"}, {"b": 1}, {"b": "true"},
                                    {"l": "not a list"}, {"m": "not a map"}, {"v": 3}, {"n": -1.5}, {"n": "42"}, "{broken"],
                         ids=str)
def test_lenient_rejects(spark, record):
    assert one(spark, record, "lenient") is None


@pytest.mark.parametrize("value, ok", [
    ("2025-01-04T10:00:00Z", True), ("2025-01-04T10:00:00.5+02:00", True), ("2025-01-04T10:00:00.123456789Z", True),
    ("2025-01-04 10:00:00", False), ("2025-01-04", False), ("2025-01-04T10:00:00", False), (1736000000, False)])
@pytest.mark.parametrize("mode", ["strict", "lenient"])
def test_times_are_rfc_3339(spark, value, ok, mode):
    df = spark.createDataFrame([(json.dumps({"reported_at": value}),)], "value string")
    assert decode(df, CATALOG["incident"], mode=mode).first().undecodable is not ok


@pytest.mark.parametrize("record, found", [
    ({"id": "a"}, "a"), ({"ID": "b"}, "b"), ({"_id": "c"}, "c"), ({"uuid": "d"}, "d"), ({"UUID": "e"}, "e"), ({"identifier": "f"}, "f"),
    ({"recordId": "g"}, "g"), ({"record_id": "h"}, "h"), ({"id": None, "uuid": "u"}, "u"), ({"id": ""}, ""), ({"id": 12}, "12"),
    ({"id": 12345678}, "1.2345678e+07"), ({"name": "x"}, "row_3")], ids=str)
def test_identifiers(spark, record, found):
    df = spark.createDataFrame([(json.dumps(record), 3)], "value string, row_index long")
    assert df.select(record_identifier()).first()[0] == found


def test_typed_identifier_and_row_index(spark):
    df = with_row_index(spark.range(100).selectExpr("id * 37 % 1009 AS place", "if(id % 2 = 0, id, null) AS uuid"), "place", 50)
    rows = df.withColumn("x", typed_identifier(df.columns)).orderBy("place").collect()
    assert [r.row_index for r in rows] == list(range(100))
    assert all(r.x == (str(r.uuid) if r.uuid is not None else f"row_{r.row_index}") for r in rows)


@pytest.mark.parametrize("expr", ["id * id * id", "id", "pmod(xxhash64(id), 1000000000000)", "if(id < 90, id, id * 1000000000)", "if(id = 3, null, -id)"])
def test_row_index_of_any_keys(spark, expr):
    df = spark.range(120).selectExpr("id", f"{expr} AS place")
    rows = with_row_index(df, "place", ranges=7).orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(120))
    assert [r.id for r in rows] == [r.id for r in df.orderBy(F.col("place").asc_nulls_first()).collect()]
    assert with_row_index(df.limit(0), "place").collect() == []


@pytest.mark.parametrize(("text", "field", "value"), [
    ('{"i": 3.0}', "i", 3), ('{"i": 1e1}', "i", 10), ('{"n": 2.0}', "n", 2), ('{"i": 1, "i": 2}', "i", 2), ('{"s": 5, "s": "x"}', "s", "x"),
    ('{"i": 9007199254740993}', "i", 9007199254740993), ('{"i": 3.0, "s": "{\\"i\\": 1.0}"}', "s", '{"i": 1.0}')])
def test_strict_accepts_odd_inputs(spark, text, field, value):
    assert one(spark, text, "strict")[field] == value


@pytest.mark.parametrize("text", ['{"i": 3.5}', '{"i": 1e40}', '{"s": "x", "s": 5}', '{"n": -1.0}', '{"i": 9223372036854775808}'])
def test_strict_refuses_odd_inputs(spark, text):
    assert one(spark, text, "strict") is None


def test_lenient_takes_the_last_of_repeated_keys(spark):
    assert one(spark, '{"s": "a", "s": 5}', "lenient")["s"] == "5"


def test_envelopes(spark):
    envelopes = [{"model_type": "a", "data": [{"x": 1}, {"x": 2}], "threshold": 80}, {"model_type": "b", "payload": {"y": 1}, "data": []}]
    df = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(envelopes)], "k long, value string")
    rows = request_records(read_requests(df)).orderBy("k", "row_index").collect()
    assert [(r.k, r.is_array, r.row_index, r.value, r.threshold) for r in rows] == [
        (0, True, 0, '{"x":1}', 80.0), (0, True, 1, '{"x":2}', 80.0), (1, False, 0, '{"y":1}', None)]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        decode(spark.createDataFrame([("{}",)], "value string"), MIXED, mode="other")


def test_ranges_of_row_numbers(spark):
    import bisect
    from tamis.sources.records import _range_sql
    for n in (1, 2, 3, 10, 99, 100, 101):
        bounds = [float(i * 3) for i in range(n)]
        values = [-1.0, 0.0, *[b + d for b in bounds for d in (-0.5, 0.0, 0.5)]]
        rows = spark.createDataFrame([(v,) for v in values], "v double").selectExpr("v", f"{_range_sql(bounds, 'v')} AS r").collect()
        assert [r.r for r in rows] == [bisect.bisect_left(bounds, r.v) for r in rows]


# -- keys in other case ------------------------------------------------------------------------------
CASED = rule_set("Cased", text("userId"), text("title"), integer("n"), text_map("free"), record("who", rule_set("Who", text("login"))),
                 records("items", rule_set("Item", integer("id"), record("owner", rule_set("Owner", text("name"))))))


def cased(spark, value, mode="strict", rules=CASED):
    row = decode(spark.createDataFrame([(value if isinstance(value, str) else json.dumps(value),)], "value string"), rules, mode=mode).first()
    return None if row.undecodable else row.record.asDict(recursive=True)


@pytest.mark.parametrize("record, field, value", [
    ({"Title": "a"}, "title", "a"), ({"TITLE": "a", "title": "b"}, "title", "b"), ({"title": "b", "TITLE": "a"}, "title", "b"),
    ({"TITLE": "a", "Title": "c"}, "title", "c"), ({"USERID": "u"}, "userId", "u"), ({"userid": "u"}, "userId", "u"), ({"userId": "x", "userid": "y"}, "userId", "y"),
    ({"Who": {"LOGIN": "l", "Other": 1}}, "who", {"login": "l"}), ({"WHO": None}, "who", None), ({"Free": {"Title": "t", "ID": "i"}}, "free", {"Title": "t", "ID": "i"}),
    ({"Items": [{"ID": 1, "Owner": {"NAME": "o"}}, {}, {"id": 2}]}, "items", [{"id": 1, "owner": {"name": "o"}}, {"id": None, "owner": None}, {"id": 2, "owner": None}]),
    ({"N": 3.0}, "n", 3), ({"tıtle": "no", "Title ": "no"}, "title", None), ('{"Title": "a \\"Title\\": b\\u00e9", "N": 1}', "title", 'a "Title": bé'),
    ('{"Title": "a", "Title": "b"}', "title", "b"), ('{"TITLE"  \n: "a"}', "title", "a")], ids=str)
def test_keys_in_other_case(spark, record, field, value):
    assert cased(spark, record)[field] == value


def test_the_long_s_and_the_kelvin_sign_fold(spark):
    rules = rule_set("Folded", text("key"), text("sort"))
    assert cased(spark, '{"\u212aey": "a", "\u017fort": "b"}', rules=rules) == {"key": "a", "sort": "b"}


@pytest.mark.parametrize("record", [{"Title": 5}, {"Who": {"Login": 1}}, {"Items": [{"ID": "x"}]}, {"WHO": []}, {"ITEMS": {}}, '{"Title": "a"', '["Title"]'], ids=str)
def test_wrong_types_under_other_keys_are_rejected(spark, record):
    assert cased(spark, record) is None


def test_lenient_records_fold_below_the_top_only(spark):
    assert cased(spark, {"Title": "a", "who": {"LOGIN": "l"}, "items": [{"ID": 1}]}, "lenient") == {
        "userId": None, "title": None, "n": None, "free": None, "who": {"login": "l"}, "items": [{"id": 1, "owner": None}]}


def test_long_texts_are_searched_in_linear_time(spark):
    import time
    value = json.dumps({"title": "A\\" * 200_000 + "a" * 400_000, "n": 1})
    start = time.perf_counter()
    assert cased(spark, value)["n"] == 1
    assert time.perf_counter() - start < 20
