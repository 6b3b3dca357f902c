"""Structures that nest in themselves: what a level costs, and what lies below the unrolled levels."""

import json

import pytest

from tamis.models.api import SCHEMA
from tamis.models.database import PLAN_OPERATION
from tamis.models.github import TEAM
from tamis.operators.validate import validate
from tamis.plans import nesting
from tamis.plans.ruleset import RuleSet, optional, record, rule_set, text
from tamis.sources import kinds
from tamis.sources.decode import decode, type_clash_sql


def test_a_step_is_taken_out_of_its_variant_once_per_level_and_for_what_is_misplaced():
    sql = type_clash_sql(TEAM, "v")
    assert sql.count("try_variant_get(ws0, '$.parent', 'variant')") <= 3
    assert "map<string, variant>" not in sql


@pytest.mark.parametrize("inner", ['{"type": "string"}', '[]', '[{"type": "string"}]', '"{}"', "1", "true", "null", "{}", '{"items": 1}', '{"items": null}'])
def test_kinds_below_the_unrolled_levels(spark, inner):
    text = '{"type": "array", "items": ' * 6 + inner + "}" * 6
    row = decode(spark.createDataFrame([(text,)], "value string"), SCHEMA).collect()[0]
    value = json.loads(inner)
    while isinstance(value, dict) and "items" in value:
        value = value["items"]
    assert row["undecodable"] == (not isinstance(value, dict) and value is not None)


@pytest.mark.parametrize("depth, name", [(5, "{"), (40, "x"), (70, "{[\\\"{"), (150, "{")])
def test_all_steps_are_reached_however_deep(spark, depth, name):
    step = '{"type": "array", "title": "' + name + '", "items": '
    text = step * depth + '{"type": "odd", "min_length": -1}' + "}" * depth
    v = validate(decode(spark.createDataFrame([(text,)], "value string"), SCHEMA), SCHEMA, root="record", undecodable="undecodable")
    found = [f"{e['path']}:{e['code']}" for e in v.collect()[0]["errors"]]
    place = "APISchema" + ".Items" * depth
    assert found == [f"{place}.Type:oneof", f"{place}.MinLength:gte"]


def test_few_brackets_are_counted_without_a_search_for_strings(spark):
    texts = ["", "{}", '{"a": {"b": {}}}', '{"a": "{{{{"}', "{" * 100 + "}" * 100]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(nesting.depth_sql("t")).collect()]
    assert got[:4] == [1, 2, 4, 6]
    assert got[4] >= 100


PLAN = rule_set("Plan", text("name", optional, min=2), record("top", PLAN_OPERATION))
ODD = {
    "single": [
        '{"id": 1}', '{"id": "1"}', '{"id": 1.0}', '{"id": 1e1}', '{"id": 12345678901234567890}', '{"id": true}', '{"id": null, "name": null}', '{"name": 5}',
        '{"name": "a\\"b", "slug": "\\\\"}', '{"n\\u0061me": 5}', '{"x": {"name": 5}}', '{"x": [{"id": "1"}], "name": "n"}', '{"name": "\\"id\\": \\"1\\""}',
        '{"name": 5, "name": "n"}', '{"name": "n", "name": 5}', '{"name" : {}}', '{ "id"\n: "1" }', '[]', '[{}]', '"x"', '5', 'null', '{"parent": []}', '{"parent": null}',
        '{"parent": {"parent": "x"}}', '{"Name": 5}', '{"x}, 5": 1, "url": "},5"}'],
    "many": [
        '[]', '[{}]', '[null]', '[{}, null, {"type": "a"}]', '[{}, 5]', '[{}, "x"]', '[{}, "x\\"y"]', '[null, true]', '[null, [1]]', '["x"]', '[[{}]]', '{}', '5', 'null', '"x"',
        '[{"type": 1}]', '[{"rows": "5"}]', '[{"rows": 5.0}, {"type": "a", "rows": -1}]', '[{"rows": 1.5}]', '[{"cost": 1.5, "duration": -2}]', '[{"cost": "1.5"}]',
        '[{"sort": ["a", null, ""]}]', '[{"sort": [1]}]', '[{"sort": {}}]', '[{"sort": [' + ", ".join(['"a"'] * 40) + ', ""]}]', '[{"join": {"type": "INNER", "rows": "5"}}]',
        '[{"join": {"type": 5}}]', '[{"join": []}]', '[{"x": {"type": 5}}]', '[{"type": "},{ 5"}]', '[{"type": "a\\u007db", "children": [{"rows": -1}, null, {}]}]'],
}


def checked(spark, rules, values):
    v = validate(decode(spark.createDataFrame(list(enumerate(values)), "k INT, value STRING"), rules), rules, root="record", undecodable="undecodable")
    return [(r.undecodable, [(e.path, e.code, e.value) for e in r.errors]) for r in v.orderBy("k").collect()]


def nested(name, depth):
    if name == "single":
        return [('{"id": 3, "slug": "s", "parent": ' * depth) + t + "}" * depth for t in ODD[name]]
    return ['{"top": ' + ('{"type": "x", "children": [{"type": ""}, ' * depth) + '{"type": "y", "children": ' + t + "}" + "]}" * depth + "}" for t in ODD[name]]


@pytest.mark.parametrize("name, rules", [("single", TEAM), ("many", PLAN)])
def test_kinds_judged_by_the_text_are_those_of_the_variant(spark, monkeypatch, name, rules):
    values = [v for depth in (0, 2, 3) for v in nested(name, depth)]
    ours = checked(spark, rules, values)
    monkeypatch.setattr(kinds, "suspect_sql", lambda rules, text: "true")
    monkeypatch.setattr(kinds, "suspect_below_sql", lambda f, text: "true")
    monkeypatch.setattr(kinds, "wrong_below_sql", lambda f, text: "false")
    assert ours == checked(spark, rules, values)
    assert 0 < sum(bad for bad, _ in ours) < len(ours)


@pytest.mark.parametrize("name, rules", [("single", TEAM), ("many", PLAN)])
def test_several_levels_at_once_give_the_steps_of_single_ones(spark, monkeypatch, name, rules):
    values = [v for depth in (2, 9, 20) for v in nested(name, depth)]
    ours = checked(spark, rules, values)

    def singly(f, text, prefix, level, options):
        found = nesting._steps_singly_sql(f, RuleSet(f.of.name, nesting.judged_fields(f.of)), text, prefix, level, options)
        return f"if({text} IS NULL, array(), {found})"

    monkeypatch.setattr(nesting, "steps_sql", singly)
    assert ours == checked(spark, rules, values)
    assert any(len(errors) > 20 for _, errors in ours)


def test_right_records_are_not_taken_apart(spark):
    f = kinds.deep_fields(TEAM)[0]
    text = '{"id": 1, "name": "n", "parent": {"id": 0, "description": null}}'
    df = spark.createDataFrame([(text,), (text.replace("0", '"0"'),)], "t string")
    rows = df.selectExpr(kinds.suspect_sql(TEAM, "t"), kinds.suspect_below_sql(f, "t"), kinds.wrong_below_sql(f, "replace(t, ' ', '')")).collect()
    assert [tuple(r) for r in rows] == [(False, False, False), (True, True, True)]
