"""JSON containment by scan and by index against a plain restatement."""

import json
import math

import pytest
from pyspark.sql import functions as F

from passagemill.operators.containment import containing, leaf_index, write_leaf_index

TEXTS = [
    '{"a": 1}', '{"a": 1.0}', '{"a": "1"}', '{"a": null}', '{"a": true}', "{}", "[]", "null", '"x"', "7", '["x", 7, ["y"]]', "broken {", None, "",
    '{"a": [1, 2, {"b": [null, "z"]}], "c": {"d.e": {"it\'s": "\\"q\\""}}}', '{"a": [{"b": "z"}, {"c": 1}]}', '{"a": {"a": {"a": {"a": -0.0}}}}',
    '{"a": 9007199254740993}', '{"a": 9007199254740992}', '{"a": 1e400}', '{"": {"": 5}}', '{"a": [], "b": {}}', '{"a": [[1, 2], [3]]}',
    '{"a": 123456789012345678901234567890}', '{"a": 2.5}', '{"a": 3}',
]
PATTERNS = [
    {}, [], "x", 7, None, {"a": 1}, {"a": "1"}, {"a": None}, {"a": True}, {"a": False}, {"a": [2]}, {"a": [2, 1, 1]}, {"a": [{"b": ["z"]}]},
    {"a": [{"b": [None]}]}, {"c": {"d.e": {"it's": '"q"'}}}, {"a": [{"b": "z", "c": 1}]}, {"a": [{"b": "z"}, {"c": 1}]}, {"a": {"a": {"a": {"a": 0}}}},
    {"a": 9007199254740993}, {"": {"": 5}}, {"a": []}, {"a": {}}, {"b": {}}, {"a": [[3]]}, {"a": [[1], [3]]}, {"a": [3]}, ["y"], [["y"]], [7, "x"],
    {"a": 123456789012345678901234567890}, {"a": 2.5}, {"a": 2}, {"missing": None},
]


def same(value, wanted):
    if isinstance(wanted, bool) or isinstance(value, bool) or wanted is None or value is None:
        return type(value) is type(wanted) and value == wanted
    if isinstance(wanted, str) or isinstance(value, str):
        return type(value) is type(wanted) and value == wanted
    return not isinstance(value, (dict, list)) and value == wanted


def holds(value, wanted):
    if isinstance(wanted, dict):
        return isinstance(value, dict) and all(k in value and holds(value[k], v) for k, v in wanted.items())
    if isinstance(wanted, list):
        return isinstance(value, list) and all(any(holds(x, v) for x in value) for v in wanted)
    return same(value, wanted)


def expected(text, pattern):
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return False
    if isinstance(value, dict) and isinstance(value.get("a"), float) and math.isinf(value["a"]):
        value["a"] = 0.125  # beyond a double; equal to no pattern here
    if not isinstance(pattern, (dict, list)) and isinstance(value, list):
        return any(same(x, pattern) for x in value)
    return holds(value, pattern)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, meta string").cache()


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("leaves") / "index")
    write_leaf_index(rows, "id", "meta", path, parts=4)
    return spark.read.parquet(path).cache()


@pytest.mark.parametrize("pattern", PATTERNS, ids=json.dumps)
def test_contains(rows, index, pattern):
    want = {i for i, text in enumerate(TEXTS) if expected(text, pattern)}
    assert {r["id"] for r in containing(rows, "id", "meta", pattern).collect()} == want
    assert {r["id"] for r in containing(rows, "id", "meta", pattern, index, parts=4).collect()} == want


def test_index_is_pruned_and_bounded(spark, rows, tmp_path):
    path = str(tmp_path / "index")
    write_leaf_index(rows, "id", "meta", path, parts=64)
    found = containing(rows, "id", "meta", {"a": 2.5}, spark.read.parquet(path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_empty_table(spark):
    none = spark.createDataFrame([], "id long, meta string")
    assert leaf_index(none, "id", "meta").count() == 0
    assert containing(none, "id", "meta", {"a": 1}, leaf_index(none, "id", "meta")).count() == 0


def test_a_scalar_repeated_in_a_text_counts_once(spark):
    rows = spark.createDataFrame([(1, '{"a": [1, 1, 1]}'), (2, '{"a": [1, 2]}')], "id long, meta string")
    index = leaf_index(rows, "id", "meta")
    assert index.groupBy("id").count().orderBy("id").select(F.collect_list("count")).first()[0] == [1, 2]
    assert [r["id"] for r in containing(rows, "id", "meta", {"a": [1, 2]}, index).collect()] == [2]


def test_shallow_texts_are_indexed_without_a_shuffle(spark, rows):
    plan = leaf_index(rows, "id", "meta")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Distinct" not in plan


def test_only_candidates_are_parsed(spark, rows, index):
    found = containing(rows, "id", "meta", {"a": [2]}, index, parts=4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Join", 1)[1].split("\n", 1)[1]
    assert "SchemaOfVariant" in plan and "SchemaOfVariant" not in below


@pytest.mark.parametrize("depth", [1, 6])
def test_leaves_at_any_depth(spark, depth):
    deep, pattern = [[5, 5, "x"]], [["x"]]
    for _ in range(depth):
        deep, pattern = {"k": [deep, deep, 1]}, {"k": [pattern]}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, "{}")], "id long, meta string")
    index = leaf_index(rows, "id", "meta").cache()
    # a 1 at each depth, and two scalars inside
    assert index.count() == index.distinct().count() == depth + 2
    assert [r["id"] for r in containing(rows, "id", "meta", pattern, index).collect()] == [1]
