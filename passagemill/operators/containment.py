"""JSON containment of metadata, and an index of leaf values to find candidates by.

A document contains a pattern if every key of the pattern's objects is there with a containing value, every element of
its arrays is contained in some element (order and repeats do not matter), and scalars of the same type are equal. At the
top an array also contains a bare scalar. Whole numbers are compared exactly up to 38 digits, others as doubles.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import stored

OBJECT, ARRAY = "map<string,variant>", "array<variant>"
_STEP = "\x1f"  # a path is its steps, each behind this character; the step of an array is empty
_EXACT = 10**38
_LEVELS = 4  # of nesting opened in one pass


def _scalar(value: Column, wanted: Any) -> Column:
    kind = F.schema_of_variant(value)
    if wanted is None:
        return F.is_variant_null(value)
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(wanted))
    same = kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (F.try_variant_get(value, "$", "double") == F.lit(float(wanted)))
    if isinstance(wanted, int) and abs(wanted) < _EXACT:
        same = same & (F.try_variant_get(value, "$", "decimal(38,0)") == F.lit(str(wanted)).cast("decimal(38,0)"))
    return same


def _some(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(items, lambda item: F.coalesce(test(item), F.lit(False)))


def _holds(value: Column, wanted: Any) -> Column:
    if isinstance(wanted, dict):
        fields = F.try_variant_get(value, "$", OBJECT)
        found = F.schema_of_variant(value).startswith("OBJECT")
        for name, inner in wanted.items():
            found = found & F.map_contains_key(fields, name) & _holds(F.element_at(fields, F.lit(name)), inner)
        return found
    if isinstance(wanted, list):
        items = F.try_variant_get(value, "$", ARRAY)
        found = F.schema_of_variant(value).startswith("ARRAY")
        for inner in wanted:
            found = found & _some(items, partial(_holds, wanted=inner))
        return found
    return _scalar(value, wanted)


def contains(column: Column, pattern: Any) -> Column:
    """Whether the JSON text holds ``pattern`` (a dict, list or scalar); false for null and for broken JSON."""
    value = F.try_parse_json(column)
    found = _holds(value, pattern)
    if not isinstance(pattern, (dict, list)):
        items = F.try_variant_get(value, "$", ARRAY)
        inside = _some(items, partial(_scalar, wanted=pattern))
        found = F.coalesce(found, F.lit(False)) | F.coalesce(inside, F.lit(False))
    return F.coalesce(found, F.lit(False))


def _leaf_text(value: Column) -> Column:
    """A scalar with its type; null for objects and arrays. Equal scalars have equal texts."""

    def text(kind: Column) -> Column:
        return (
            F.when(F.is_variant_null(value), F.lit("z"))
            .when(kind == "BOOLEAN", F.concat(F.lit("b"), F.try_variant_get(value, "$", "string")))
            .when(kind == "STRING", F.concat(F.lit("s"), F.try_variant_get(value, "$", "string")))
            .when(~(kind.startswith("OBJECT") | kind.startswith("ARRAY")), F.concat(F.lit("n"), (F.try_variant_get(value, "$", "double") + F.lit(0.0)).cast("string")))
        )

    return let(F.schema_of_variant(value), text)


def _leaf_texts(pattern: Any, path: str = "") -> Iterator[tuple[str, Column]]:
    if isinstance(pattern, dict):
        for name, inner in pattern.items():
            yield from _leaf_texts(inner, path + _STEP + name)
    elif isinstance(pattern, list):
        for inner in pattern:
            yield from _leaf_texts(inner, path + _STEP)
    else:
        yield path, _leaf_text(F.try_parse_json(F.lit(json.dumps(pattern))))


def _leaf_hash(path: Column, text: Column) -> Column:
    return F.xxhash64(path, text)


def _item(path: Column, value: Column) -> Column:
    return F.struct(path.alias("path"), value.alias("value"), _leaf_text(value).alias("text"))


def _inner(item: Column) -> Column:
    """The items directly inside an object or array."""
    fields = F.transform(
        F.map_entries(F.try_variant_get(item["value"], "$", OBJECT)),
        lambda e: _item(F.concat(item["path"], F.lit(_STEP), e["key"]), e["value"]),
    )
    items = F.transform(
        F.try_variant_get(item["value"], "$", ARRAY), lambda v: _item(F.concat(item["path"], F.lit(_STEP)), v)
    )
    return F.coalesce(fields, items)


def leaf_index(rows: DataFrame, key: str, column: str, parts: int = 64) -> DataFrame:
    """(part, leaf, key): the scalars of every row's JSON with their paths, as hashes; distinct where keys are.

    Some levels of nesting are opened inside a row, in one pass and without a shuffle. What is nested deeper becomes rows that are
    opened in the same way, until none is left. Every pass is stored, so its work is done once. Written
    partitioned by ``part`` (``write_leaf_index``), a search reads the parts of its leaves alone.
    """
    level = rows.select(key, F.lit("").alias("_path"), F.try_parse_json(column).alias("_value")).filter("_value IS NOT NULL")
    passes: list[DataFrame] = []
    while True:
        opened = level.select(key, F.array(_item(F.col("_path"), F.col("_value"))).alias("_0"))
        for depth in range(1, _LEVELS + 1):
            boxes = F.filter(f"_{depth - 1}", lambda item: item["text"].isNull())
            opened = opened.withColumn(f"_{depth}", F.flatten(F.transform(boxes, _inner)))
        found = F.concat(*[
            F.transform(F.filter(f"_{depth}", lambda item: item["text"].isNotNull()), lambda item: _leaf_hash(item["path"], item["text"]))
            for depth in range(_LEVELS + 1)
        ])
        deeper = F.transform(
            F.filter(f"_{_LEVELS}", lambda item: item["text"].isNull()),
            lambda item: F.struct(item["path"].alias("path"), F.to_json(item["value"]).alias("json")),
        )
        done = stored(opened.select(key, F.array_distinct(found).alias("leaves"), deeper.alias("deeper")), "json_leaves")
        passes.append(done.select(key, F.explode("leaves").alias("leaf")))
        level = done.filter(F.size("deeper") > 0).select(key, F.explode("deeper").alias("_e"))
        if level.isEmpty():
            break
        level = level.select(key, F.col("_e.path").alias("_path"), F.parse_json("_e.json").alias("_value"))
    # a path is as long as its scalar is deep, so that only the later passes can repeat a leaf of a row
    found = passes[0] if len(passes) == 1 else passes[0].unionByName(reduce(DataFrame.unionByName, passes[1:]).distinct())
    return found.select(F.pmod("leaf", F.lit(parts)).cast("int").alias("part"), "leaf", key)


def write_leaf_index(rows: DataFrame, key: str, column: str, path: str, parts: int = 64) -> None:
    """The index as folders by part, sorted by leaf inside them so that row groups are skipped too."""
    index = leaf_index(rows, key, column, parts)
    index.repartition("part", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("part", "leaf").write.partitionBy("part").mode("overwrite").parquet(path)


def containing(rows: DataFrame, key: str, column: str, pattern: Any, index: DataFrame | None = None, parts: int = 64) -> DataFrame:
    """The rows whose JSON contains ``pattern``; with an index only rows that have all its scalars are parsed.

    Hashes, and scalars that stand in different elements of an array, give candidates only; every candidate is
    verified. A pattern without scalars (``{}``) and one that is no object are searched by a scan.
    """
    if index is not None and isinstance(pattern, dict):
        spark = rows.sparkSession
        leaves = list(_leaf_texts(pattern))
        if leaves:
            hashed = spark.range(1).select(*[_leaf_hash(F.lit(path), text).alias(f"h{i}") for i, (path, text) in enumerate(leaves)])
            wanted = sorted(set(hashed.first()))
            hits = index.filter(F.col("part").isin([h % parts for h in wanted]) & F.col("leaf").isin(wanted))
            candidates = hits.groupBy(key).agg(F.count_distinct("leaf").alias("_n")).filter(F.col("_n") == len(wanted))
            # a condition on both sides is not moved below the join, where it would parse every row
            verified = F.when(F.col("_n") == len(wanted), contains(F.col(column), pattern))
            return rows.join(candidates, key).filter(verified).select(*rows.columns)
    return rows.filter(contains(F.col(column), pattern))
