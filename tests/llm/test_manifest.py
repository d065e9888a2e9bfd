"""The Merkle manifest against a tree built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from passagemill.llm import merkle, spelling

SHAPE = "doc_id long, source string, lang string, n_chars int, text string, rank int, tree string, __tie string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return H("".join(map(field, row[:4])) + field(text))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    for level in tree[:-1]:
        first = i // 8 * 8
        yield "".join(level[first:i]), "".join(level[i + 1 : first + 8])
        i //= 8


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    ordered = {v: sorted(((r[0] is not None, r[0] or 0, leaf(r, r[4]), r) for r in rows if r[2] == v), key=lambda x: x[:3]) for v in langs}
    trees = {v: levels([x[2] for x in found]) for v, found in ordered.items()}
    top = levels([trees[v][-1][0] for v in langs])
    out = []
    for k, v in enumerate(langs):
        for i, (_, _, digest, r) in enumerate(ordered[v]):
            steps = [*path(trees[v], i), *path(top, k)]
            folded = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                folded = leaf(r, "".join(c.lower() if c.isascii() else c for c in r[4]))
            for left, right in steps:
                folded = H(left + folded + right)
            proof = H("".join(a + b for a, b in steps))
            out.append((r[0], digest, trees[v][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def result(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SHAPE)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return sorted((tuple(r) for r in merkle.verified(docs, tampered, spelling.lower_ascii(F.col("text"))).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 130])
def test_one_tree_of_any_size(spark, n):
    rows = [(i * 7 % 1009, f"s{i % 3}", "en", i, f"Text {i}") for i in range(n)]
    assert result(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(i, None if i % 4 else "src", ["en", None, "Ä", ""][i % 4], None if i % 5 else i, None if i % 6 == 0 else f"Ärger {i} ABC") for i in range(40)]
    rows += [(5, "a", "en", 1, "same id A"), (5, "a", "en", 1, "same id B"), (None, None, None, None, None), (None, None, None, None, None)]
    rows += [(77, "a", "lone", 1, "")] + [(3, "x", "en", 2, "again")] * 11 + [(900, "long", "en", 1, "Word " * 200_000)]
    rows += [(i, "many", f"l{i}", 1, "T") for i in range(100, 120)]
    assert result(spark, rows) == brute(rows)


def test_an_empty_table_has_no_rows(spark):
    assert result(spark, []) == []


def test_ranks_do_not_depend_on_how_rows_are_dealt(spark):
    rows = [(i % 50, "s", "en" if i % 3 else "de", i, f"T{i}") for i in range(500)]
    want = brute(rows)
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SHAPE)
    for parts in (1, 13):
        found = merkle.manifest(docs.repartition(parts)).select("doc_id", "leaf", "subroot", "root", merkle.proof_of(F.col("path"))).collect()
        assert sorted(map(tuple, found), key=repr) == [w[:5] for w in want]


def test_a_bucket_holds_eight_nodes_at_most(spark):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(300)]
    leaves = merkle.ranked(spark.createDataFrame([(r[2], r[0], leaf(r, r[4])) for r in rows], "tree string, doc_id long, digest string"), "tree", "doc_id")
    for runs in merkle.grown(leaves.select("tree", "size", "rank", "digest", F.struct("doc_id").alias("body"))):
        assert runs.select(F.max(F.size("kids"))).first()[0] <= 8
        assert runs.groupBy("tree", "bucket").count().where("count > 1").count() == 0
