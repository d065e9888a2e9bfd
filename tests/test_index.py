"""The stored cell index, tables in buckets, and errors of questions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.config import EngineConfig
from passagemill.operators import ann
from passagemill.operators.ann import StoredCells, recall
from passagemill.operators.rerank import pair_scores, rerank
from passagemill.operators.search import knn_join
from passagemill.plans.retrieve import answer_inputs
from passagemill.session import new_run_dir
from passagemill.sources.colocated import Colocated

DIM = 8
CFG = EngineConfig(embedding_dim=DIM, pool_size=10, top_k=3)
CHUNK = "document_id string, chunk_index int, embedding array<float>"
HIT = ["question_id", "document_id", "chunk_index", "ann_rank", "score"]


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def vectors(spark, n, seed, first=0):
    rng = np.random.default_rng(seed)
    centers = np.random.default_rng(0).normal(size=(6, DIM)) * 3
    rows = [(f"d{i}", i % 3, [float(x) for x in centers[i % 6] + rng.normal(size=DIM)]) for i in range(first, first + n)]
    return spark.createDataFrame(rows, CHUNK)


@pytest.fixture(scope="module")
def index(spark):
    return StoredCells(spark, new_run_dir(spark, "cells")).build(vectors(spark, 400, 1), n_cells=6)


def asked(spark, n=12):
    return vectors(spark, n, 5).select(F.col("document_id").alias("question_id"), F.col("embedding").alias("q_vec"))


def test_a_search_of_a_stored_index_trains_nothing_and_prunes(spark, index, monkeypatch):
    monkeypatch.setattr(ann, "KMeans", None)
    again = StoredCells(spark, index.path)
    assert again.exists()
    one = asked(spark, 1)
    text = plan(again.search(one, CFG, 1))
    assert "PartitionFilters: [" in text and "cell" in text.split("PartitionFilters: [")[1].split("]")[0]
    read = {f.split("cell=")[1].split("/")[0] for f in again.celled().filter(F.col("cell").isin([2])).inputFiles()}
    assert len({f.split("cell=")[1].split("/")[0] for f in again.celled().inputFiles()}) == 6 and read


def test_all_cells_are_exact_and_appended_chunks_are_found(spark, index):
    exact = knn_join(vectors(spark, 400, 1), asked(spark), CFG)
    assert sorted(map(tuple, index.search(asked(spark), CFG, 6).select(HIT).collect())) == sorted(map(tuple, exact.select(HIT).collect()))
    assert recall(index.search(asked(spark), CFG, 3), exact) > 0.9
    grown = StoredCells(spark, new_run_dir(spark, "cells")).build(vectors(spark, 400, 1), n_cells=6)
    before = set(grown.celled().inputFiles())
    odd = spark.createDataFrame([("bad", 0, [0.0] * DIM), ("bad", 1, None), ("bad", 2, [1.0])], CHUNK)
    grown.append(vectors(spark, 150, 9, first=1000).unionByName(odd))
    assert before < set(grown.celled().inputFiles())
    whole = knn_join(vectors(spark, 400, 1).unionByName(vectors(spark, 150, 9, first=1000)), asked(spark), CFG)
    assert sorted(map(tuple, grown.search(asked(spark), CFG, 6).select(HIT).collect())) == sorted(map(tuple, whole.select(HIT).collect()))


def test_an_unfinished_build_is_no_index(spark, monkeypatch):
    half = StoredCells(spark, new_run_dir(spark, "cells"))
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    chunks = spark.range(40).select(F.col("id").cast("string").alias("document_id"), F.lit(0).alias("chunk_index"), F.array(*[F.rand(i).cast("float") for i in range(DIM)]).alias("embedding"))
    with pytest.raises(RuntimeError):
        half.build(chunks, n_cells=2)
    monkeypatch.undo()
    assert not half.exists()
    assert half.build(chunks, n_cells=2).exists() and half.celled().count() == 40


def test_joins_of_buckets_move_nothing(spark):
    path = new_run_dir(spark, "colocated")
    tables = Colocated(spark, "t" + path[-32:], path, 4)
    chunks = spark.createDataFrame([(f"d{i % 7}" if i % 10 else None, i) for i in range(200)], "document_id string, chunk_index int")
    docs = spark.createDataFrame([(f"d{i}", f"n{i}") for i in range(5)] + [(None, "x")], "document_id string, name string")
    tables.write("chunks", chunks)
    tables.write("documents", docs)
    joined = tables.join("chunks", "documents")
    assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, chunks.join(docs, "document_id").collect()))
    ids = spark.createDataFrame([("d1",), ("d1",), ("none",), (None,)], "document_id string")
    some = tables.rows_of("chunks", ids)
    found = plan(some)
    assert found.count("hashpartitioning(document_id") <= 2 and "Scan parquet spark_catalog" in found
    assert sorted(r["chunk_index"] for r in some.collect()) == [i for i in range(200) if i % 10 and i % 7 == 1]
    tables.write("documents", docs.limit(0))  # a table is replaced whole
    assert tables.join("chunks", "documents").count() == 0
    tables.drop()


def test_errors_are_not_no_hits(spark):
    unit = [1.0] + [0.0] * (DIM - 1)
    docs = spark.createDataFrame([("a", "a.md", "completed", None, None)], "document_id string, original_filename string, status string, collection string, user_id string")
    chunks = spark.createDataFrame([("a", 0, None, None, "text", unit)], "document_id string, chunk_index int, page_number int, heading string, content string, embedding array<float>")
    rows = [
        ("good", "q", unit, None, None), ("far", "q", [-x for x in unit], None, None), ("zero", "q", [0.0] * DIM, None, None), ("empty", "", unit, None, None),
        ("long", "q" * 2001, unit, None, None), ("many", "q", unit, 99, None), ("down", "q", None, None, "no model"), ("none", "q", [], None, None), ("nan", "q", [float("nan")] * DIM, None, None),
    ]
    q = spark.createDataFrame(rows, "question_id string, question string, q_vec array<float>, top_k int, embed_error string")
    got = {r["question_id"]: r for r in answer_inputs(q, chunks, docs, CFG).collect()}
    assert len(got) == len(rows)
    assert got["good"]["user_prompt"] and not got["good"]["answer"] and not got["good"]["error"]
    assert all(got[k]["answer"] and not got[k]["error"] and not got[k]["user_prompt"] for k in ("far", "zero"))
    errors = {k: got[k]["error"] for k in got if got[k]["error"]}
    assert errors == {
        "empty": "invalid question: question too short", "long": "invalid question: question too long", "many": "invalid question: top_k out of range",
        "down": "embedding failed: no model", "none": "embedding failed: no usable vector", "nan": "embedding failed: no usable vector",
    }
    assert all(got[k]["answer"] is None and got[k]["user_prompt"] is None and got[k]["citations"] == [] for k in errors)


def test_pair_scores_keep_failures_to_their_pairs(spark):
    def make_model():
        def score(pairs):
            if any("boom" in c for _, c in pairs):
                raise RuntimeError("boom")
            if len(pairs) > 1 and any("short" in c for _, c in pairs):
                return [1.0]
            assert all(len((q + c).split()) <= 6 for q, c in pairs)
            return [float(len(c.split())) for _, c in pairs]

        return score

    rows = [("a", "q one", c, i + 1, 2) for i, c in enumerate(["x", "boom", "a b c d e f g h i", None, "short", "x y"])] + [("b", "q", "only", 1, 2)]
    pool = spark.createDataFrame(rows, "question_id string, question string, content string, ann_rank int, top_k int").coalesce(1)
    cfg = EngineConfig(rerank_batch=3, rerank_max_tokens=6)
    scored = pool.select("ann_rank", pair_scores(cfg, make_model)(F.when(F.col("question_id") == "a", F.col("question")), F.col("content")).alias("s")).collect()
    assert [(r["ann_rank"], r["s"]["score"], r["s"]["error"]) for r in scored] == [
        (1, 1.0, None), (2, None, "boom"), (3, 4.0, None), (4, 0.0, None), (5, 1.0, None), (6, 2.0, None), (1, None, None),
    ]
    kept = rerank(pool, pair_scores(cfg, make_model)).orderBy("question_id", "n").collect()
    assert [(r["question_id"], r["ann_rank"], r["rerank_score"], r["rerank_error"]) for r in kept] == [("a", 3, 4.0, None), ("a", 6, 2.0, None), ("b", 1, None, None)]
