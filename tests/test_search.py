"""Search against brute force: ties, scopes, gates, reranking, hot groups, blocks, cells."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.config import EngineConfig
from passagemill.functions import wording
from passagemill.functions.vectors import cosine
from passagemill.operators.embed import embed_questions
from passagemill.operators.ann import ann_join, assign_cells, recall, train_cells
from passagemill.operators.rerank import pair_scorer, rerank
from passagemill.operators.search import knn_join, knn_topk, rank_hits, scope_filter, score_gate, visible_chunks
from passagemill.plans.retrieve import answer_inputs, retrieve

DIM = 8
CFG = EngineConfig(embedding_dim=DIM, pool_size=12, top_k=3)
CHUNK = "document_id string, chunk_index int, embedding array<float>, collection string, user_id string"
QUESTION = "question_id string, q_vec array<float>, document_id string, collection string, user_id string, top_k int"


def data(seed=1, n=300, q=25):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, DIM)).astype(np.float32)
    vectors[: n // 3] = vectors[0]  # a third of all rows are copies
    vectors[n // 3] = 0.0
    vectors[n // 3 + 1, 0] = np.nan
    chunks = [
        (f"d{i % 40}", i // 40, [float(x) for x in v], f"c{0 if i % 3 == 0 else i % 5}", f"u{i % 2}")
        for i, v in enumerate(vectors)
    ]
    asked = rng.normal(size=(q, DIM)).astype(np.float32)
    asked[0] = vectors[0]
    asked[1] = 0.0
    questions = [
        (f"q{i}", [float(x) for x in v], "d7" if i % 7 == 3 else "", "c0" if i % 4 == 1 else None, "u1" if i % 5 == 2 else "", [None, 5, 20, 1][i % 4])
        for i, v in enumerate(asked)
    ]
    return chunks, questions


def brute(chunks, questions, cfg, min_score=None):
    out = []
    for qid, qv, doc, coll, user, top_k in questions:
        qn = np.array(qv, dtype=np.float32).astype(float)
        top = top_k or cfg.top_k
        pool = max(top, cfg.pool_size) if cfg.rerank else top
        rows = []
        for d, i, v, c, u in chunks:
            vn = np.array(v, dtype=np.float32).astype(float)
            size = np.linalg.norm(vn) * np.linalg.norm(qn)
            if not np.isfinite(size) or size == 0:
                continue
            if (doc and doc != d) or (coll and coll != c) or (user and user != u):
                continue
            rows.append((-round(float(vn @ qn / size), 9), d, i))
        for rank, (s, d, i) in enumerate(sorted(rows)[:pool], start=1):
            if min_score is None or -s >= min_score:
                out.append((qid, rank, d, i, -s))
    return sorted(out)


def found(df):
    cols = ["question_id", "ann_rank", "document_id", "chunk_index", "score"]
    return sorted(tuple(r) for r in df.select(*cols).collect())


def same(got, want):
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want], atol=2e-9)


@pytest.mark.parametrize("rerank_on", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_exact_join(spark, seed, rerank_on):
    chunks, questions = data(seed)
    cfg = EngineConfig(embedding_dim=DIM, pool_size=12, top_k=3, rerank=rerank_on)
    c = spark.createDataFrame(chunks, CHUNK).repartition(5)
    q = spark.createDataFrame(questions, QUESTION)
    same(found(knn_join(c, q, cfg)), brute(chunks, questions, cfg))


def test_blocks_equal_broadcast(spark):
    chunks, questions = data(3)
    c, q = spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(questions, QUESTION)
    tight = EngineConfig(embedding_dim=DIM, pool_size=12, top_k=3, broadcast_bytes=DIM * 8 * 4, chunk_block_bytes=DIM * 4 * 50)
    assert found(knn_join(c, q, tight)) == found(knn_join(c, q, CFG))


def shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    return store.executorSummary("driver").totalShuffleWrite()


def test_blocks_move_no_more_than_the_tables_grow(spark):
    """Three times the rows on both sides move about three times as much, however small the limits are."""
    tight = EngineConfig(embedding_dim=DIM, pool_size=5, top_k=3, broadcast_bytes=DIM * 8 * 20, chunk_block_bytes=DIM * 4 * 20)
    moved = []
    for n in (400, 1200):
        vectors = np.random.default_rng(n).normal(size=(n, DIM))
        c = spark.createDataFrame([(f"d{i}", 0, v.tolist(), "c", "u") for i, v in enumerate(vectors)], CHUNK)
        q = spark.createDataFrame([(f"q{i}", v.tolist(), "", None, "", 3) for i, v in enumerate(vectors)], QUESTION)
        before = shuffled(spark)
        assert knn_join(c, q, tight).count() == 5 * n
        moved.append(shuffled(spark) - before)
    assert 0 < moved[1] < 4 * moved[0]


def test_grouped_scan_gives_the_same(spark):
    chunks, questions = data(8)
    c, q = spark.createDataFrame(chunks, CHUNK).repartition(9), spark.createDataFrame(questions, QUESTION)
    grouped = EngineConfig(embedding_dim=DIM, pool_size=12, top_k=3, scan_tasks=2)
    assert found(knn_join(c, q, grouped)) == found(knn_join(c, q, CFG))


def test_parts_of_a_question_merge_to_the_same(spark):
    """Nearly all rows are one question's, a third of them tied: parts by key first, then their best together."""
    hits = spark.range(60_000, numPartitions=40).select(
        F.when(F.col("id") < 59_000, "q0").otherwise("q1").alias("question_id"), F.concat(F.lit("d"), (F.col("id") % 700).cast("string")).alias("document_id"),
        (F.col("id") / 700).cast("int").alias("chunk_index"),
        F.when(F.col("id") % 3 == 0, 0.999).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("score"),
    )
    questions = spark.createDataFrame([("q0", 50, 6), ("q1", 9, 6)], "question_id string, pool int, top_k int")
    cfg = [EngineConfig(merge_parts=n) for n in (1, 7, 32)]
    first, *others = [found(rank_hits(hits, questions, c)) for c in cfg]
    every = sorted(hits.collect(), key=lambda r: (-r["score"], r["document_id"], r["chunk_index"]))
    want = [(q, i + 1, r["document_id"], r["chunk_index"], r["score"])
            for q, pool in (("q0", 50), ("q1", 9)) for i, r in enumerate([r for r in every if r["question_id"] == q][:pool])]
    assert first == want
    assert others == [first, first]
    plan = rank_hits(hits, questions, cfg[2])._jdf.queryExecution().executedPlan().toString()
    # before either exchange each task cuts to the pool, and the first exchange is by question and part
    assert plan.count("WindowGroupLimit") == 4 and re.search(r"hashpartitioning\(question_id#\d+, _part#", plan)


def test_wide_requests_are_not_cut(spark):
    """A request beyond the usual limit, if let through, is answered whole."""
    chunks, questions = data(9)
    questions = [q[:5] + (120,) for q in questions]
    c, q = spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(questions, QUESTION)
    same(found(knn_join(c, q, CFG)), brute(chunks, questions, CFG))


def test_gate_below_ranking_is_exact(spark):
    chunks, questions = data(4)
    c, q = spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(questions, QUESTION)
    pushed = found(knn_join(c, q, CFG, min_score=CFG.min_score))
    after = found(score_gate(knn_join(c, q, CFG), CFG))
    assert pushed == after
    same(after, brute(chunks, questions, CFG, CFG.min_score))


def test_gate_is_inclusive_and_rejects_nan(spark):
    rows = spark.createDataFrame([(0.25,), (0.2499,), (float("nan"),), (0.3,)], "score double")
    assert sorted(r[0] for r in score_gate(rows, CFG).collect()) == [0.25, 0.3]


def test_one_question(spark):
    chunks, _ = data(5)
    vector = [0.5, -1.0, 0.25, 2.0, 0.0, 0.0, 1.0, -0.5]
    got = knn_topk(spark.createDataFrame(chunks, CHUNK), vector, 10, CFG).collect()
    want = brute(chunks, [("q", vector, "", None, "", 10)], EngineConfig(embedding_dim=DIM, pool_size=10, top_k=10))
    assert [(r["document_id"], r["chunk_index"]) for r in got] == [(d, i) for _, _, d, i, _ in want]


def test_native_cosine_equals_matrix_product(spark):
    chunks, questions = data(6)
    usable = [c for c in chunks if np.isfinite(c[2]).all()]
    c = spark.createDataFrame(usable, CHUNK)
    request = F.array(*[F.lit(x) for x in questions[2][1]])
    native = {(r[0], r[1]): r[2] for r in c.select("document_id", "chunk_index", cosine(F.col("embedding"), request)).collect()}
    assert native[("d" + str(100 % 40), 100 // 40)] is None
    for row in knn_topk(c, questions[2][1], 50, CFG).collect():
        assert native[(row["document_id"], row["chunk_index"])] == pytest.approx(row["score"], abs=1e-8)


def test_scope_ignores_empty_filters(spark):
    docs = spark.createDataFrame(
        [("a", "completed", "c", "u"), ("b", "completed", None, "u"), ("c", "failed", "c", "u")],
        "document_id string, status string, collection string, user_id string",
    )
    assert {r[0] for r in scope_filter(docs, "", None, "u").collect()} == {"a", "b"}
    assert {r[0] for r in scope_filter(docs, collection="c").collect()} == {"a"}


def test_hidden_documents_by_each_way(spark):
    """Orphans, null states and stale scopes mean the same at every size: the registry decides."""
    chunks, _ = data(7)
    c = spark.createDataFrame(chunks, CHUNK)
    states = {0: "failed", 1: None, 2: "processing"}
    docs = spark.createDataFrame(
        [(f"d{i}", states.get(i, "completed"), f"new{i}", f"u{i}") for i in range(38)],
        "document_id string, status string, collection string, user_id string",
    )
    ways = [EngineConfig(broadcast_bytes=n) for n in (10**9, 200, 1)]
    cols = ["document_id", "chunk_index", "collection", "user_id"]
    found = [sorted(map(tuple, visible_chunks(c, docs, cfg, ["embedding"]).select(*cols).collect())) for cfg in ways]
    hidden = {"d0", "d1", "d2", "d38", "d39"}
    want = sorted((r[0], r[1], f"new{r[0][1:]}", f"u{r[0][1:]}") for r in chunks if r[0] not in hidden)
    assert found == [want] * 3


def test_search_survives_bad_vectors(spark):
    """Null, empty and odd-width vectors on either side, and no questions at all."""
    chunk = "document_id string, chunk_index int, embedding array<float>"
    rows = [("a", 0, [1.0, 0.0]), ("b", 0, None), ("c", 0, []), ("d", 0, [1.0, 0.0, 0.0, 0.0]), ("e", 0, [0.0, 1.0]), ("f", 0, [float("nan"), 1.0])]
    c = spark.createDataFrame(rows, chunk)
    asked = [("q1", [1.0, 0.1]), ("q2", None), ("q3", []), ("q4", [1.0, 0.0, 0.0]), ("q5", [0.0, 2.0]), ("q6", [0.0, 0.0])]
    q = spark.createDataFrame(asked, "question_id string, q_vec array<float>")
    for cfg in (EngineConfig(), EngineConfig(broadcast_bytes=1, chunk_block_bytes=8)):
        got = {(r["question_id"], r["document_id"]) for r in knn_join(c, q, cfg).collect()}
        assert got == {(i, d) for i in ("q1", "q5") for d in ("a", "e")}
        assert knn_join(c, q.filter("false"), cfg).count() == 0


def test_short_and_wide_replies_fail_alone(spark):
    def make_model():
        def model(texts):
            found = [np.ones(3 if "wide" in t else 2) for t in texts]
            return found[: -1 if any("short" in t for t in texts) else None]

        return model

    texts = ["one", "short", "wide", "two"]
    q = spark.createDataFrame([(t,) for t in texts], "question string").coalesce(1)
    got = {r["question"]: r for r in embed_questions(q, EngineConfig(embedding_dim=2), make_model).collect()}
    assert [got[t]["embed_error"] is None for t in texts] == [True, False, False, True]
    assert [got[t]["q_vec"] for t in texts] == [[1.0, 1.0], None, None, [1.0, 1.0]]


def pool(spark, n, top_k):
    rows = [("q", "alpha beta", f"text {'alpha' if i % 2 else 'beta alpha'}", i + 1, top_k) for i in range(n)]
    return spark.createDataFrame(rows, "question_id string, question string, content string, ann_rank int, top_k int")


def test_rerank_only_beyond_top_k(spark):
    exact = rerank(pool(spark, 4, 4)).orderBy("n").collect()
    assert [r["ann_rank"] for r in exact] == [1, 2, 3, 4] and exact[0]["rerank_score"] is None
    more = rerank(pool(spark, 5, 4)).orderBy("n").collect()
    assert [r["ann_rank"] for r in more] == [1, 3, 5, 2]


def test_model_scorer_in_batches(spark):
    """The hook gets at most a batch per call and never a pair that needs no score."""

    def make_model():
        def model(pairs):
            assert 0 < len(pairs) <= 2 and all(q is not None for q, _ in pairs)
            return [float(len(text)) for _, text in pairs]

        return model

    scorer = pair_scorer(EngineConfig(rerank_batch=2), make_model)
    both = pool(spark, 5, 4).unionByName(pool(spark, 3, 4).withColumn("question_id", F.lit("p")))
    rows = rerank(both, scorer).orderBy("question_id", "n").collect()
    assert [r["ann_rank"] for r in rows] == [1, 2, 3, 1, 3, 5, 2]


def small_corpus(spark):
    docs = spark.createDataFrame(
        [("a", "a.md", "completed", "c", "u"), ("b", "b.md", "failed", "c", "u"), ("c", "c.md", "completed", None, "v")],
        "document_id string, original_filename string, status string, collection string, user_id string",
    )
    unit = [1.0] + [0.0] * (DIM - 1)
    near = [0.9, 0.1] + [0.0] * (DIM - 2)
    far = [0.0] * (DIM - 1) + [1.0]
    chunks = spark.createDataFrame(
        [("a", 0, None, None, "zero", near), ("a", 1, 4, "H", "one", unit), ("b", 0, 1, None, "hidden", unit), ("c", 0, 0, "", "far", far)],
        "document_id string, chunk_index int, page_number int, heading string, content string, embedding array<float>",
    )
    return docs, chunks, unit, far


def test_answers_and_no_hits(spark):
    docs, chunks, unit, far = small_corpus(spark)
    minus = [-x for x in unit]
    questions = spark.createDataFrame(
        [("1", "first?", unit, "", None, False, None), ("2", "second?", minus, None, None, True, "SV"), ("3", "third?", far, None, "nowhere", None, "xx")],
        "question_id string, question string, q_vec array<float>, document_id string, collection string, voice boolean, lang string",
    )
    rows = {r["question_id"]: r for r in answer_inputs(questions, chunks, docs, CFG).collect()}
    assert [(c["n"], c["filename"], c["page_number"], c["heading"]) for c in rows["1"]["citations"]] == [(1, "a.md", 4, "H"), (2, "a.md", None, None)]
    assert rows["1"]["user_prompt"] == (
        "Question: first?\n\nSources:\n[1] (a.md, p.4 — H)\none\n\n[2] (a.md)\nzero\n\n" + wording.CLOSING_INSTRUCTION
    )
    assert rows["1"]["answer"] is None and rows["1"]["system_prompt"] == wording.SYSTEM_PROMPT
    assert rows["2"]["answer"] == wording.NO_HITS_ANSWER and rows["2"]["citations"] == []
    assert rows["2"]["system_prompt"] == wording.SYSTEM_PROMPT_VOICE + " Answer in Swedish."
    assert rows["3"]["answer"] == wording.NO_HITS_ANSWER and rows["3"]["user_prompt"] is None


def test_retrieve_without_scorer_keeps_vector_order(spark):
    docs, chunks, unit, _ = small_corpus(spark)
    questions = spark.createDataFrame([("1", "zero", unit, 1)], "question_id string, question string, q_vec array<float>, top_k int")
    assert [r["content"] for r in retrieve(questions, chunks, docs, CFG, scorer=None).collect()] == ["one"]
    assert [r["content"] for r in retrieve(questions, chunks, docs, CFG).collect()] == ["zero"]


def test_ann_recall_and_subset(spark):
    sf = "/root/testdata/sf0.01"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    chunks = vectors.select(F.col("vec_id").cast("string").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding")
    questions = vectors.select(F.col("vec_id").cast("string").alias("question_id"), F.col("embedding").alias("q_vec"))
    cfg = EngineConfig(pool_size=6, top_k=6)
    index = train_cells(chunks, n_cells=16)
    celled = assign_cells(chunks, index)
    exact = knn_join(chunks, questions, cfg)
    assert recall(ann_join(celled, questions, index, cfg, probes=16), exact) == 1.0
    some = ann_join(celled, questions, index, cfg, probes=8)
    assert recall(some, exact) > 0.85
    tight = EngineConfig(pool_size=6, top_k=6, broadcast_bytes=64 * 8 * 30, chunk_block_bytes=64 * 4 * 20)
    assert found(ann_join(celled, questions, index, tight, probes=8)) == found(some)


def test_ann_survives_bad_vectors(spark):
    """Vectors without a direction or of another width are neither trained on, found, nor searched for."""
    good = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]
    bad = [None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1.0, 2.0, 3.0]]
    rows = [(f"d{i}", 0, v) for i, v in enumerate(good + bad)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_index int, embedding array<float>")
    cfg = EngineConfig(pool_size=3, top_k=3)
    index = train_cells(chunks, n_cells=2, dim=2)
    celled = assign_cells(chunks, index)
    assert sorted(r["document_id"] for r in celled.collect()) == ["d0", "d1", "d2"]
    asked = [(f"q{i}", v) for i, v in enumerate([[1.0, 0.0], *bad])]
    questions = spark.createDataFrame(asked, "question_id string, q_vec array<float>")
    for limit in (cfg.broadcast_bytes, 1):
        own = EngineConfig(pool_size=3, top_k=3, broadcast_bytes=limit)
        hits = ann_join(celled, questions, index, own, probes=2).collect()
        assert sorted((r["question_id"], r["document_id"]) for r in hits) == [("q0", "d0"), ("q0", "d1"), ("q0", "d2")]
        assert ann_join(celled, questions.limit(0), index, own, probes=2).count() == 0
