"""Search, gate, rerank, citations and prompts."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.config import EngineConfig
from passagemill.functions import wording
from passagemill.functions.vectors import HashedWords, cosine, micro_text, norm, parse_vector, vector_text
from passagemill.operators.ann import StoredCells, recall
from passagemill.operators.chunk import chunk_documents
from passagemill.operators.cite import with_sources
from passagemill.operators.embed import embed_chunks, embed_questions
from passagemill.operators.registry import chunk_document_join
from passagemill.operators.rerank import pair_scores, rerank
from passagemill.operators.search import knn_join, knn_topk, scope_filter, score_gate, visible_chunks
from passagemill.plans.answer import answer_events
from passagemill.plans.retrieve import answer_inputs, gated_pool, retrieve
from passagemill.session import new_run_dir, shared_dir, stored
from passagemill.sources.colocated import Colocated

from . import standins as st
from .ingesting import CONV_CHUNKS, DOC_CHUNKS
from .standins import CFG, WS, table, with_ctes

# One request vector, as a client would send it.
REQUEST_VECTOR = [math.sin(i) for i in range(1, 65)]
REQUEST_SQL = "[sin(i) FOR i IN range(1, 65)]"
# Words alone make hashed vectors of all texts similar; the gate is set among them.
TEXT_CFG = EngineConfig(embedding_dim=CFG.embedding_dim, min_score=0.55)


# Vectors of the embeddings table ----------------------------------------------


def cosine_scores(spark: SparkSession, sf: str) -> DataFrame:
    request = F.array(*[F.lit(x) for x in REQUEST_VECTOR])
    score = F.round(cosine(F.col("embedding"), request), 6)
    return st.vector_chunks(spark, sf).select(
        "document_id", score.alias("score"), F.round(norm(F.col("embedding")), 6).alias("norm")
    )


COSINE_SQL = f"""SELECT CAST(vec_id AS VARCHAR) AS document_id,
  round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {REQUEST_SQL}), 6) AS score,
  round(sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])), 6) AS norm
FROM embeddings"""


def vector_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written as text and read back."""
    text = vector_text(F.col("embedding"))
    return st.vector_chunks(spark, sf).select(
        "document_id", text.startswith("[").alias("is_list"), micro_text(parse_vector(text)).alias("vector")
    )


VECTOR_TEXT_SQL = """SELECT CAST(vec_id AS VARCHAR) AS document_id, true AS is_list,
  array_to_string([CAST(CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT) AS VARCHAR) FOR x IN embedding], ',') AS vector
FROM embeddings"""


def nearest_to_request(spark: SparkSession, sf: str) -> DataFrame:
    chunks = visible_chunks(st.vector_chunks(spark, sf), st.registry(spark, sf), CFG, ["embedding"])
    return knn_topk(chunks, REQUEST_VECTOR, CFG.pool_size, CFG)


KNN_TOPK_SQL = with_ctes(
    st.REGISTRY,
    select=f"""SELECT document_id, 0 AS chunk_index, round(s, 9) AS score FROM (
  SELECT r.document_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), {REQUEST_SQL}) AS s
  FROM embeddings e JOIN registry r ON r.document_id = CAST(e.vec_id AS VARCHAR) WHERE r.status = 'completed')
ORDER BY round(s, 9) DESC, document_id LIMIT 30""",
)


def vector_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector asks for its neighbours; odd labels stay in their own user's documents."""
    vectors = st.vector_chunks(spark, sf)
    users = st.registry(spark, sf).select("document_id", F.col("user_id").alias("_user"))
    asked = vectors.join(users, "document_id", "left")
    return asked.select(
        F.col("document_id").alias("question_id"),
        F.col("embedding").alias("q_vec"),
        F.when(F.col("label") % 2 == 1, F.col("_user")).otherwise(F.lit("")).alias("user_id"),
    )


def _vector_pool(spark: SparkSession, sf: str, cfg: EngineConfig = CFG) -> DataFrame:
    chunks = visible_chunks(st.vector_chunks(spark, sf), st.registry(spark, sf), cfg, ["embedding"])
    return knn_join(chunks, vector_questions(spark, sf), cfg)


def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _vector_pool(spark, sf).select("question_id", "document_id", "chunk_index", "ann_rank", "score")


POOL_SQL = """scored AS (
  SELECT CAST(q.vec_id AS VARCHAR) AS question_id, r.document_id,
         list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s
  FROM embeddings q LEFT JOIN registry u ON u.document_id = CAST(q.vec_id AS VARCHAR)
  JOIN embeddings e ON true JOIN registry r ON r.document_id = CAST(e.vec_id AS VARCHAR) AND r.status = 'completed'
  WHERE q.label % 2 <> 1 OR u.user_id IS NULL OR u.user_id = r.user_id),
pool AS (
  SELECT question_id, document_id, 0 AS chunk_index, s,
         CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(s, 9) DESC, document_id) AS INTEGER) AS ann_rank
  FROM scored QUALIFY ann_rank <= {k})"""

KNN_JOIN_SQL = with_ctes(
    st.REGISTRY,
    POOL_SQL.format(k=30),
    select="SELECT question_id, document_id, chunk_index, ann_rank, round(s, 9) AS score FROM pool",
)


def gated_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = score_gate(_vector_pool(spark, sf), CFG)
    return rows.select("question_id", "document_id", "chunk_index", "ann_rank", "score")


GATE_SQL = with_ctes(
    st.REGISTRY,
    POOL_SQL.format(k=30),
    select="""SELECT question_id, document_id, chunk_index, ann_rank, round(s, 9) AS score
FROM pool WHERE round(s, 9) >= 0.25""",
)


def neighbours_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The same join when questions do not fit the broadcast limit."""
    tight = EngineConfig(embedding_dim=CFG.embedding_dim, broadcast_bytes=64 * 8 * 100, chunk_block_bytes=64 * 4 * 200)
    rows = _vector_pool(spark, sf, tight)
    return rows.select("question_id", "document_id", "chunk_index", "ann_rank", "score")


def cells_of_table(spark: SparkSession, sf: str) -> StoredCells:
    """The stored index of the vectors; built where there is none for these files yet."""
    chunks = st.vector_chunks(spark, sf)
    files = sorted(chunks.inputFiles())
    jvm = spark.sparkContext._jvm
    seen = []
    for name in files:
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    index = StoredCells(spark, f"{shared_dir(spark).rstrip('/')}/cells-{hashlib.sha256(' '.join(seen).encode()).hexdigest()[:16]}")
    return index if index.exists() else index.build(chunks.drop("label"), n_cells=16)


def approximate_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = cells_of_table(spark, sf).search(vector_questions(spark, sf), CFG, 8, st.registry(spark, sf))
    return rows.select("question_id", "document_id", "chunk_index", "ann_rank", "score")


def neighbours_in_all_cells(spark: SparkSession, sf: str) -> DataFrame:
    """With every cell probed the index gives the exact pools."""
    rows = cells_of_table(spark, sf).search(vector_questions(spark, sf), CFG, 16, st.registry(spark, sf))
    return rows.select("question_id", "document_id", "chunk_index", "ann_rank", "score")


def recall_by_probes(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the exact pools the index finds: half of the cells, all of them."""
    exact = stored(_vector_pool(spark, sf), "exact")
    index, asked_ = cells_of_table(spark, sf), vector_questions(spark, sf)
    n = exact.count()
    found = [(probes, n, recall(index.search(asked_, CFG, probes, st.registry(spark, sf)), exact)) for probes in (8, 16)]
    rows = spark.createDataFrame(found, "probes int, n long, recall double")
    return rows.select("probes", "n", (F.col("recall") >= F.when(F.col("probes") == 16, 1.0).otherwise(0.5)).alias("reached"))


RECALL_SQL = with_ctes(st.REGISTRY, POOL_SQL.format(k=30), select="SELECT unnest([8, 16]) AS probes, count(*) AS n, true AS reached FROM pool")


def completed_in_scope(spark: SparkSession, sf: str) -> DataFrame:
    rows = scope_filter(st.registry(spark, sf), document_id="", collection="src3", user_id="en")
    return rows.select("document_id", "collection", "user_id", "status")


SCOPE_SQL = with_ctes(
    st.REGISTRY,
    select="""SELECT document_id, collection, user_id, status FROM registry
WHERE status = 'completed' AND collection = 'src3' AND user_id = 'en'""",
)


def chunks_with_documents(spark: SparkSession, sf: str) -> DataFrame:
    chunks = st.vector_chunks(spark, sf).select("document_id", "chunk_index", "label")
    docs = st.registry(spark, sf).select("document_id", "original_filename", "collection", "status")
    return chunk_document_join(chunks, docs)


def colocated_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The same join of tables that lie in buckets by document."""
    name = new_run_dir(spark, "colocated")
    tables = Colocated(spark, "c" + name[-32:], name, 8)
    tables.write("chunks", st.vector_chunks(spark, sf).select("document_id", "chunk_index", "label"))
    tables.write("documents", st.registry(spark, sf).select("document_id", "original_filename", "collection", "status"))
    return tables.join("chunks", "documents")


CHUNK_DOC_SQL = with_ctes(
    st.REGISTRY,
    select="""SELECT r.document_id, 0 AS chunk_index, e.label, r.original_filename, r.collection, r.status
FROM embeddings e JOIN registry r ON r.document_id = CAST(e.vec_id AS VARCHAR)""",
)


# Text questions over document chunks ------------------------------------------


def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All documents cut and embedded into a stored chunk table, as an ingest leaves it."""
    rows = chunk_documents(st.document_texts(spark, sf), TEXT_CFG, keep=("document_id", "original_filename"))
    return stored(embed_chunks(rows, TEXT_CFG).drop("original_filename", "embed_error"), "chunks")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return embed_questions(st.text_questions(spark, sf), TEXT_CFG).drop("embed_error")


RETRIEVE_CTES = ",\n".join(
    [
        st.REGISTRY,
        DOC_CHUNKS,
        st.QUESTIONS,
        "live AS (SELECT c.* FROM chunks c JOIN registry r USING (document_id) WHERE r.status = 'completed')",
        st.slots_ctes("live", "document_id, chunk_index", st.INPUT_SQL, "cv", TEXT_CFG.embedding_dim),
        st.slots_ctes("questions", "question_id", "question", "qv", TEXT_CFG.embedding_dim),
        """cn AS (SELECT document_id, chunk_index, sqrt(sum(v * v)) AS n FROM cv GROUP BY ALL),
qn AS (SELECT question_id, sqrt(sum(v * v)) AS n FROM qv GROUP BY ALL),
dots AS (SELECT q.question_id, c.document_id, c.chunk_index, sum(q.v * c.v) AS dot
  FROM qv q JOIN cv c ON c.slot = q.slot GROUP BY ALL),
asked AS (SELECT *, coalesce(nullif(top_k, 0), 6) AS k FROM questions),
scored AS (
  SELECT d.question_id, d.document_id, d.chunk_index, round(d.dot / (qn.n * cn.n), 9) AS s, a.k, a.question
  FROM dots d JOIN cn USING (document_id, chunk_index) JOIN qn USING (question_id) JOIN asked a USING (question_id)
  JOIN registry r USING (document_id)
  WHERE (coalesce(a.document_id, '') = '' OR a.document_id = r.document_id)
    AND (coalesce(a.collection, '') = '' OR a.collection = r.collection)
    AND (coalesce(a.user_id, '') = '' OR a.user_id = r.user_id))""",
    ]
)


def gate_ctes(pool: str) -> str:
    return f"""ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY s DESC, document_id, chunk_index) AS INTEGER) AS ann_rank
  FROM scored QUALIFY ann_rank <= {pool}),
gated AS (
  SELECT g.*, c.content, c.heading, c.page_number, c.original_filename, count(*) OVER (PARTITION BY g.question_id) AS left_over
  FROM ranked g JOIN chunks c USING (document_id, chunk_index) WHERE g.s >= {TEXT_CFG.min_score}),
scored_again AS (
  SELECT *, list_distinct(regexp_extract_all(lower(question), '[^{WS}]+')) AS qw,
         regexp_extract_all(lower(content), '[^{WS}]+') AS cw FROM gated),
lexical AS (
  SELECT * EXCLUDE (qw, cw), CASE WHEN left_over > k THEN CAST(len(list_intersect(qw, cw)) AS DOUBLE) / len(qw) END AS lex
  FROM scored_again)"""


RERANKED = """final AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY lex DESC NULLS LAST, ann_rank) AS INTEGER) AS n
  FROM lexical QUALIFY n <= k)"""
FINAL_CTES = ",\n".join([RETRIEVE_CTES, gate_ctes("greatest(k, 30)"), RERANKED])


def retrieved(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieve(asked(spark, sf), text_chunks(spark, sf), st.registry(spark, sf), TEXT_CFG)
    return rows.select(
        "question_id", "n", "document_id", "chunk_index", "original_filename", "page_number", "heading", "content", "score"
    )


RETRIEVE_SQL = with_ctes(
    FINAL_CTES,
    select="""SELECT question_id, n, document_id, chunk_index, original_filename, page_number, heading, content,
  s AS score FROM final""",
)


def reranked(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieve(asked(spark, sf), text_chunks(spark, sf), st.registry(spark, sf), TEXT_CFG)
    return rows.select(
        "question_id", "n", "document_id", "chunk_index", "ann_rank", F.round("rerank_score", 6).alias("rerank_score")
    )


RERANK_SQL = with_ctes(
    FINAL_CTES,
    select="SELECT question_id, n, document_id, chunk_index, ann_rank, round(lex, 6) AS rerank_score FROM final",
)


def shared_letters():
    """A pair model for the query: how many letters of the pair are an e; it fails on contents with a marker."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        if any("Q: " in content for _, content in pairs):
            raise RuntimeError("cannot score")
        return [float((question + content).count("e")) for question, content in pairs]

    return score


def reranked_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Every question's first chunks of documents scored by a pair model in batches; some pairs fail."""
    chunks = chunk_documents(st.conversation_texts(spark, sf), st.SMALL, keep=("document_id",))
    pool = chunks.filter(F.length("content") < 500).select(
        F.col("document_id").alias("question_id"), F.lit("Where were they seen?").alias("question"),
        F.when(F.col("chunk_index") % 3 == 2, F.concat(F.lit("Q: "), "content")).otherwise(F.col("content")).alias("content"),
        (F.col("chunk_index") + 1).alias("ann_rank"), F.lit(4).alias("top_k"),
    )
    rows = rerank(pool, pair_scores(EngineConfig(rerank_batch=7), shared_letters))
    return rows.select("question_id", "n", "ann_rank", "rerank_score", "rerank_error")


RERANK_MODEL_SQL = with_ctes(
    CONV_CHUNKS,
    select="""SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC NULLS LAST, ann_rank) AS INTEGER) AS n,
  ann_rank, rerank_score, rerank_error FROM (
  SELECT document_id AS question_id, chunk_index + 1 AS ann_rank, count(*) OVER (PARTITION BY document_id) > 4 AS worth,
    CASE WHEN worth AND chunk_index % 3 <> 2 THEN CAST(7 + length(content) - length(replace(content, 'e', '')) AS DOUBLE) END AS rerank_score,
    CASE WHEN worth AND chunk_index % 3 = 2 THEN 'cannot score' END AS rerank_error
  FROM chunks WHERE length(content) < 500) QUALIFY n <= 4""",
)


def without_reranker(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieve(asked(spark, sf), text_chunks(spark, sf), st.registry(spark, sf), TEXT_CFG, scorer=None)
    return rows.select("question_id", "n", "document_id", "chunk_index", "score")


NO_RERANK_SQL = with_ctes(
    RETRIEVE_CTES,
    gate_ctes("k"),
    select="SELECT question_id, ann_rank AS n, document_id, chunk_index, s AS score FROM lexical",
)


def source_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunk_documents(st.conversation_texts(spark, sf), st.SMALL, keep=("document_id", "original_filename"))
    label = wording.source_label(F.col("original_filename"), F.col("page_number"), F.col("heading"))
    return rows.select("document_id", "chunk_index", label.alias("label"))


LABEL_SQL = (
    "original_filename || CASE WHEN coalesce(page_number, 0) <> 0 THEN ', p.' || page_number ELSE '' END"
    " || CASE WHEN coalesce(heading, '') <> '' THEN ' — ' || heading ELSE '' END"
)


def citation_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as a reader sees them; the score is cut to halves of a percent that print alike everywhere."""
    rows = with_sources(gated_pool(asked(spark, sf), text_chunks(spark, sf), st.registry(spark, sf), TEXT_CFG).withColumn("n", F.col("ann_rank")))
    shown = F.floor(F.col("score") * 100) / 100
    label = wording.citation_label(F.col("n"), F.col("original_filename"), F.col("page_number"), F.col("heading"), shown)
    return rows.select("question_id", "n", label.alias("label"))


CITATION_LABELS_SQL = with_ctes(
    RETRIEVE_CTES,
    gate_ctes("greatest(k, 30)"),
    select="""SELECT question_id, ann_rank AS n,
  '[' || ann_rank || '] ' || original_filename
  || CASE WHEN coalesce(page_number, 0) <> 0 THEN ' - p.' || page_number ELSE '' END
  || CASE WHEN coalesce(heading, '') <> '' THEN ' - ' || heading ELSE '' END
  || printf(' (score %.2f)', floor(s * 100) / 100) AS label FROM gated""",
)


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return answer_inputs(asked(spark, sf), text_chunks(spark, sf), st.registry(spark, sf), TEXT_CFG)


def citations(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("question_id", F.explode("citations").alias("c")).select("question_id", "c.*")


CITATIONS_SQL = with_ctes(
    FINAL_CTES,
    select="""SELECT question_id, n, document_id, original_filename AS filename, page_number, heading,
  s AS score FROM final""",
)


def built_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("question_id", "user_prompt")


PROMPTS_SQL = with_ctes(
    FINAL_CTES,
    select=f"""SELECT q.question_id,
  CASE WHEN count(f.n) > 0 THEN 'Question: ' || q.question || chr(10) || chr(10) || 'Sources:' || chr(10)
  || string_agg('[' || f.n || '] (' || {LABEL_SQL.replace('original_filename', 'f.original_filename').replace('page_number', 'f.page_number').replace('heading', 'f.heading')}
       || ')' || chr(10) || f.content, chr(10) || chr(10) ORDER BY f.n)
  || chr(10) || chr(10) || '{wording.CLOSING_INSTRUCTION}' END AS user_prompt
FROM questions q LEFT JOIN final f USING (question_id) GROUP BY q.question_id, q.question""",
)


def system_prompts(spark: SparkSession, sf: str) -> DataFrame:
    prompt = wording.system_prompt(F.col("voice"), F.col("lang"))
    return st.text_questions(spark, sf).select("question_id", prompt.alias("system_prompt"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SYSTEM_SQL = with_ctes(
    st.QUESTIONS,
    select=f"""SELECT question_id,
  CASE WHEN voice THEN {_quoted(wording.SYSTEM_PROMPT_VOICE)} ELSE {_quoted(wording.SYSTEM_PROMPT)} END
  || CASE lower(coalesce(lang, '')) WHEN 'en' THEN ' Answer in English.' WHEN 'sv' THEN ' Answer in Swedish.' ELSE '' END
  AS system_prompt FROM questions""",
)


def no_hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = _answers(spark, sf)
    return rows.select("question_id", "answer", F.size("citations").alias("n_citations"))


NO_HITS_SQL = with_ctes(
    FINAL_CTES,
    select=f"""SELECT q.question_id, CASE WHEN count(f.n) = 0 THEN {_quoted(wording.NO_HITS_ANSWER)} END AS answer,
  CAST(count(f.n) AS INTEGER) AS n_citations
FROM questions q LEFT JOIN final f USING (question_id) GROUP BY q.question_id""",
)


def mixed_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark questions, four of five with something wrong: empty, top_k 99, a failing model, an empty vector."""
    q = st.text_questions(spark, sf)
    case = F.col("question_id").cast("long") % 5
    bad = q.withColumn("case", case).withColumn("question", F.when(case == 1, F.lit("")).when(case == 3, F.concat(F.lit("FAIL "), "question")).otherwise(F.col("question")))
    bad = bad.withColumn("top_k", F.when(case == 2, F.lit(99)).otherwise(F.col("top_k")))

    def failing():
        model = HashedWords(TEXT_CFG.embedding_dim)

        def embed(texts: list[str]):
            if any(t.startswith("FAIL ") for t in texts):
                raise RuntimeError("model is down")
            return model(texts)

        return embed

    rows = embed_questions(bad, TEXT_CFG, failing)
    return rows.withColumn("q_vec", F.when(case == 4, F.array().cast("array<float>")).otherwise(F.col("q_vec"))).drop("case")


def failed_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of each question's stream beside what was found for it."""
    answers = stored(answer_inputs(mixed_questions(spark, sf), text_chunks(spark, sf), st.registry(spark, sf), TEXT_CFG), "answers")
    none = spark.createDataFrame([], "question_id string, seq long, text string, stage string, message string")
    first = answer_events(answers, none.select("question_id", "seq", "text"), none.select("question_id", "stage", "message")).filter("seq = 0")
    shown = answers.select("question_id", "error", "answer", F.col("user_prompt").isNotNull().alias("has_prompt"), F.size("citations").alias("n_citations"))
    return shown.join(first.select("question_id", "type", "message"), "question_id")


FAILED_SQL = with_ctes(
    FINAL_CTES,
    f"""outcome AS (
  SELECT q.question_id, CAST(q.question_id AS BIGINT) % 5 AS c, count(f.n) AS hits,
    CASE CAST(q.question_id AS BIGINT) % 5 WHEN 1 THEN 'invalid question: question too short' WHEN 2 THEN 'invalid question: top_k out of range'
      WHEN 3 THEN 'embedding failed: model is down' WHEN 4 THEN 'embedding failed: no usable vector' END AS error
  FROM questions q LEFT JOIN final f USING (question_id) GROUP BY q.question_id)""",
    select=f"""SELECT question_id, error, CASE WHEN error IS NULL AND hits = 0 THEN {_quoted(wording.NO_HITS_ANSWER)} END AS answer,
  error IS NULL AND hits > 0 AS has_prompt, CAST(CASE WHEN error IS NULL THEN hits ELSE 0 END AS INTEGER) AS n_citations,
  CASE WHEN error IS NULL THEN 'citations' ELSE 'error' END AS type, error AS message FROM outcome""",
)


QUERIES = {
    "cosine_scores": cosine_scores,
    "vector_text": vector_texts,
    "knn_topk": nearest_to_request,
    "knn_join": nearest_neighbours,
    "knn_join_blocks": neighbours_in_blocks,
    "ann_topk": approximate_neighbours,
    "ann_all_cells": neighbours_in_all_cells,
    "ann_recall": recall_by_probes,
    "failed_questions": failed_questions,
    "score_gate": gated_neighbours,
    "scope_filter": completed_in_scope,
    "chunk_document_join": chunks_with_documents,
    "colocated_join": colocated_chunks,
    "retrieve": retrieved,
    "rerank": reranked,
    "rerank_model": reranked_by_model,
    "knn_no_rerank": without_reranker,
    "source_labels": source_labels,
    "citation_labels": citation_labels,
    "citations": citations,
    "build_prompts": built_prompts,
    "system_prompts": system_prompts,
    "no_hits": no_hits,
}

ORACLE = {
    "cosine_scores": COSINE_SQL,
    "vector_text": VECTOR_TEXT_SQL,
    "knn_topk": KNN_TOPK_SQL,
    "knn_join": KNN_JOIN_SQL,
    "knn_join_blocks": KNN_JOIN_SQL,
    "ann_all_cells": KNN_JOIN_SQL,
    "ann_recall": RECALL_SQL,
    "failed_questions": FAILED_SQL,
    "score_gate": GATE_SQL,
    "scope_filter": SCOPE_SQL,
    "chunk_document_join": CHUNK_DOC_SQL,
    "colocated_join": CHUNK_DOC_SQL,
    "retrieve": RETRIEVE_SQL,
    "rerank": RERANK_SQL,
    "rerank_model": RERANK_MODEL_SQL,
    "knn_no_rerank": NO_RERANK_SQL,
    "source_labels": with_ctes(CONV_CHUNKS, select=f"SELECT document_id, chunk_index, {LABEL_SQL} AS label FROM chunks"),
    "citation_labels": CITATION_LABELS_SQL,
    "citations": CITATIONS_SQL,
    "build_prompts": PROMPTS_SQL,
    "system_prompts": SYSTEM_SQL,
    "no_hits": NO_HITS_SQL,
}
