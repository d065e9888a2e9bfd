"""Question tables to ranked, cited passages and prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators.cite import prompts
from ..operators.rerank import lexical_score, rerank, vector_cut
from ..operators.search import knn_join, score_gate, visible_chunks
from ..operators.validate import check_questions
from ..session import broadcast_if_bounded, stored

DETAILS = ("page_number", "heading", "content")


def with_errors(questions: DataFrame) -> DataFrame:
    """Add ``error``: why a question can have no search, else null.

    ``questions`` has q_vec and, from ``embed_questions``, embed_error.
    """
    if "top_k" not in questions.columns:
        questions = questions.withColumn("top_k", F.lit(None).cast("int"))
    vector = F.col("q_vec")
    unknown = vector.isNull() | (F.size(vector) < 1) | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    cause = F.col("embed_error") if "embed_error" in questions.columns else F.lit(None).cast("string")
    failed = F.concat(F.lit("embedding failed: "), F.coalesce(cause, F.lit("no usable vector")))
    reason = F.concat(F.lit("invalid question: "), F.col("reason"))
    checked = check_questions(questions)
    return checked.withColumn("error", F.coalesce(reason, F.when(unknown, failed))).drop("reason")


def gated_pool(questions: DataFrame, chunks: DataFrame, documents: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Scope, score, pool and gate; then content and file name for the survivors.

    Only ids, scopes and vectors take part in the search. Content is read in a
    second narrow scan for the pooled rows, and the registry gives file names.
    ``chunks`` holds one run per document (``Tables.visible_chunks``).
    The pooled rows are stored and measured: where they are small, they are broadcast
    to both scans and neither table is shuffled. A question that fails its check
    (length, top_k) takes no part.
    """
    questions = check_questions(questions if "top_k" in questions.columns else questions.withColumn("top_k", F.lit(None).cast("int")))
    questions = questions.filter(F.col("reason").isNull()).drop("reason")
    scoped = visible_chunks(chunks, documents, cfg, ["embedding"])
    hits = stored(score_gate(knn_join(scoped, questions, cfg, min_score=cfg.min_score), cfg), "hits")
    names = documents.select("document_id", "original_filename")
    named = stored(names.join(broadcast_if_bounded(hits, cfg.broadcast_bytes), "document_id"), "hits")
    small = broadcast_if_bounded(named, cfg.broadcast_bytes)
    rows = chunks.select("document_id", "chunk_index", *DETAILS).join(small, ["document_id", "chunk_index"])
    asked = questions.select(F.col("question_id").cast("string").alias("question_id"), "question")
    return rows.join(broadcast_if_bounded(asked, cfg.broadcast_bytes), "question_id")


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    cfg: EngineConfig,
    scorer: Callable[[Column, Column], Column] | None = lexical_score,
) -> DataFrame:
    """The final numbered rows of every question.

    Order of steps: defaults, scope, score, pool limit, gate, rerank when more
    than top_k rows are left, numbering. Without a scorer the pool is top_k and
    the vector order stands.
    """
    usable = cfg.rerank and scorer is not None
    cfg = cfg if usable else EngineConfig(**{**cfg.__dict__, "rerank": False})
    pool = gated_pool(questions, chunks, documents, cfg)
    return rerank(pool, scorer) if usable else vector_cut(pool)


def answer_inputs(
    questions: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    cfg: EngineConfig,
    scorer: Callable[[Column, Column], Column] | None = lexical_score,
) -> DataFrame:
    """One row per question: citations, prompts, the fixed answer, or an error.

    A question that fails its check and one whose embedding failed get ``error`` and neither prompt nor answer: only a
    search that ran can say that nothing was found. Vectors are computed once, here.
    """
    asked = stored(with_errors(questions), "asked")
    return prompts(retrieve(asked.filter(F.col("error").isNull()), chunks, documents, cfg, scorer), asked)
