"""Embedding: input text, batched model hook, returned vectors matched to chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.vectors import HashedWords
from ..functions.wording import embedding_input
from ..session import small_batches

EmbedFn = Callable[[list[str]], list[np.ndarray]]


def embedder(cfg: EngineConfig, make_model: Callable[[], EmbedFn] | None = None) -> Callable[[Column], Column]:
    """A column function: text to ``struct<vector, error>``, ``cfg.embed_batch`` texts per call.

    The model is built once per task. Calls are filled across documents: rows of
    one Arrow batch share a call whatever document they come from. If a call
    fails, its texts are tried one by one and only those that fail again carry
    an error, so one document cannot fail another. A reply counts as failed if it has
    another number of vectors than texts, or a vector of another width than
    ``cfg.embedding_dim``: nothing is shifted to other texts.
    """
    build = make_model or partial(HashedWords, cfg.embedding_dim)
    size = cfg.embed_batch

    def asked(model: EmbedFn, texts: list[str]) -> list:
        found = list(model(texts))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        for vector in found:
            if len(vector) != cfg.embedding_dim:
                raise ValueError(f"a vector of {len(vector)} numbers, not {cfg.embedding_dim}")
        return found

    def one_by_one(model: EmbedFn, texts: list[str]) -> tuple[list, list]:
        vectors, errors = [], []
        for text in texts:
            try:
                vectors.append(asked(model, [text])[0])
                errors.append(None)
            except Exception as exc:  # noqa: BLE001 - the failure belongs to its text
                vectors.append(None)
                errors.append(str(exc)[:1000])
        return vectors, errors

    @F.pandas_udf("struct<vector:array<float>,error:string>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = build()
        for texts in batches:
            values = texts.tolist()
            vectors: list = []
            errors: list = []
            for at in range(0, len(values), size):
                part = values[at : at + size]
                try:
                    vectors.extend(asked(model, part))
                    errors.extend([None] * len(part))
                except Exception:  # noqa: BLE001
                    found, failed = one_by_one(model, part)
                    vectors.extend(found)
                    errors.extend(failed)
            yield pd.DataFrame(
                {"vector": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)}
            )

    return embed


def embed_chunks(
    chunks: DataFrame, cfg: EngineConfig, make_model: Callable[[], EmbedFn] | None = None
) -> DataFrame:
    """Add ``embedding`` and ``embed_error``; needs original_filename, heading and content."""
    small_batches(chunks.sparkSession)
    text = embedding_input(F.col("original_filename"), F.col("heading"), F.col("content"))
    out = chunks.withColumn("_e", embedder(cfg, make_model)(text))
    return out.withColumn("embedding", F.col("_e.vector")).withColumn("embed_error", F.col("_e.error")).drop("_e")


def embed_questions(
    questions: DataFrame, cfg: EngineConfig, make_model: Callable[[], EmbedFn] | None = None
) -> DataFrame:
    """Add ``q_vec`` and ``embed_error``; the question text is embedded as it is."""
    small_batches(questions.sparkSession)
    out = questions.withColumn("_e", embedder(cfg, make_model)(F.col("question")))
    return out.withColumn("q_vec", F.col("_e.vector")).withColumn("embed_error", F.col("_e.error")).drop("_e")


def attach_vectors(chunks: DataFrame, vectors: DataFrame, keys: tuple[str, ...] = ("document_id", "chunk_index")) -> DataFrame:
    """Join returned vectors to their chunks by key and flag the missing ones.

    Matching by key instead of by position: a short answer cannot shift vectors
    to other chunks or drop chunks unseen.
    """
    joined = chunks.join(vectors, list(keys), "left")
    return joined.withColumn("vector_missing", F.col("embedding").isNull())
