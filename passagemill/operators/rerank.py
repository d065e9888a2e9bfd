"""Second scoring of the pool by a (question, content) scorer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EngineConfig
from ..functions.vectors import words

_WORD = re.compile(r"\s*\S+")
PairFn = Callable[[list[tuple[str, str]]], list[float]]


def lexical_score(question: Column, content: Column) -> Column:
    """Default scorer: the share of the question's distinct words in the content."""
    asked = F.array_distinct(words(question))
    found = F.size(F.array_intersect(asked, words(content))).cast("double")
    return F.coalesce(F.try_divide(found, F.size(asked).cast("double")), F.lit(0.0))


def _cut(question: str, content: str, most: int) -> tuple[str, str]:
    """A pair of at most ``most`` words together; the question keeps its own first."""
    asked = _WORD.findall(question)
    if len(asked) >= most:
        return "".join(asked[:most]), ""
    found = _WORD.findall(content)
    room = most - len(asked)
    return question, content if len(found) <= room else "".join(found[:room])


def pair_scores(cfg: EngineConfig, make_model: Callable[[], PairFn]) -> Callable[[Column, Column], Column]:
    """A cross-encoder hook: ``struct<score, error>`` of (question, content), ``cfg.rerank_batch`` pairs per call.

    The model is built once per task. Pairs are cut to ``cfg.rerank_max_tokens`` words and, inside an Arrow batch, called in order of
    length, so that pairs of a call are alike. A call that fails, or replies with another number of scores, is
    repeated pair by pair, and only pairs that fail again carry an error. Rows with a null question are not worth
    scoring and never reach the model; a null content counts as empty.
    """
    size, most = cfg.rerank_batch, cfg.rerank_max_tokens

    def asked(model: PairFn, pairs: list[tuple[str, str]]) -> list[float]:
        found = [float(s) for s in model(pairs)]
        if len(found) != len(pairs):
            raise ValueError(f"{len(found)} scores for {len(pairs)} pairs")
        return found

    def scored(model: PairFn, pairs: list[tuple[str, str]]) -> list[tuple[float | None, str | None]]:
        try:
            return [(s, None) for s in asked(model, pairs)]
        except Exception as exc:  # noqa: BLE001 - the failure belongs to its pair
            if len(pairs) == 1:
                return [(None, str(exc)[:1000])]
        return [scored(model, [pair])[0] for pair in pairs]

    @F.pandas_udf("struct<score:double,error:string>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for questions, contents in batches:
            rows = np.flatnonzero(questions.notna().to_numpy())
            pairs = [_cut(questions.iloc[i], contents.iloc[i] if contents.iloc[i] is not None else "", most) for i in rows]
            order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][0]) + len(pairs[k][1]))
            scores: list = [None] * len(questions)
            errors: list = [None] * len(questions)
            for at in range(0, len(order), size):
                part = order[at : at + size]
                for k, (value, error) in zip(part, scored(model, [pairs[k] for k in part])):
                    scores[rows[k]], errors[rows[k]] = value, error
            yield pd.DataFrame({"score": pd.Series(scores, dtype="float64"), "error": pd.Series(errors, dtype=object)})

    return score


def pair_scorer(cfg: EngineConfig, make_model: Callable[[], PairFn]) -> Callable[[Column, Column], Column]:
    """The scores of ``pair_scores`` alone; NaN where there is none."""
    score = pair_scores(cfg, make_model)
    return lambda question, content: F.coalesce(score(question, content)["score"], F.lit(float("nan")))


def rerank(
    pool: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_score
) -> DataFrame:
    """Cut every question's gated pool to its top_k.

    Only a question with more rows than top_k is reordered by the scorer; equal
    scores keep the vector order. The citation score stays the cosine. ``pool``
    has question_id, question, content, ann_rank and top_k; a group is never
    larger than the pool. With a scorer that tells errors (``pair_scores``) the rows have
    ``rerank_error``; a row without a score stands behind those that have one.
    """
    whole = Window.partitionBy("question_id")
    sized = pool.withColumn("_n", F.count(F.lit(1)).over(whole))
    worth = F.col("_n") > F.col("top_k")
    score = scorer(F.when(worth, F.col("question")), F.col("content"))
    scored = sized.withColumn("_score", F.when(worth, score))
    if isinstance(scored.schema["_score"].dataType, T.StructType):
        scored = scored.withColumn("rerank_error", F.col("_score.error")).withColumn("_score", F.col("_score.score"))
    scored = scored.withColumn("rerank_score", F.col("_score")).drop("_score")
    order = whole.orderBy(F.nanvl("rerank_score", F.lit(None).cast("double")).desc_nulls_last(), "ann_rank")
    return scored.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= F.col("top_k")).drop("_n")


def vector_cut(pool: DataFrame) -> DataFrame:
    """Without a scorer: the first top_k in vector order."""
    order = Window.partitionBy("question_id").orderBy("ann_rank")
    return pool.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= F.col("top_k"))
