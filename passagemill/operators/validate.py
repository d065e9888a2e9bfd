"""Intake checks: each row gets a reason, nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig

QUESTION_MAX = 2000
TOP_K_MAX = 50
LIST_DEFAULT = 200
LIST_MAX = 1000


def upload_reason(mime: Column, size: Column, cfg: EngineConfig) -> Column:
    """415 for a type outside the allow-list, then 413 for the size, else null."""
    kind = F.lower(F.coalesce(mime, F.lit("")))
    return F.when(~kind.isin(cfg.allowed_mimes), F.lit(415)).when(size > cfg.max_upload_bytes, F.lit(413))


def check_uploads(files: DataFrame, cfg: EngineConfig, mime: str = "mime", size: str = "length") -> DataFrame:
    return files.withColumn("reject_code", upload_reason(F.col(mime), F.col(size), cfg))


def split_uploads(files: DataFrame, cfg: EngineConfig, **columns: str) -> tuple[DataFrame, DataFrame]:
    checked = check_uploads(files, cfg, **columns)
    accepted = checked.filter(F.col("reject_code").isNull()).drop("reject_code")
    return accepted, checked.filter(F.col("reject_code").isNotNull())


def check_questions(questions: DataFrame) -> DataFrame:
    """Length 1..2000 characters; ``top_k`` null or 1..50."""
    size = F.length(F.coalesce(F.col("question"), F.lit("")))
    reason = (
        F.when(size < 1, F.lit("question too short"))
        .when(size > QUESTION_MAX, F.lit("question too long"))
        .when(~F.col("top_k").between(1, TOP_K_MAX), F.lit("top_k out of range"))
    )
    return questions.withColumn("reason", reason)


def check_list_limit(limit: int = LIST_DEFAULT) -> int:
    if not 1 <= limit <= LIST_MAX:
        raise ValueError(f"limit must be in 1..{LIST_MAX}")
    return limit
