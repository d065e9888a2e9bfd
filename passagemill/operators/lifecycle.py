"""Document lifecycle: status log, job log, replacing, reprocessing, deleting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.wording import shorten_error
from ..session import broadcast_if_bounded

TERMINAL = ["completed", "failed"]


def latest_status(log: DataFrame) -> DataFrame:
    """Each document's newest status and error, with ``updated_at`` touched.

    ``log``: document_id, at, event_id, status, error_message. Every status also
    sets the error, so an old error vanishes with the next status. ``max_by``
    combines before the shuffle: a document with a long log is no hot spot.
    """
    newest = F.max_by(
        F.struct("status", shorten_error(F.col("error_message")).alias("error_message")), F.struct("at", "event_id")
    )
    return (
        log.groupBy("document_id")
        .agg(newest.alias("s"), F.max("at").alias("updated_at"))
        .select(
            "document_id",
            "s.status",
            "s.error_message",
            "updated_at",
            F.col("s.status").isin(TERMINAL).alias("is_terminal"),
        )
    )


def job_log(entries: DataFrame) -> DataFrame:
    """Fold open and close entries into one row per job.

    ``entries``: job_id, document_id, status, at, error_message. A job opens as
    ``running``; a closing entry sets the end time, the state and the error.
    """
    closing = F.col("status").isin(TERMINAL)
    when_closed = F.when(closing, F.col("at"))
    folded = entries.groupBy("job_id", "document_id").agg(
        F.min(F.when(~closing, F.col("at"))).alias("started_at"),
        F.max(when_closed).alias("completed_at"),
        F.max_by(
            F.struct("status", shorten_error(F.col("error_message")).alias("error_message")), when_closed
        ).alias("end"),
    )
    return folded.select(
        "job_id",
        "document_id",
        F.coalesce("end.status", F.lit("running")).alias("status"),
        "started_at",
        "completed_at",
        F.col("end.error_message").alias("error_message"),
    )


def stale_rows(rows: DataFrame, documents: DataFrame, pointer: str = "active_attempt") -> DataFrame:
    """Rows in attempts that no registry row points to any more; safe to purge."""
    pairs = documents.select("document_id", F.col(pointer).alias("attempt"))
    return rows.join(pairs, ["document_id", "attempt"], "left_anti")


def apply_run(documents: DataFrame, outcome: DataFrame, run_id: str) -> DataFrame:
    """Registry after a run: successes point to the new run, failures keep the old one.

    ``outcome``: document_id and error (null for success), one row per document
    of the run.
    """
    done = outcome.select("document_id", F.lit(True).alias("_ran"), shorten_error(F.col("error")).alias("_error"))
    joined = documents.join(done, "document_id", "left")
    ran = F.col("_ran").isNotNull()
    good = ran & F.col("_error").isNull()
    return joined.select(
        *[c for c in documents.columns if c not in ("status", "error_message", "active_run_id")],
        F.when(~ran, F.col("status")).when(good, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        F.when(~ran, F.col("error_message")).otherwise(F.col("_error")).alias("error_message"),
        F.when(good, F.lit(run_id)).otherwise(F.col("active_run_id")).alias("active_run_id"),
    )


def reprocess_candidates(documents: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Documents to run again, set to processing with the error cleared.

    All: every row with a stored original. By id: exactly the given rows.
    """
    rows = documents.filter(F.col("storage_path") != "") if ids is None else documents.join(
        ids.select("document_id").distinct(), "document_id", "left_semi"
    )
    return rows.withColumn("status", F.lit("processing")).withColumn("error_message", F.lit(None).cast("string"))


def delete_cascade(deleted: DataFrame, cfg: EngineConfig, *tables: DataFrame) -> list[DataFrame]:
    """The given tables without rows of the deleted documents.

    Deleted ids are broadcast when they measure small, so that big tables are
    filtered where they lie.
    """
    gone = broadcast_if_bounded(deleted.select("document_id").distinct(), cfg.broadcast_bytes)
    return [t.join(gone, "document_id", "left_anti") for t in tables]


def purge_paths(deleted: DataFrame, documents: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Files to remove for deleted documents: the original, if any, and the Markdown."""
    rows = documents.join(deleted.select("document_id").distinct(), "document_id", "left_semi")
    original = F.when(F.coalesce(F.col("storage_path") != "", F.lit(False)), F.col("storage_path"))
    markdown = F.concat(F.lit(f"{cfg.storage_root}/markdown/"), F.col("document_id"), F.lit(".md"))
    paths = F.explode(F.array_compact(F.array(original, markdown)))
    return rows.select("document_id", paths.alias("path"))

