"""Files or parsed documents to searchable tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.ids import stable_id
from ..functions.text import is_blank
from ..functions.wording import shorten_error
from ..operators.chunk import chunk_documents
from ..operators.embed import EmbedFn, embed_chunks
from ..operators.lifecycle import apply_run
from ..operators.parse import ParseFn, document_markdown, parse_files
from ..operators.validate import check_uploads
from ..session import broadcast_if_bounded, spread
from ..sources.files import register, scan_files
from ..sources.tables import FINISHED, PROCESSING, UPLOADED, Tables

# Registry columns that never change and travel with the chunks.
CARRIED = ("document_id", "original_filename", "collection", "user_id")
NO_TEXT = "no text could be read from the file"
NO_CHUNKS = "the text gave no searchable piece"

Clock = Callable[[], datetime]


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def stamp(clock: Clock) -> Column:
    return F.lit(clock()).cast("timestamp")


def run_ingest(
    tables: Tables,
    registered: DataFrame,
    markdown: DataFrame,
    cfg: EngineConfig,
    run_id: str,
    make_model: Callable[[], EmbedFn] | None = None,
    clock: Clock = utc_now,
    attempt: str | None = None,
) -> str:
    """One ingest run over registry rows and their Markdown (document_id, markdown, error).

    Returns the attempt. Registry rows in state processing and opened jobs come first, the outcome
    last, each with the time of its writing. Each stage is written before the next one
    reads it, so a lost executor recomputes one stage and the parser or model is not
    called again. Documents fail one by one: a parse error, an empty or missing text or a
    failed embedding is recorded on its document.
    """
    attempt = attempt or tables.begin()
    begun = registered.withColumns({
        "status": F.lit("processing"), "error_message": F.lit(None).cast("string"),
        "updated_at": stamp(clock), "step": F.lit(PROCESSING),
    })
    tables.write("documents", attempt, run_id, begun)
    rows = tables.read_attempt("documents", attempt).filter(F.col("step") == PROCESSING)
    job = stable_id(F.lit(attempt), F.col("document_id")).alias("job_id")
    tables.write("jobs", attempt, run_id, rows.select(job, "document_id", F.lit("running").alias("status"), stamp(clock).alias("at")))

    names = broadcast_if_bounded(rows.select(*CARRIED), cfg.broadcast_bytes)
    texts = markdown.join(names, "document_id")
    error = F.when(F.col("error").isNotNull(), shorten_error(F.col("error"))).when(
        is_blank(F.col("markdown")), F.lit(NO_TEXT)
    )
    tables.write(
        "markdown", attempt, run_id, texts.withColumn("error", error).withColumnRenamed("markdown", "markdown_text")
    )

    parsed = tables.read_attempt("markdown", attempt)
    chunks = chunk_documents(
        spread(parsed.filter(F.col("error").isNull()), "document_id"), cfg, "markdown_text", CARRIED
    )
    embedded = embed_chunks(chunks, cfg, make_model)
    tables.write(
        "chunks",
        attempt,
        run_id,
        embedded.withColumn("id", stable_id(F.col("document_id"), F.lit(run_id), F.col("chunk_index")))
        .withColumn("metadata", F.lit("{}"))
        .withColumn("created_at", stamp(clock)),
    )

    written = (
        tables.read_attempt("chunks", attempt)
        .groupBy("document_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("embed_error").alias("embed_error"))
    )
    outcome = (
        rows.select("document_id")
        .join(parsed.select("document_id", "error", F.lit(True).alias("read")), "document_id", "left")
        .join(written, "document_id", "left")
        .select(
            "document_id",
            F.coalesce(
                "error", F.when(F.col("read").isNull(), F.lit(NO_TEXT)), "embed_error",
                F.when(F.col("n").isNull(), F.lit(NO_CHUNKS)),
            ).alias("error"),
        )
    )
    done = apply_run(rows, outcome, run_id)
    good = F.col("error_message").isNull()
    ended = done.withColumns({
        "active_attempt": F.when(good, F.lit(attempt)).otherwise(F.col("active_attempt")),
        "markdown_storage_path": F.when(good, F.lit(tables.folder("markdown", attempt))).otherwise(F.col("markdown_storage_path")),
        "updated_at": stamp(clock), "step": F.lit(FINISHED),
    })
    tables.write("documents", attempt, run_id, ended)

    finished = tables.read_attempt("documents", attempt).filter(F.col("step") == FINISHED)
    closed = finished.select(job, "document_id", "status", stamp(clock).alias("at"), "error_message")
    tables.write("jobs", attempt, run_id, closed)
    return attempt


def ingest_uploads(
    tables: Tables,
    uploads: DataFrame,
    cfg: EngineConfig,
    make_parser: Callable[[], ParseFn],
    run_id: str,
    make_model: Callable[[], EmbedFn] | None = None,
    clock: Clock = utc_now,
) -> str:
    """Keep the originals of accepted uploads, register and ingest them; returns the attempt.

    ``uploads``: document_id, filename, mime, length, content. Everything after the first stage
    reads the stored originals. A document that is known keeps its creation time and the
    pointers to its last good run.
    """
    attempt = tables.begin()
    tables.write("originals", attempt, run_id, uploads)
    files = tables.read_attempt("originals", attempt)
    pointers = ["created_at", "active_run_id", "active_attempt", "markdown_storage_path"]
    known = tables.documents().select("document_id", F.struct(*pointers).alias("known"))
    rows = register(files, cfg, None, stamp(clock)).withColumns({
        "active_attempt": F.lit(None).cast("string"), "original_attempt": F.lit(attempt),
        "storage_path": F.lit(tables.folder("originals", attempt)), "step": F.lit(UPLOADED),
    }).join(known, "document_id", "left")
    merged = rows.withColumns({c: F.coalesce(F.col(f"known.{c}"), F.col(c)) for c in pointers})
    tables.write("documents", attempt, run_id, merged)
    registered = tables.read_attempt("documents", attempt).filter(F.col("step") == UPLOADED)
    markdown = document_markdown(parse_files(files, make_parser))
    return run_ingest(tables, registered, markdown, cfg, run_id, make_model, clock, attempt)


def ingest_files(
    tables: Tables,
    path: str,
    cfg: EngineConfig,
    make_parser: Callable[[], ParseFn],
    run_id: str,
    make_model: Callable[[], EmbedFn] | None = None,
    clock: Clock = utc_now,
) -> DataFrame:
    """Scan a folder, validate, register, parse and ingest; returns the rejected files.

    The folder is listed once. Oversized files are judged by their listed size; their
    bytes are not read.
    """
    judged = check_uploads(scan_files(tables.spark, path, cfg.max_upload_bytes), cfg)
    accepted = judged.filter(F.col("reject_code").isNull()).withColumn("document_id", stable_id(F.col("path")))
    ingest_uploads(tables, accepted, cfg, make_parser, run_id, make_model, clock)
    return judged.drop("content").filter(F.col("reject_code").isNotNull())
