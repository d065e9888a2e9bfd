"""Stored tables over time: running documents again, deleting them, compacting and purging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators.embed import EmbedFn
from ..operators.lifecycle import reprocess_candidates
from ..operators.parse import ParseFn, document_markdown, parse_files
from ..sources.tables import FINISHED, Tables
from .ingest import Clock, run_ingest, stamp, utc_now

# Tables whose rows the registry points to, with the column that does.
POINTERS = {"originals": "original_attempt", "markdown": "active_attempt", "chunks": "active_attempt"}


def reprocess(
    tables: Tables,
    cfg: EngineConfig,
    make_parser: Callable[[], ParseFn],
    run_id: str,
    ids: DataFrame | None = None,
    make_model: Callable[[], EmbedFn] | None = None,
    clock: Clock = utc_now,
) -> str:
    """Parse and ingest documents again from their stored originals; returns the attempt.

    All documents with a stored original, or those of ``ids`` (document_id) among them.
    """
    kept = tables.documents().filter(F.col("original_attempt").isNotNull())
    rows = reprocess_candidates(kept, ids)
    originals = tables.held("originals", rows, "original_attempt", cfg)
    return run_ingest(tables, rows, document_markdown(parse_files(originals, make_parser)), cfg, run_id, make_model, clock)


def delete_documents(tables: Tables, ids: DataFrame, run_id: str, clock: Clock = utc_now) -> str:
    """Delete the documents of ``ids`` (document_id): tombstones end them at once; returns the attempt.

    Unknown ids add nothing. ``compact`` and ``purge`` remove the bytes.
    """
    attempt = tables.begin()
    gone = tables.documents().join(ids.select("document_id").distinct(), "document_id", "left_semi")
    none = F.lit(None).cast("string")
    marked = gone.withColumns({
        "deleted": F.lit(True), "updated_at": stamp(clock), "step": F.lit(FINISHED),
        "active_run_id": none, "active_attempt": none, "original_attempt": none,
    })
    tables.write("documents", attempt, run_id, marked)
    return attempt


def compact(tables: Tables, cfg: EngineConfig, run_id: str) -> str:
    """Copy all that the registry points to into one attempt, the registry rows last; returns the attempt.

    Afterwards no row points to what was there before, so ``purge`` removes it. Run it
    while no ingest runs: registry rows written meanwhile by an earlier attempt would lose.
    """
    attempt = tables.begin()
    rows = tables.documents()
    for name, pointer in POINTERS.items():
        tables.copy(name, attempt, tables.held(name, rows, pointer, cfg).drop("attempt"))
    moved = {c: F.when(F.col(c).isNotNull(), F.lit(attempt)) for c in ("original_attempt", "active_attempt")}
    moved["storage_path"] = F.when(F.col("original_attempt").isNotNull(), F.lit(tables.folder("originals", attempt))).otherwise(F.col("storage_path"))
    moved["markdown_storage_path"] = F.when(F.col("active_attempt").isNotNull(), F.lit(tables.folder("markdown", attempt)))
    tables.write("documents", attempt, run_id, rows.withColumns(moved).withColumn("step", F.lit(FINISHED)))
    return attempt


def purge(tables: Tables) -> dict[str, list[str]]:
    """Remove attempt folders that no newest registry row names; returns them by table.

    A registry folder stays while it holds some document's newest row, so a tombstone outlives the
    rows it ends; older folders go first. The job log stays. Only attempt numbers, one
    per run, come to the driver. Run it while no ingest runs: an attempt without registry rows yet
    would lose what it wrote.
    """
    newest = tables.newest()
    named = newest.select(F.explode(F.array("attempt", "active_attempt", "original_attempt")).alias("a")).distinct()
    in_use = {r["a"] for r in named.collect()}
    own = {r["attempt"] for r in newest.select("attempt").distinct().collect()}
    removed = {}
    for name, keep in [*((name, in_use) for name in POINTERS), ("documents", own)]:
        removed[name] = [a for a in tables.attempts(name) if a not in keep]
        for attempt in removed[name]:
            tables.remove(name, attempt)
    return removed
