"""The document registry: listings, lookups, reports and checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.wording import present
from ..schemas import DOC_STATUSES
from ..session import broadcast_if_bounded
from .search import list_filter
from .validate import LIST_DEFAULT, check_list_limit

SHOWN = (
    "document_id", "original_filename", "file_type", "status", "error_message",
    "collection", "user_id", "created_at", "updated_at",
)


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks per document, 0 when there are none.

    Counting before the join leaves one row per document, whatever its size.
    """
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return documents.join(counts, "document_id", "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0).cast("bigint"))
    )


def chunk_document_join(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Inner join of chunks to their documents by id."""
    return chunks.join(documents, "document_id")


def list_documents(
    documents: DataFrame,
    chunks: DataFrame,
    collection: str | None = None,
    user_id: str | None = None,
    limit: int = LIST_DEFAULT,
) -> DataFrame:
    """The newest documents with their chunk counts.

    The page is cut first (at most 1000 rows, broadcast), so only the chunks of
    listed documents are counted.
    """
    page = (
        list_filter(documents, collection, user_id)
        .select(*SHOWN)
        .orderBy(F.col("created_at").desc(), "document_id")
        .limit(check_list_limit(limit))
    )
    listed = chunks.select("document_id").join(F.broadcast(page.select("document_id")), "document_id", "left_semi")
    return chunk_counts(page, listed).orderBy(F.col("created_at").desc(), "document_id")


def get_documents(ids: DataFrame, documents: DataFrame, chunks: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Point lookups for a table of ids; ``found`` is false for an unknown id."""
    asked = broadcast_if_bounded(ids.select("document_id").distinct(), cfg.broadcast_bytes)
    wanted = chunks.select("document_id").join(asked, "document_id", "left_semi")
    known = documents.select(*SHOWN).withColumn("found", F.lit(True))
    return chunk_counts(asked.join(known, "document_id", "left"), wanted).withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def normalize_documents(rows: DataFrame) -> DataFrame:
    """Uniform rows: the name is the first filled of original name, name, id."""
    names = [F.col(c) for c in ("original_filename", "filename") if c in rows.columns]
    filled = [F.when(present(n), n) for n in names]
    return rows.select(
        "document_id",
        "status",
        "chunk_count",
        "error_message",
        F.coalesce(*filled, F.col("document_id")).alias("filename"),
        "collection",
    )


def scope_options(rows: DataFrame) -> DataFrame:
    """Documents a question can be scoped to: completed ones, labelled by name or id."""
    return rows.filter(F.col("status") == "completed").select(
        "document_id", F.when(present(F.col("filename")), F.col("filename")).otherwise(F.col("document_id")).alias("label")
    )


def upsert_documents(known: DataFrame, polled: DataFrame) -> DataFrame:
    """Polled rows replace known rows of the same id; new ids are added."""
    columns = known.columns
    kept = known.join(polled.select("document_id"), "document_id", "left_anti")
    return kept.select(*columns).unionByName(polled.select(*columns))


# The states of an upload queue, in the order they are reported.
QUEUE_STATES = ["uploading", "processing", "queued", "completed", "failed"]


def status_rollup(rows: DataFrame, by: str) -> DataFrame:
    """Counts per state and one text such as ``2 queued - 1 failed``."""
    counts = rows.groupBy(by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in QUEUE_STATES])
    parts: list[Column] = [
        F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in QUEUE_STATES
    ]
    return counts.withColumn("summary", F.concat_ws(" - ", *parts))


def next_queued(rows: DataFrame, by: str) -> DataFrame:
    """The first queued entry of every queue, in arrival order."""
    first = F.min_by(F.struct("qid", "filename"), F.col("qid")).alias("first")
    return rows.filter(F.col("status") == "queued").groupBy(by).agg(first).select(by, "first.qid", "first.filename")


def metadata_filter(rows: DataFrame, column: str, wanted: Mapping[str, str]) -> DataFrame:
    """Rows whose JSON metadata holds all the given top-level values as text (names without a single quote); ``containment`` has the rest."""
    for name, value in wanted.items():
        rows = rows.filter(F.get_json_object(column, f"$['{name}']") == value)
    return rows


def _any_null(columns: list[str]) -> Column:
    return F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False))


def _facts(rows: DataFrame, counts: dict[str, Column], keys: list[str]) -> DataFrame:
    """Per document: rows, repeated keys and the rows that break a rule, from one pass over ``rows``.

    Counting by the whole key first spreads a document with very many rows.
    """
    by_key = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(bad).alias(name) for name, bad in counts.items()])
    sums = [F.sum(name).alias(name) for name in ("rows", *counts)]
    return by_key.groupBy("document_id").agg(*sums, F.count_if(F.col("rows") > 1).alias("repeated"))


def constraint_report(
    documents: DataFrame, chunks: DataFrame, jobs: DataFrame, dim: int, job_statuses: list[str]
) -> DataFrame:
    """Violations per declared rule; all zero for sound tables.

    Every table is read once: what a rule needs is counted by key, then by document, where the three tables meet.
    """
    tables = {
        "documents": _facts(
            documents,
            {"empty": _any_null(["document_id", "original_filename", "file_type", "storage_path", "status"]),
             "status": ~F.col("status").isin(DOC_STATUSES)},
            ["document_id"],
        ),
        "chunks": _facts(
            chunks,
            {"empty": _any_null(["document_id", "chunk_index", "content"]), "width": F.size("embedding") != dim},
            ["document_id", "chunk_index"],
        ),
        "jobs": _facts(jobs, {"status": ~F.col("status").isin(job_statuses)}, ["document_id"]),
    }
    names = {table: [c for c in facts.columns if c != "document_id"] for table, facts in tables.items()}
    every = [f"{table}_{c}" for table, columns in names.items() for c in columns]
    met = None
    for table, facts in tables.items():
        own = {f"{table}_{c}": F.col(c) for c in names[table]}
        part = facts.select("document_id", *[own.get(c, F.lit(0)).cast("long").alias(c) for c in every])
        met = part if met is None else met.unionByName(part)
    met = met.groupBy("document_id").agg(*[F.sum(c).alias(c) for c in every])
    orphan = F.col("document_id").isNull() | (F.col("documents_rows") == 0)
    checks = [
        ("not null", "documents", F.col("documents_empty")),
        ("not null", "chunks", F.col("chunks_empty")),
        ("primary key", "documents", F.col("documents_repeated")),
        ("status value", "documents", F.col("documents_status")),
        ("status value", "jobs", F.col("jobs_status")),
        ("unique", "chunks", F.col("chunks_repeated")),
        ("foreign key", "chunks", F.when(orphan, F.col("chunks_rows"))),
        ("foreign key", "jobs", F.when(orphan, F.col("jobs_rows"))),
        ("vector dimension", "chunks", F.col("chunks_width")),
    ]
    totals = met.agg(*[F.coalesce(F.sum(bad), F.lit(0).cast("long")).alias(f"_{i}") for i, (_, _, bad) in enumerate(checks)])
    lines = [
        F.struct(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), F.col(f"_{i}").alias("violations"))
        for i, (rule, table, _) in enumerate(checks)
    ]
    return totals.select(F.inline(F.array(*lines)))
