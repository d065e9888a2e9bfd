"""Stored tables over time: replayed runs, job times, deleting, running again, compacting and purging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.operators.lifecycle import job_log
from passagemill.plans.ingest import ingest_uploads, run_ingest
from passagemill.plans.upkeep import compact, delete_documents, purge, reprocess
from passagemill.session import new_run_dir
from passagemill.sources.tables import PROCESSING, Tables

from . import standins as st
from .ingesting import DOC_CHUNKS, INGEST_SQL, page_files, paragraph_parser, parsed_texts, registered_rows, run_summary
from .managing import toxic_documents
from .standins import CFG, SMALL, strip_sql, with_ctes


def _library(spark: SparkSession, sf: str, label: str) -> Tables:
    """All documents, ingested once as run r1."""
    tables = Tables(spark, new_run_dir(spark, label)).create_if_missing()
    run_ingest(tables, registered_rows(spark, sf), parsed_texts(spark, sf), CFG, "r1")
    return tables


def replayed_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run, a repeat of it that dies after its chunks, and one that ends: as if run once."""
    tables = _library(spark, sf, "replay")
    died = tables.begin()
    rows = tables.documents()
    half = tables.read("chunks").withColumn("content", F.lit("half-written repeat")).withColumn("token_count", F.lit(1))
    tables.write("documents", died, "r1", rows.withColumn("status", F.lit("processing")).withColumn("step", F.lit(PROCESSING)))
    tables.write("chunks", died, "r1", half)
    run_ingest(tables, registered_rows(spark, sf), parsed_texts(spark, sf), CFG, "r1")
    return run_summary(tables)


def ingest_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The stored job log of a run; a job lasts from before parsing until its outcome is written."""
    jobs = job_log(_library(spark, sf, "jobs").read("jobs"))
    return jobs.select("document_id", "status", "error_message", (F.col("completed_at") > F.col("started_at")).alias("lasted"))


JOBS_SQL = with_ctes(
    st.REGISTRY,
    select="""SELECT document_id, CASE WHEN error_message IS NULL THEN 'completed' ELSE 'failed' END AS status,
  error_message, true AS lasted FROM registry""",
)


def delete_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Toxic documents deleted from stored tables: no registry row, no chunks."""
    tables = _library(spark, sf, "delete")
    delete_documents(tables, toxic_documents(spark, sf), "d1")
    return run_summary(tables)


GONE = "(SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"


def reprocess_all(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose parser refused German ones, run again from their originals with one that reads all."""
    tables = Tables(spark, new_run_dir(spark, "reprocess")).create_if_missing()
    uploads = page_files(spark, sf).withColumns({
        "filename": F.concat(F.lit("page_"), F.col("document_id")), "mime": F.lit("text/html"), "length": F.octet_length("content"),
    })
    ingest_uploads(tables, uploads, CFG, paragraph_parser, "r1")
    reprocess(tables, SMALL, lambda: lambda content: bytes(content).decode("utf-8").split("</p>"), "r2")
    chunks = tables.visible_chunks(CFG).groupBy("document_id", "run_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("tokens")
    )
    return tables.documents().select("document_id", "status", "error_message").join(chunks, "document_id", "left")


REPROCESS_ALL_SQL = with_ctes(
    f"""paras AS (SELECT CAST(page_id AS VARCHAR) AS document_id, html, string_split(html, '</p>') AS parts FROM pages),
texts AS (
  SELECT document_id, 'page_' || document_id AS original_filename,
         CASE WHEN len(parts) = 1 THEN html ELSE array_to_string(
           [('<!-- page: ' || i || ' -->' || chr(10) || chr(10) || {strip_sql('parts[i]')}) FOR i IN range(1, len(parts) + 1)],
           chr(10) || chr(10)) END AS markdown
  FROM paras)""",
    st.sections_ctes("texts", "sec"),
    st.chunks_ctes("sec", "chunks", SMALL),
    select="""SELECT document_id, 'completed' AS status, CAST(NULL AS VARCHAR) AS error_message, 'r2' AS run_id,
  count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS tokens FROM chunks GROUP BY document_id""",
)


def purge_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that is still stored after a second run over French and German documents, deleting, compacting and purging.

    German documents of bad quality failed twice and have nothing; toxic ones are gone.
    """
    tables = Tables(spark, new_run_dir(spark, "purge")).create_if_missing()
    whole = st.document_texts(spark, sf).withColumn("error", F.lit(None).cast("string")).drop("original_filename")
    run_ingest(tables, registered_rows(spark, sf), whole, CFG, "r1")
    again = tables.documents().filter(F.col("user_id").isin("fr", "de"))
    texts = parsed_texts(spark, sf).join(again.select("document_id"), "document_id", "left_semi")
    run_ingest(tables, again, texts, SMALL, "r2")
    delete_documents(tables, toxic_documents(spark, sf), "d1")
    compact(tables, CFG, "c1")
    purge(tables)
    kept = [
        tables.read(name).groupBy("document_id", "run_id").agg(F.count(F.lit(1)).alias("n")).withColumn("table_name", F.lit(name))
        for name in ("chunks", "markdown")
    ]
    return kept[0].unionByName(kept[1])


PURGE_RUNS_SQL = with_ctes(
    st.REGISTRY,
    DOC_CHUNKS,
    st.chunks_ctes("sec", "small", SMALL),
    f"""runs AS (
  SELECT document_id, CASE WHEN user_id IN ('fr', 'de') AND error_message IS NULL THEN 'r2' ELSE 'r1' END AS run_id
  FROM registry WHERE document_id NOT IN {GONE})""",
    select="""SELECT document_id, run_id, count(*) AS n, 'chunks' AS table_name
FROM runs JOIN (SELECT document_id, 'r1' AS run_id FROM chunks UNION ALL SELECT document_id, 'r2' FROM small)
USING (document_id, run_id) GROUP BY ALL
UNION ALL SELECT document_id, run_id, 1, 'markdown' FROM runs""",
)

QUERIES = {
    "replayed_run": replayed_run,
    "ingest_jobs": ingest_jobs,
    "delete_documents": delete_stored,
    "reprocess_all": reprocess_all,
    "purge_runs": purge_runs,
}

ORACLE = {
    "replayed_run": INGEST_SQL,
    "ingest_jobs": JOBS_SQL,
    "delete_documents": f"SELECT * FROM ({INGEST_SQL}) WHERE document_id NOT IN {GONE}",
    "reprocess_all": REPROCESS_ALL_SQL,
    "purge_runs": PURGE_RUNS_SQL,
}
