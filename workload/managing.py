"""Registry listings, lifecycle jobs, reports and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import wording
from passagemill.operators import lifecycle as life
from passagemill.operators.containment import containing, write_leaf_index
from passagemill.operators import registry as reg
from passagemill.schemas import JOB_STATUSES
from passagemill.session import new_run_dir, spread
from passagemill.streaming.answers import use_rocksdb
from passagemill.streaming import status as live
from passagemill.streaming.status import stream_latest_status, stream_status_view

from . import standins as st
from .answering import arriving, newest_rows
from .standins import CFG, table, with_ctes

EVENT_STATUS = {
    "signup": "queued", "view": "uploading", "click": "processing", "purchase": "completed", "error": "failed",
}
STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_STATUS.items()) + " END"


def status_of_event():
    out = F.lit(None).cast("string")
    for name, status in EVENT_STATUS.items():
        out = F.when(F.col("event_type") == name, F.lit(status)).otherwise(out)
    return out


def status_log(events: DataFrame) -> DataFrame:
    """Events as status changes: the user is the document; an error carries its props."""
    return events.select(
        F.col("user_id").cast("string").alias("document_id"),
        F.col("ts").alias("at"),
        "event_id",
        status_of_event().alias("status"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("error "), F.col("props"))).alias("error_message"),
    )


def text_chunk_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as chunk rows of a document."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("chunk_index")
    )


# Listings -------------------------------------------------------------------


def shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("created_s", F.unix_seconds("created_at")).drop("created_at", "updated_at")


def listed(spark: SparkSession, sf: str) -> DataFrame:
    rows = reg.list_documents(st.registry(spark, sf), text_chunk_keys(spark, sf), collection="", user_id="en", limit=200)
    return shown(rows)


LIST_SQL = with_ctes(
    st.REGISTRY,
    select="""SELECT document_id, original_filename, file_type, status, error_message, collection, user_id,
  (SELECT count(*) FROM conversations c WHERE CAST(c.conv_id AS VARCHAR) = r.document_id) AS chunk_count, created_s
FROM registry r WHERE user_id = 'en' ORDER BY created_s DESC, document_id LIMIT 200""",
)


def looked_up(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "embeddings").select((F.col("vec_id") * 3).cast("string").alias("document_id"))
    return shown(reg.get_documents(ids, st.registry(spark, sf), text_chunk_keys(spark, sf), CFG))


GET_SQL = with_ctes(
    st.REGISTRY,
    select="""SELECT CAST(e.vec_id * 3 AS VARCHAR) AS document_id, original_filename, file_type, status, error_message,
  collection, user_id, created_s, r.document_id IS NOT NULL AS found,
  (SELECT count(*) FROM conversations c WHERE c.conv_id = e.vec_id * 3) AS chunk_count
FROM embeddings e LEFT JOIN registry r ON r.document_id = CAST(e.vec_id * 3 AS VARCHAR)""",
)


def counted(spark: SparkSession, sf: str) -> DataFrame:
    docs = st.registry(spark, sf).select("document_id")
    return reg.chunk_counts(docs, text_chunk_keys(spark, sf))


COUNTS_SQL = """SELECT CAST(doc_id AS VARCHAR) AS document_id,
  (SELECT count(*) FROM conversations c WHERE c.conv_id = d.doc_id) AS chunk_count FROM documents d"""


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as different services return them: some without names."""
    rows = reg.chunk_counts(st.registry(spark, sf), text_chunk_keys(spark, sf))
    unnamed = F.col("user_id").isin("de", "fr")
    return rows.withColumn("filename", F.when(F.col("user_id") == "de", F.lit("")).otherwise(F.col("original_filename"))).withColumn(
        "original_filename", F.when(unnamed, F.lit("")).otherwise(F.col("original_filename"))
    )


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return reg.normalize_documents(raw_rows(spark, sf))


NORMALIZE_SQL = with_ctes(
    st.REGISTRY,
    select="""SELECT document_id, status,
  (SELECT count(*) FROM conversations c WHERE CAST(c.conv_id AS VARCHAR) = r.document_id) AS chunk_count,
  error_message, CASE WHEN user_id = 'de' THEN document_id ELSE original_filename END AS filename, collection
FROM registry r""",
)


def options(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw_rows(spark, sf).select("document_id", "status", F.col("original_filename").alias("filename"))
    return reg.scope_options(rows)


OPTIONS_SQL = with_ctes(
    st.REGISTRY,
    select="""SELECT document_id, CASE WHEN user_id IN ('de', 'fr') THEN document_id ELSE original_filename END AS label
FROM registry WHERE status = 'completed'""",
)


def upserted(spark: SparkSession, sf: str) -> DataFrame:
    """The newest polled states replace known rows of the same id."""
    known = reg.normalize_documents(raw_rows(spark, sf))
    newest = life.latest_status(status_log(table(spark, sf, "events")))
    polled = newest.select(
        "document_id", "status", F.lit(None).cast("bigint").alias("chunk_count"), "error_message",
        F.concat(F.lit("polled_"), F.col("document_id")).alias("filename"), F.lit(None).cast("string").alias("collection"),
    )
    return reg.upsert_documents(known, polled)


LATEST = f"""latest AS (
  SELECT CAST(user_id AS VARCHAR) AS document_id, {STATUS_SQL} AS status,
         CASE WHEN event_type = 'error' THEN 'error ' || props END AS error_message, ts
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""

UPSERT_SQL = with_ctes(
    st.REGISTRY,
    LATEST,
    select=f"""SELECT * FROM ({NORMALIZE_SQL[NORMALIZE_SQL.index('SELECT document_id, status,'):]})
WHERE document_id NOT IN (SELECT document_id FROM latest)
UNION ALL
SELECT document_id, status, CAST(NULL AS BIGINT), error_message, 'polled_' || document_id, NULL FROM latest""",
)


def rollup(spark: SparkSession, sf: str) -> DataFrame:
    log = status_log(table(spark, sf, "events"))
    return reg.status_rollup(log.select("document_id", "status"), "document_id")


ROLLUP_SQL = f"""SELECT document_id, uploading, processing, queued, completed, failed,
  concat_ws(' - ', CASE WHEN uploading > 0 THEN uploading || ' uploading' END,
    CASE WHEN processing > 0 THEN processing || ' processing' END, CASE WHEN queued > 0 THEN queued || ' queued' END,
    CASE WHEN completed > 0 THEN completed || ' completed' END, CASE WHEN failed > 0 THEN failed || ' failed' END) AS summary
FROM (SELECT CAST(user_id AS VARCHAR) AS document_id,
  count(*) FILTER (event_type = 'view') AS uploading, count(*) FILTER (event_type = 'click') AS processing,
  count(*) FILTER (event_type = 'signup') AS queued, count(*) FILTER (event_type = 'purchase') AS completed,
  count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id)"""


def queue_heads(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("queue"), F.col("event_id").alias("qid"),
        F.concat(F.lit("file_"), F.col("event_id").cast("string")).alias("filename"), status_of_event().alias("status"),
    )
    return reg.next_queued(rows, "queue")


QUEUE_SQL = """SELECT user_id AS queue, min(event_id) AS qid, 'file_' || min(event_id) AS filename
FROM events WHERE event_type = 'signup' GROUP BY user_id"""


def by_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return reg.metadata_filter(table(spark, sf, "events"), "props", {"k": "69"}).select("event_id", "props")


METADATA_SQL = "SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k') = '69'"


def nested_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Events with what is known of them as one nested JSON text."""
    name = F.col("event_type")
    meta = F.to_json(F.struct(
        F.struct(F.col("user_id").alias("id"), F.array(name, F.lit("web")).alias("tags")).alias("user"),
        F.array(F.struct(name.alias("type"), (F.col("event_id") % 5).alias("level")), F.struct(F.lit("none").alias("type"), F.lit(0).cast("long").alias("level"))).alias("steps"),
        (F.col("event_id") % 2 == 0).alias("even"), F.lit(None).cast("string").alias("note"), F.lit(1.5).alias("a.b'c"),
    ), {"ignoreNullFields": "false"})
    return spread(table(spark, sf, "events"), "event_id").select("event_id", meta.alias("metadata"))


# The name of the last field has a dot and a quote.
PATTERN = {"user": {"tags": ["web", "purchase"]}, "steps": [{"level": 3, "type": "purchase"}, {}], "even": True, "note": None, "a.b'c": 1.5}


def by_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Scan of all texts."""
    return containing(nested_metadata(spark, sf), "event_id", "metadata", PATTERN).select("event_id")


def by_leaf_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows found through a written index of leaves."""
    rows = nested_metadata(spark, sf)
    path = new_run_dir(spark, "leaves")
    write_leaf_index(rows, "event_id", "metadata", path)
    return containing(rows, "event_id", "metadata", PATTERN, spark.read.parquet(path)).select("event_id")


CONTAIN_SQL = """SELECT event_id FROM (
  SELECT event_id, CAST(to_json({'user': {'id': user_id, 'tags': [event_type, 'web']},
    'steps': [{'type': event_type, 'level': event_id % 5}, {'type': 'none', 'level': 0}],
    'even': event_id % 2 = 0, 'note': NULL, 'a.b''c': 1.5}) AS VARCHAR) AS metadata FROM events)
WHERE json_contains(metadata, '{"user":{"tags":["web","purchase"]},"steps":[{"level":3,"type":"purchase"},{}],"even":true,"note":null,"a.b''c":1.5}')"""


# Lifecycle ------------------------------------------------------------------


def micros(rows: DataFrame, *names: str) -> DataFrame:
    for name in names:
        rows = rows.withColumn(name, F.unix_micros(F.col(name).cast("timestamp")))
    return rows


def latest(spark: SparkSession, sf: str) -> DataFrame:
    return micros(life.latest_status(status_log(table(spark, sf, "events"))), "updated_at")


LATEST_SQL = with_ctes(
    LATEST,
    select="""SELECT document_id, status, error_message, epoch_us(ts) AS updated_at,
  status IN ('completed', 'failed') AS is_terminal FROM latest""",
)


def streamed_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The same view kept by a stream over the event files."""
    root = new_run_dir(spark, "status")
    schema = table(spark, sf, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    changes = stream_latest_status(status_log(arriving))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/view/batch={number}")

    query = (
        changes.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    view = spark.read.parquet(f"{root}/view")
    state = F.struct("status", "error_message", "updated_at", "is_terminal")
    newest = view.groupBy("document_id").agg(F.max_by(state, F.col("batch")).alias("s"))
    return micros(newest.select("document_id", "s.*"), "updated_at")


def streamed_view(spark: SparkSession, sf: str) -> DataFrame:
    """The live view over events that arrive in any order; every seventh event removes its document."""
    use_rocksdb(spark)
    root = new_run_dir(spark, "view")
    log = status_log(table(spark, sf, "events"))
    log = log.withColumn("status", F.when(F.col("event_id") % 7 == 0, F.lit("deleted")).otherwise(F.col("status")))
    changes = stream_status_view(arriving(spark, root, log), remember=True)
    rows = live.shown(newest_rows(changes, root, "document_id"))
    return micros(rows, "updated_at")


VIEW_SQL = with_ctes(
    LATEST.replace("error_message, ts", "error_message, ts, event_id"),
    select="""SELECT document_id, status, error_message, epoch_us(ts) AS updated_at,
  status IN ('completed', 'failed') AS is_terminal FROM latest WHERE event_id % 7 <> 0""",
)


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Every event opens a job; purchases and errors close theirs ``value`` seconds later."""
    events = table(spark, sf, "events")
    job = F.concat(F.lit("job_"), F.col("event_id").cast("string")).alias("job_id")
    doc = F.col("user_id").cast("string").alias("document_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    opened = events.select(job, doc, F.lit("running").alias("status"), at.alias("at"), F.lit(None).cast("string").alias("error_message"))
    closed = events.filter(F.col("event_type").isin("purchase", "error")).select(
        job, doc, status_of_event().alias("status"),
        (at + F.round(F.col("value") * 1000000).cast("bigint")).alias("at"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"),
    )
    return life.job_log(opened.unionByName(closed))


JOBS_SQL = """SELECT 'job_' || event_id AS job_id, CAST(user_id AS VARCHAR) AS document_id,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
  epoch_us(ts) AS started_at,
  CASE WHEN event_type IN ('purchase', 'error') THEN epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) END AS completed_at,
  CASE WHEN event_type = 'error' THEN props END AS error_message FROM events"""


def to_reprocess(spark: SparkSession, sf: str) -> DataFrame:
    rows = life.reprocess_candidates(st.registry(spark, sf))
    return rows.select("document_id", "storage_path", "file_type", "status", "error_message")


REPROCESS_SQL = with_ctes(
    st.REGISTRY,
    select="""SELECT document_id, storage_path, file_type, 'processing' AS status, CAST(NULL AS VARCHAR) AS error_message
FROM registry WHERE storage_path <> ''""",
)


def queued_count(spark: SparkSession, sf: str) -> DataFrame:
    return life.reprocess_candidates(st.registry(spark, sf)).agg(F.count(F.lit(1)).alias("queued"))


def toxic_documents(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").filter(F.col("toxic") == 1)
    return labels.select(F.col("doc_id").cast("string").alias("document_id"))


def cascaded(spark: SparkSession, sf: str) -> DataFrame:
    """What three tables keep after deleting all toxic documents."""
    docs = st.registry(spark, sf).select("document_id")
    chunks = text_chunk_keys(spark, sf).select("document_id")
    job_rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("document_id"))
    names = ("documents", "chunks", "jobs")
    kept = life.delete_cascade(toxic_documents(spark, sf), CFG, docs, chunks, job_rows)
    out = None
    for name, rows in zip(names, kept):
        counts = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("kept")).withColumn("table_name", F.lit(name))
        out = counts if out is None else out.unionByName(counts)
    return out


CASCADE_SQL = """WITH gone AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT CAST(id AS VARCHAR) AS document_id, count(*) AS kept, table_name FROM (
  SELECT doc_id AS id, 'documents' AS table_name FROM documents
  UNION ALL SELECT conv_id, 'chunks' FROM conversations
  UNION ALL SELECT user_id, 'jobs' FROM events)
WHERE id NOT IN (SELECT doc_id FROM gone) GROUP BY id, table_name"""


def purged(spark: SparkSession, sf: str) -> DataFrame:
    return life.purge_paths(toxic_documents(spark, sf), st.registry(spark, sf), CFG)


PURGE_SQL = with_ctes(
    st.REGISTRY,
    "gone AS (SELECT CAST(doc_id AS VARCHAR) AS document_id FROM labels WHERE toxic = 1)",
    select="""SELECT document_id, storage_path AS path FROM registry JOIN gone USING (document_id) WHERE storage_path <> ''
UNION ALL
SELECT document_id, '/data/storage/markdown/' || document_id || '.md' FROM registry JOIN gone USING (document_id)""",
)


def report(spark: SparkSession, sf: str) -> DataFrame:
    """Rules over tables that break them: raw event states, vectors of another size, unknown users."""
    vectors = st.vector_chunks(spark, sf).withColumn("content", F.lit("text"))
    turns = text_chunk_keys(spark, sf).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("content", F.lit("text"))
    chunks = vectors.drop("label").unionByName(turns)
    job_rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("document_id"), status_of_event().alias("status"))
    return reg.constraint_report(st.registry(spark, sf), chunks, job_rows, 1536, JOB_STATUSES)


REPORT_SQL = with_ctes(
    st.REGISTRY,
    """chunk_rows AS (
  SELECT CAST(vec_id AS VARCHAR) AS document_id, 0 AS chunk_index, len(embedding) AS dim FROM embeddings
  UNION ALL SELECT CAST(conv_id AS VARCHAR), turn, NULL FROM conversations)""",
    f"job_rows AS (SELECT CAST(user_id AS VARCHAR) AS document_id, {STATUS_SQL} AS status FROM events)",
    select="""SELECT 'not null' AS rule, 'documents' AS table_name, count(*) AS violations FROM registry
  WHERE document_id IS NULL OR original_filename IS NULL OR file_type IS NULL OR storage_path IS NULL OR status IS NULL
UNION ALL SELECT 'not null', 'chunks', count(*) FROM chunk_rows WHERE document_id IS NULL OR chunk_index IS NULL
UNION ALL SELECT 'primary key', 'documents', count(*) FROM (SELECT document_id FROM registry GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'status value', 'documents', count(*) FROM registry WHERE status NOT IN ('uploaded', 'processing', 'completed', 'failed')
UNION ALL SELECT 'status value', 'jobs', count(*) FROM job_rows WHERE status NOT IN ('queued', 'running', 'completed', 'failed')
UNION ALL SELECT 'unique', 'chunks', count(*) FROM (SELECT 1 FROM chunk_rows GROUP BY document_id, chunk_index HAVING count(*) > 1)
UNION ALL SELECT 'foreign key', 'chunks', count(*) FROM chunk_rows WHERE document_id NOT IN (SELECT document_id FROM registry)
UNION ALL SELECT 'foreign key', 'jobs', count(*) FROM job_rows WHERE document_id NOT IN (SELECT document_id FROM registry)
UNION ALL SELECT 'vector dimension', 'chunks', count(*) FROM chunk_rows WHERE dim <> 1536""",
)


# Formats --------------------------------------------------------------------


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Byte sizes of all magnitudes: the text length, its square and its cube."""
    docs = table(spark, sf, "documents")
    n = F.col("n_chars").cast("double")
    return docs.select(
        "doc_id",
        wording.format_bytes(F.col("n_chars") - 100).alias("small"),
        wording.format_bytes(n * n).alias("middle"),
        wording.format_bytes(n * n * n).alias("large"),
        wording.short_id(F.md5(F.col("doc_id").cast("string"))).alias("short_id"),
    )


def _size_sql(value: str) -> str:
    scaled = f"({value} / CASE WHEN {value} >= 1073741824 THEN 1073741824.0::DOUBLE WHEN {value} >= 1048576 THEN 1048576.0::DOUBLE WHEN {value} >= 1024 THEN 1024.0::DOUBLE ELSE 1.0::DOUBLE END)"
    unit = f"CASE WHEN {value} >= 1073741824 THEN ' GB' WHEN {value} >= 1048576 THEN ' MB' WHEN {value} >= 1024 THEN ' KB' ELSE ' B' END"
    return (
        f"CASE WHEN {value} <= 0 THEN '0 B' WHEN {scaled} >= 10 OR {value} < 1024 THEN printf('%.0f', floor({scaled} + 0.5)) || {unit}"
        f" ELSE printf('%.1f', floor({scaled} * 10 + 0.5) / 10) || {unit} END"
    )


SIZES_SQL = f"""SELECT doc_id, {_size_sql('(n - 100)')} AS small, {_size_sql('(n * n)')} AS middle,
  {_size_sql('(n * n * n)')} AS large, substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) || '...' AS short_id
FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n FROM documents)"""


QUERIES = {
    "list_documents": listed,
    "get_documents": looked_up,
    "chunk_counts": counted,
    "normalize_documents": normalized,
    "scope_options": options,
    "upsert_documents": upserted,
    "status_rollup": rollup,
    "next_queued": queue_heads,
    "metadata_filter": by_metadata,
    "metadata_contains": by_containment,
    "metadata_contains_index": by_leaf_index,
    "latest_status": latest,
    "stream_latest_status": streamed_latest,
    "stream_status_view": streamed_view,
    "job_log": jobs,
    "reprocess_candidates": to_reprocess,
    "queued_count": queued_count,
    "delete_cascade": cascaded,
    "purge_paths": purged,
    "constraint_report": report,
    "format_bytes": sizes,
}

ORACLE = {
    "list_documents": LIST_SQL,
    "get_documents": GET_SQL,
    "chunk_counts": COUNTS_SQL,
    "normalize_documents": NORMALIZE_SQL,
    "scope_options": OPTIONS_SQL,
    "upsert_documents": UPSERT_SQL,
    "status_rollup": ROLLUP_SQL,
    "next_queued": QUEUE_SQL,
    "metadata_filter": METADATA_SQL,
    "metadata_contains": CONTAIN_SQL,
    "metadata_contains_index": CONTAIN_SQL,
    "latest_status": LATEST_SQL,
    "stream_latest_status": LATEST_SQL,
    "stream_status_view": VIEW_SQL,
    "job_log": JOBS_SQL,
    "reprocess_candidates": REPROCESS_SQL,
    "queued_count": with_ctes(st.REGISTRY, select="SELECT count(*) AS queued FROM registry WHERE storage_path <> ''"),
    "delete_cascade": CASCADE_SQL,
    "purge_paths": PURGE_SQL,
    "constraint_report": REPORT_SQL,
    "format_bytes": SIZES_SQL,
}
