"""Declared schemas of the stored tables and of the records in flight."""

from pyspark.sql import types as T

DOC_STATUSES = ["uploaded", "processing", "completed", "failed"]
JOB_STATUSES = ["queued", "running", "completed", "failed"]

DOCUMENTS = T.StructType([
    T.StructField("document_id", T.StringType(), False),
    T.StructField("original_filename", T.StringType(), False),
    T.StructField("file_type", T.StringType(), False),
    T.StructField("storage_path", T.StringType(), False),
    T.StructField("markdown_storage_path", T.StringType()),
    T.StructField("status", T.StringType(), False),
    T.StructField("error_message", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("collection", T.StringType()),
    T.StructField("metadata", T.StringType(), False),
    T.StructField("active_run_id", T.StringType()),
    T.StructField("active_attempt", T.StringType()),
    T.StructField("original_attempt", T.StringType()),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
    T.StructField("step", T.IntegerType(), False),
    T.StructField("deleted", T.BooleanType()),
    T.StructField("run_id", T.StringType(), False),
    T.StructField("attempt", T.StringType(), False),
])

ORIGINALS = T.StructType([
    T.StructField("document_id", T.StringType(), False),
    T.StructField("filename", T.StringType()),
    T.StructField("mime", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("run_id", T.StringType(), False),
    T.StructField("attempt", T.StringType(), False),
])

MARKDOWN = T.StructType([
    T.StructField("document_id", T.StringType(), False),
    T.StructField("original_filename", T.StringType()),
    T.StructField("collection", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("markdown_text", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("run_id", T.StringType(), False),
    T.StructField("attempt", T.StringType(), False),
])

CHUNKS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("document_id", T.StringType(), False),
    T.StructField("chunk_index", T.IntegerType(), False),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("heading", T.StringType()),
    T.StructField("content", T.StringType(), False),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("embed_error", T.StringType()),
    T.StructField("collection", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("metadata", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("run_id", T.StringType(), False),
    T.StructField("attempt", T.StringType(), False),
])

JOB_LOG = T.StructType([
    T.StructField("job_id", T.StringType(), False),
    T.StructField("document_id", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("at", T.TimestampType(), False),
    T.StructField("error_message", T.StringType()),
    T.StructField("run_id", T.StringType(), False),
    T.StructField("attempt", T.StringType(), False),
])

CITATION = T.StructType([
    T.StructField("n", T.IntegerType()),
    T.StructField("document_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("heading", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

STREAM_EVENT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("data", T.ArrayType(CITATION)),
    T.StructField("text", T.StringType()),
    T.StructField("message", T.StringType()),
])

PARSED_PAGE = T.StructType([
    T.StructField("document_id", T.StringType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("error", T.StringType()),
])
