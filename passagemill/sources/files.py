"""File intake and registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.ids import stable_id
from ..functions.text import empty_to_null
from ..functions.wording import UNNAMED_FILE, basename, present

# Content types by file ending.
MIME_BY_ENDING = {"pdf": "application/pdf", "jpeg": "image/jpeg", "jpg": "image/jpeg", "png": "image/png"}


def mime_of(path: Column) -> Column:
    types = F.create_map(*[F.lit(x) for pair in MIME_BY_ENDING.items() for x in pair])
    ending = F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))
    return F.coalesce(F.try_element_at(types, ending), F.lit("application/octet-stream"))


def scan_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Files below ``path`` as rows: path, name, mime, length, modificationTime, content.

    With ``max_bytes`` larger files are rows too, but their content is not loaded and is null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_bytes is not None:
        large = files.filter(F.col("length") > max_bytes).drop("content").withColumn("content", F.lit(None).cast("binary"))
        files = files.filter(F.col("length") <= max_bytes).unionByName(large)
    return files.select(
        "path", basename(F.col("path")).alias("filename"), mime_of(F.col("path")).alias("mime"),
        "length", "modificationTime", "content",
    )


def store_path(cfg: EngineConfig, document_id: Column, filename: Column) -> Column:
    """Where the original is kept: only the base name enters the path."""
    return F.concat(F.lit(f"{cfg.storage_root}/originals/"), document_id, F.lit("__"), basename(filename))


def register(files: DataFrame, cfg: EngineConfig, key: Column | None, created_at: Column) -> DataFrame:
    """Registry rows for accepted files.

    ``files`` has filename, mime and optional user_id and collection. The id is
    a hash of ``key``, so registering the same upload twice gives the same row;
    without a key it is the column document_id.
    The raw content type and the full file name are kept.
    """
    name = F.when(present(F.col("filename")), F.col("filename")).otherwise(F.lit(UNNAMED_FILE))
    document_id = F.col("document_id") if key is None else stable_id(key)
    rows = files.withColumn("document_id", document_id).withColumn("original_filename", name)

    def optional(column: str) -> Column:
        return empty_to_null(F.col(column)) if column in files.columns else F.lit(None).cast("string")

    return rows.select(
        "document_id",
        "original_filename",
        F.col("mime").alias("file_type"),
        store_path(cfg, F.col("document_id"), F.col("original_filename")).alias("storage_path"),
        F.lit(None).cast("string").alias("markdown_storage_path"),
        F.lit("uploaded").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        optional("user_id").alias("user_id"),
        optional("collection").alias("collection"),
        F.lit("{}").alias("metadata"),
        F.lit(None).cast("string").alias("active_run_id"),
        created_at.alias("created_at"),
        created_at.alias("updated_at"),
    )
