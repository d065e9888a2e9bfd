"""Files that keep arriving: every file is checked once, accepted ones and refusals go to tables of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..functions.wording import basename
from ..operators.validate import upload_reason
from ..sources.files import mime_of

BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

ACCEPTED, REJECTED = "accepted", "rejected"
_FIELDS = ("path", "filename", "mime", "length", "modificationTime")


def arriving_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of files below ``path``; contents are read only by what asks for them."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
    files = reader.option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.withColumns({"filename": basename(F.col("path")), "mime": mime_of(F.col("path"))})


def stream_file_intake(
    files: DataFrame,
    root: str,
    cfg: EngineConfig,
    checkpoint: str,
    trigger: dict[str, object] | None = None,
    after: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Check every file of a stream; accepted rows with content go below ``accepted``, the others with their code below ``rejected``.

    A micro-batch writes one folder in each, named by its number and replaced as a whole, so a batch that is run again after a
    crash leaves no row twice. Content above the upload limit is never loaded: the limit is a filter of the stream itself, where
    the file source sees it; a micro-batch is given out as rows already read. ``after`` is called when both
    folders of a batch are written; ``accepted`` can itself be the source of ``stream_ingest``.
    """
    large = files.filter(F.col("length") > cfg.max_upload_bytes).drop("content").withColumn("content", F.lit(None).cast("binary"))
    files = files.filter(F.col("length") <= cfg.max_upload_bytes).unionByName(large)

    def take(batch: DataFrame, number: int) -> None:
        checked = batch.withColumn("reject_code", upload_reason(F.col("mime"), F.col("length"), cfg))
        good = checked.filter(F.col("reject_code").isNull() & (F.col("length") <= cfg.max_upload_bytes))
        good.select(*_FIELDS, "content").write.mode("overwrite").parquet(f"{root}/{ACCEPTED}/batch={number}")
        refused = checked.drop("content").filter(F.col("reject_code").isNotNull())
        refused.select(*_FIELDS, "reject_code").write.mode("overwrite").parquet(f"{root}/{REJECTED}/batch={number}")
        if after is not None:
            after(number)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def taken(spark: SparkSession, root: str, kind: str = ACCEPTED) -> DataFrame:
    """The rows of all micro-batches so far; empty before the first."""
    fields = [f for f in BINARY_FILE if f.name != "content"]
    names = {"filename": T.StringType(), "mime": T.StringType()}
    last = T.StructField("content", T.BinaryType()) if kind == ACCEPTED else T.StructField("reject_code", T.IntegerType())
    shape = T.StructType([*fields, *[T.StructField(n, t) for n, t in names.items()], last, T.StructField("batch", T.IntegerType())])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).option("basePath", f"{root}/{kind}").parquet(f"{root}/{kind}")
