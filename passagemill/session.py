"""Session helpers: shared scratch space and size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 4 * 1024 * 1024
SPARKS_BATCH = "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names, else one in its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/passagemill-steps"


def new_run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one; never reused, so a rerun is safe."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table that is read several times to the shared folder and read it back.

    It survives the loss of executors, and what made it is not computed again.
    """
    path = new_run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give heavy row-local work at least one partition per core.

    A table with fewer scan splits than cores is small (a split holds at most
    ``spark.sql.files.maxPartitionBytes``), often one file read by one task; it
    is dealt out by its unique keys. A larger table keeps its splits: no shuffle.
    ``df`` is a plain scan, so that counting its partitions only plans it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def small_batches(spark: SparkSession) -> None:
    """Texts reach Python workers in batches of at most ``BATCH_BYTES`` (one row at least), however many rows a task has.

    A worker holds a batch, its texts as Python objects and the results together. A session that sets
    ``spark.sql.execution.arrow.maxBytesPerBatch`` itself keeps its value.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == SPARKS_BATCH:
        spark.conf.set(key, BATCH_BYTES)


def is_bounded(df: DataFrame, limit_bytes: int) -> bool:
    """Measure a narrow table; true when its values fit in ``limit_bytes``."""
    width = F.lit(16)
    for name, kind in df.dtypes:
        value = F.col(name)
        if kind.startswith("array"):
            size = F.size(value) * 8
        elif kind == "string":
            size = F.octet_length(value)
        else:
            size = F.lit(8)
        width = width + F.coalesce(size, F.lit(0))
    total = df.agg(F.sum(width.cast("bigint")).alias("b")).first()["b"] or 0
    return total <= limit_bytes


def broadcast_if_bounded(df: DataFrame, limit_bytes: int) -> DataFrame:
    """Hint a broadcast only after its size has been measured.

    Beyond the limit the join is left to a shuffle, where adaptive execution
    splits skewed partitions.
    """
    return F.broadcast(df) if is_bounded(df, limit_bytes) else df
