"""Stored tables: every execution of a run writes its own folders, readers see the newest.

Parquet has no transactions, so nothing is updated in place. Each execution of a run is an
*attempt* with a number of its own, taken when it starts; its rows lie below
``attempt=<number>`` in every table. The registry rows of an attempt come in steps (uploaded,
processing, finished, or a tombstone), and a document's newest row, by attempt and step,
names the attempt that holds its chunks. An attempt that died half-way has no finished
rows, so nothing points to what it wrote; run again, it is another attempt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EngineConfig
from ..schemas import CHUNKS, DOCUMENTS, JOB_LOG, MARKDOWN, ORIGINALS
from ..session import broadcast_if_bounded

SCHEMAS = {"documents": DOCUMENTS, "originals": ORIGINALS, "markdown": MARKDOWN, "chunks": CHUNKS, "jobs": JOB_LOG}
UPLOADED, PROCESSING, FINISHED = 0, 1, 2


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    root: str

    def create_if_missing(self) -> Tables:
        """Empty tables, written once; harmless when they exist."""
        for name, schema in SCHEMAS.items():
            empty = self.spark.createDataFrame([], T.StructType([f for f in schema if f.name != "attempt"]))
            empty.write.mode("ignore").parquet(f"{self.root}/{name}/attempt=none")
        return self

    def _path(self, folder: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def begin(self) -> str:
        """The number of a new attempt, above all before it.

        Numbers are empty files; creating one fails if another run has just taken it.
        """
        fs, folder = self._path("attempts")
        fs.mkdirs(folder)
        number = max((int(f.getPath().getName()) for f in fs.listStatus(folder)), default=0) + 1
        while not fs.createNewFile(self._path(f"attempts/{number:012d}")[1]):
            number += 1
        return f"{number:012d}"

    def folder(self, name: str, attempt: str) -> str:
        return f"{self.root}/{name}/attempt={attempt}"

    def write(self, name: str, attempt: str, run_id: str, rows: DataFrame) -> None:
        """Add rows to an attempt; columns of the table that ``rows`` lacks are null."""
        fields = [f for f in SCHEMAS[name] if f.name not in ("attempt", "run_id")]
        known = set(rows.columns)
        columns = [F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        rows.select(*columns, F.lit(run_id).alias("run_id")).write.mode("append").parquet(self.folder(name, attempt))

    def copy(self, name: str, attempt: str, rows: DataFrame) -> None:
        """Add rows of the same table, which keep the run they come from."""
        columns = [f.name for f in SCHEMAS[name] if f.name != "attempt"]
        rows.select(*columns).write.mode("append").parquet(self.folder(name, attempt))

    def attempts(self, name: str) -> list[str]:
        """Attempts that have a folder in a table, oldest first; the empty one of ``create_if_missing`` is none."""
        fs, path = self._path(name)
        found = (f.getPath().getName().partition("=") for f in fs.listStatus(path))
        return sorted(number for key, _, number in found if key == "attempt" and number != "none")

    def remove(self, name: str, attempt: str) -> None:
        fs, path = self._path(f"{name}/attempt={attempt}")
        fs.delete(path, True)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def read_attempt(self, name: str, attempt: str) -> DataFrame:
        """Rows of one attempt; only its folder is listed."""
        reader = self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.root}/{name}")
        return reader.parquet(self.folder(name, attempt))

    def newest(self) -> DataFrame:
        """The newest registry row of every document, tombstones included."""
        fields = [f.name for f in DOCUMENTS if f.name != "document_id"]
        newest = F.max_by(F.struct(*fields), F.struct("attempt", "step")).alias("d")
        return self.read("documents").groupBy("document_id").agg(newest).select("document_id", "d.*")

    def documents(self) -> DataFrame:
        """The registry: the newest row of every document that has not been deleted."""
        rows = self.newest().filter(~F.coalesce("deleted", F.lit(False)))
        return rows.drop("step", "deleted", "run_id", "attempt")

    def held(self, name: str, documents: DataFrame, pointer: str, cfg: EngineConfig) -> DataFrame:
        """Rows of a table in the attempts that ``pointer`` of the registry rows names.

        The narrow (document, attempt) pairs are broadcast where they measure small.
        """
        pairs = documents.filter(F.col(pointer).isNotNull()).select("document_id", F.col(pointer).alias("attempt"))
        return self.read(name).join(broadcast_if_bounded(pairs, cfg.broadcast_bytes), ["document_id", "attempt"])

    def visible_chunks(self, cfg: EngineConfig) -> DataFrame:
        """Chunks of the active attempt of completed documents, by one rule at every size.

        An attempt that died half-way, a replaced one, and a document that was deleted or
        has no registry row have no such pair.
        """
        done = self.documents().filter(F.col("status") == "completed")
        return self.held("chunks", done, "active_attempt", cfg).drop("attempt")
