"""Tables that are joined by document again and again, laid out so that the joins move nothing.

Chunks, Markdown and registry rows are written into the same number of buckets by a hash of the
document. Spark then joins them bucket by bucket, without an exchange of either side; what joins
them from outside (pooled hits, deleted ids) moves alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

KEY = "document_id"


@dataclass(frozen=True)
class Colocated:
    """Bucketed tables of one catalog schema, all with the same number of buckets.

    Pick ``buckets`` so that one of the largest table fits a task (a few hundred MB); a table is rewritten as a whole.
    A document whose rows outgrow a bucket is read by one task, as in any layout by document.
    """

    spark: SparkSession
    schema: str
    path: str
    buckets: int

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Replace a table; rows without a document are in the bucket of null, and join nothing."""
        if self.buckets < 1:
            raise ValueError("buckets must be at least 1")
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {self.schema}")
        # dealt out as the buckets are, so a bucket is one file and need not be sorted again
        dealt = rows.repartition(self.buckets, KEY)
        writer = dealt.write.mode("overwrite").format("parquet").option("path", f"{self.path}/{name}")
        writer.bucketBy(self.buckets, KEY).sortBy(KEY).saveAsTable(f"{self.schema}.{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.schema}.{name}")

    def drop(self) -> None:
        """Forget the tables; their files stay, as those of any external table."""
        self.spark.sql(f"DROP SCHEMA IF EXISTS {self.schema} CASCADE")

    def join(self, left: str, right: str, how: str = "inner") -> DataFrame:
        """Two of the tables by document, bucket by bucket; hinted, as a broadcast would read one side as a whole."""
        return self.read(left).hint("merge").join(self.read(right), KEY, how)

    def rows_of(self, name: str, documents: DataFrame) -> DataFrame:
        """Rows of the named documents (distinct ids); only the ids are dealt out, to the buckets."""
        return self.read(name).hint("merge").join(documents.select(KEY).distinct().repartition(self.buckets, KEY), KEY, "left_semi")
