"""Approximate search: chunks in cells, each question looks into the nearest cells.

Cells only decide which rows a question scores. Rows of a cell stay where the
scan finds them, so a crowded cell is read by many tasks. A *stored* index keeps its
centroids and its chunks, written in folders by cell: it is trained once, a search lists and
reads the probed cells alone, and new chunks are assigned and added without training again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..session import is_bounded, stored
from .search import SCOPES, Asked, QuestionBlock, best_rows_by_blocks, best_rows_of, rank_hits, visible_chunks, with_defaults


@dataclass(frozen=True)
class CellIndex:
    """Unit centroids; ``n_cells`` x ``dim`` numbers, small by construction."""

    centroids: np.ndarray

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """Row-wise: which cells are among the n nearest."""
        scores = vectors @ self.centroids.T
        n = min(n, scores.shape[1])
        top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        mask = np.zeros(scores.shape, dtype=bool)
        np.put_along_axis(mask, top, True, axis=1)
        return mask


def has_direction(column: str, width: int | None = None) -> Column:
    """Vectors a cosine exists for: components known and finite, not all zero, ``width`` of them if given."""
    vector = F.col(column)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good if width is None else good & (F.size(vector) == width), F.lit(False))


def train_cells(
    chunks: DataFrame, n_cells: int, seed: int = 42, max_iter: int = 10, fraction: float = 1.0, dim: int | None = None
) -> CellIndex:
    """Spherical k-means over chunk vectors; with ``dim`` those of another width are left out.

    ``fraction`` below 1 trains the centroids on a share of the rows; every row
    is still assigned to a cell and searched.
    """
    if fraction < 1.0:
        chunks = chunks.sample(fraction, seed)
    usable = chunks.filter(has_direction("embedding", dim))
    features = usable.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(features)
    centers = np.array(model.clusterCenters())
    lengths = np.linalg.norm(centers, axis=1, keepdims=True)
    return CellIndex(centers / np.where(lengths > 0, lengths, 1.0))


def assign_cells(chunks: DataFrame, index: CellIndex) -> DataFrame:
    """Add the nearest cell of every chunk; write partitioned by ``cell`` to prune scans.

    Chunks whose vector has no direction or another width are left out, as no search finds them.
    """

    @F.pandas_udf("int")
    def cell_of(vectors: pd.Series) -> pd.Series:
        matrix = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
        return pd.Series(np.argmax(matrix @ index.centroids.T, axis=1).astype(np.int32))

    usable = has_direction("embedding", index.centroids.shape[1])
    return chunks.filter(usable).withColumn("cell", cell_of("embedding"))


def ann_join(
    celled: DataFrame, questions: DataFrame, index: CellIndex, cfg: EngineConfig, probes: int
) -> DataFrame:
    """Like the exact join, but each question scores only its ``probes`` nearest cells.

    Questions beyond the broadcast limit meet the chunks in blocks, and a task still scores only
    the cells that a question probes; else cells that no question probes are not read. A question
    whose vector failed or has another width has no hits.
    """
    width = index.centroids.shape[1]
    asked = stored(
        with_defaults(questions, cfg).select(
            F.col("question_id").cast("string").alias("question_id"), "q_vec", "pool", "top_k", *SCOPES
        ),
        "questions",
    ).filter(has_direction("q_vec", width))
    names = ["document_id", "chunk_index", "embedding", "cell"]
    names += [n for n in ("collection", "user_id") if n in celled.columns]
    narrow = celled.select(*names).withColumn("chunk_index", F.col("chunk_index").cast("int"))
    for name in ("collection", "user_id"):
        if name not in names:
            narrow = narrow.withColumn(name, F.lit(None).cast("string"))

    size = Asked.of(asked)
    if size.held > cfg.broadcast_bytes or not is_bounded(asked, cfg.broadcast_bytes):

        @F.pandas_udf("array<int>")
        def cells_of(vectors: pd.Series) -> pd.Series:
            matrix = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
            return pd.Series([np.flatnonzero(row).astype(np.int32) for row in index.nearest(matrix, probes)])

        probing = asked.withColumn("cells", cells_of("q_vec"))
        return rank_hits(best_rows_by_blocks(narrow, probing, size, cfg, None), asked, cfg)

    rows = asked.toPandas()
    vectors = np.array([np.asarray(v, dtype=np.float64) for v in rows["q_vec"]]).reshape(len(rows), width)
    mask = index.nearest(vectors, probes)
    rows["cells"] = [np.flatnonzero(row).astype(np.int32) for row in mask]
    probed = [int(c) for c in np.flatnonzero(mask.any(axis=0))]
    block = celled.sparkSession.sparkContext.broadcast(vars(QuestionBlock.of(rows)))
    return rank_hits(best_rows_of(narrow.filter(F.col("cell").isin(probed)), block, None, cfg), asked, cfg)


STORED_COLUMNS = ("document_id", "chunk_index", "embedding", "collection", "user_id")


@dataclass(frozen=True)
class StoredCells:
    """An index in a folder: ``centroids`` (cell, center) and ``cells``, chunks partitioned by cell.

    The centroids are written last, so a folder without them is no index and a build that died is built again. An
    append writes new files only; a chunk added twice is found twice, so give every chunk once.
    """

    spark: SparkSession
    path: str

    def exists(self) -> bool:
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/centroids/_SUCCESS")
        return done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)

    def build(self, chunks: DataFrame, n_cells: int, **training: object) -> StoredCells:
        """Train on ``chunks`` and write them all; what was in the folder before goes."""
        index = train_cells(chunks, n_cells, **training)
        self._write(chunks, index, "overwrite")
        centers = [(k, c.tolist()) for k, c in enumerate(index.centroids)]
        self.spark.createDataFrame(centers, "cell int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        return self

    def append(self, chunks: DataFrame) -> None:
        """Add chunks to the cells that are there; nothing is trained or rewritten."""
        self._write(chunks, self.index(), "append")

    def _write(self, chunks: DataFrame, index: CellIndex, mode: str) -> None:
        known = [c if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in STORED_COLUMNS]
        # a crowded cell is shared out: what one task writes of a cell is bounded by the share
        rows = assign_cells(chunks.select(*known), index)
        share = F.pmod(F.xxhash64("document_id", "chunk_index"), F.lit(self.spark.sparkContext.defaultParallelism))
        rows.repartition("cell", share).write.mode(mode).partitionBy("cell").parquet(f"{self.path}/cells")

    def index(self) -> CellIndex:
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        return CellIndex(np.array([r["center"] for r in rows]))

    def celled(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def search(self, questions: DataFrame, cfg: EngineConfig, probes: int, documents: DataFrame | None = None) -> DataFrame:
        """The ``pool`` nearest chunks in the ``probes`` nearest cells of every question.

        With ``documents`` a chunk is visible if that registry has its document as completed, and takes its scope.
        """
        chunks = self.celled()
        if documents is not None:
            chunks = visible_chunks(chunks, documents, cfg, ["embedding", "cell"])
        return ann_join(chunks, questions, self.index(), cfg, probes)


def recall(approximate: DataFrame, exact: DataFrame) -> float:
    """Share of the exact pool that the approximate search also found."""
    keys = ["question_id", "document_id", "chunk_index"]
    found = exact.select(*keys).join(approximate.select(*keys).withColumn("hit", F.lit(1)), keys, "left")
    row = found.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0
