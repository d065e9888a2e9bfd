"""Exact nearest chunks for one question or a table of questions.

Chunks are never shuffled for the search: every task scores its own Arrow
batches against the questions with matrix products and keeps only the best
rows per question, so what leaves a task is bounded by questions x pool.
Questions are held by each task only after their size and that of their pools has
been measured; a larger table is searched block by block instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..session import broadcast_if_bounded, is_bounded, stored

SCOPES = ("document_id", "collection", "user_id")
# Scores are ranked at this precision: the last bits of a matrix product depend
# on how rows were batched, and ties must fall the same way on every run.
SCORE_DIGITS = 9

HIT_FIELDS = "question_id string, document_id string, chunk_index int, score double"


def scope_filter(
    documents: DataFrame,
    document_id: str | None = None,
    collection: str | None = None,
    user_id: str | None = None,
) -> DataFrame:
    """Completed documents inside the given scope; empty or null means no filter."""
    kept = documents.filter(F.col("status") == "completed")
    for name, wanted in zip(SCOPES, (document_id, collection, user_id)):
        if wanted:
            kept = kept.filter(F.col(name) == wanted)
    return kept


def list_filter(documents: DataFrame, collection: str | None = None, user_id: str | None = None) -> DataFrame:
    for name, wanted in (("collection", collection), ("user_id", user_id)):
        if wanted:
            documents = documents.filter(F.col(name) == wanted)
    return documents


def visible_chunks(chunks: DataFrame, documents: DataFrame, cfg: EngineConfig, columns: Iterable[str]) -> DataFrame:
    """Chunks of completed documents with the documents' scope columns.

    A chunk is visible if the registry has its document as completed, and the
    scope is the registry's. This is one inner join at every size: a registry cut
    to these columns that measures small is broadcast, else both sides meet by
    document and adaptive execution splits a document that holds many chunks.
    """
    wanted = ["document_id", "chunk_index", "collection", "user_id", *columns]
    scope = documents.filter(F.col("status") == "completed").select("document_id", "collection", "user_id")
    scope = broadcast_if_bounded(scope, cfg.broadcast_bytes)
    return chunks.drop("collection", "user_id").join(scope, "document_id").select(*wanted)


def with_defaults(questions: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Per-question ``top_k`` and ``pool``; scope columns with '' made null."""
    out = questions
    for name in SCOPES:
        column = F.nullif(F.col(name), F.lit("")) if name in questions.columns else F.lit(None).cast("string")
        out = out.withColumn(name, column)
    asked = F.col("top_k").cast("int") if "top_k" in questions.columns else F.lit(None).cast("int")
    out = out.withColumn("top_k", F.coalesce(F.nullif(asked, F.lit(0)), F.lit(cfg.top_k)))
    pool = F.greatest(F.col("top_k"), F.lit(cfg.pool_size)) if cfg.rerank else F.col("top_k")
    return out.withColumn("pool", pool)


@dataclass
class QuestionBlock:
    """Unit question vectors with their scopes and pools, as plain arrays.

    Broadcast as a dict of its arrays: broadcast values are pickled by name, and
    executors have no copy of the package.
    """

    ids: np.ndarray
    vectors: np.ndarray
    pools: np.ndarray
    scopes: dict[str, np.ndarray]
    # The cells that each question probes, as many for every one.
    cells: np.ndarray | None = None

    @classmethod
    def of(cls, rows: pd.DataFrame) -> QuestionBlock:
        """Questions without a vector, or with one of another width than most, are left out."""
        width = common_width([len(v) for v in rows["q_vec"] if v is not None])
        rows = rows[np.array([v is not None and len(v) == width for v in rows["q_vec"]], dtype=bool)]
        vectors = np.array([np.asarray(v, dtype=np.float64) for v in rows["q_vec"]]).reshape(len(rows), width)
        lengths = np.linalg.norm(vectors, axis=1)
        usable = np.isfinite(lengths) & (lengths > 0)
        kept = rows[usable]
        return cls(
            ids=kept["question_id"].to_numpy(dtype=object),
            vectors=vectors[usable] / lengths[usable, None],
            pools=kept["pool"].to_numpy(dtype=np.int64),
            scopes={name: kept[name].to_numpy(dtype=object) for name in SCOPES if kept[name].notna().any()},
            cells=np.array(list(kept["cells"]), dtype=np.int32) if "cells" in kept else None,
        )


def common_width(widths: list[int]) -> int:
    """The most frequent positive length, the larger of equally frequent ones; 0 without any."""
    found = [w for w in widths if w]
    return max(set(found), key=lambda w: (found.count(w), w)) if found else 0


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float64 matrix) of the vectors of ``width`` numbers of a list column."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    if len(rows) < len(column):
        column = column.filter(fits)
    if not len(rows):
        return rows, np.empty((0, width))
    values = column.flatten().to_numpy(zero_copy_only=False)
    return rows, values.reshape(len(rows), -1).astype(np.float64)


class BestRows:
    """The running best rows per question over the batches of one task.

    A product in single precision finds the rows that can reach a question's floor, with a margin above
    its largest error; only those are scored in double precision. They wait until there are as many as the
    best rows, then both are cut together, so the floors rise after every doubling of the rows seen.
    """

    # Questions and rows of one product.
    TILE = 1024
    # Numbers held at once where single rows are scored.
    CELLS = 4_000_000
    # Rows that wait at least before they are cut.
    WAIT = 100_000

    def __init__(self, block: QuestionBlock, min_score: float | None, rows_at_once: int = TILE):
        self.block = block
        self.step = max(1, min(self.TILE, rows_at_once))
        self.floor = np.full(len(block.ids), -np.inf if min_score is None else min_score)
        self.narrow = block.vectors.astype(np.float32)
        self.margin = 2 * (block.vectors.shape[1] + 8) * 2.0**-23
        self.wanted = {}
        for name, wanted in block.scopes.items():
            levels = pd.Index(pd.unique(wanted[pd.notna(wanted)]))
            self.wanted[name] = (levels, np.where(pd.notna(wanted), levels.get_indexer(wanted), -1).astype(np.int32))
        self.probing: dict[int, np.ndarray] = {}
        self.room = np.empty(min(len(block.ids), self.TILE) * self.step, np.float32)
        self.best = (np.empty(0, np.int64), np.empty(0), np.empty(0, object), np.empty(0, np.int32))
        self.waiting: list[tuple] = []
        self.n_waiting = 0

    def add(self, batch: pa.RecordBatch) -> None:
        if not len(self.block.ids):
            return
        for at in range(0, batch.num_rows, self.step):
            self._add_rows(batch.slice(at, self.step))

    def _add_rows(self, batch: pa.RecordBatch) -> None:
        rows, matrix = _matrix(batch.column("embedding"), self.block.vectors.shape[1])
        lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        usable = np.isfinite(lengths) & (lengths > 0)
        if not usable.all():
            rows, matrix, lengths = rows[usable], matrix[usable], lengths[usable]
        if not len(rows):
            return
        table = batch.select(["document_id", "chunk_index", *(n for n in self.wanted if n != "document_id")])
        if len(rows) < batch.num_rows:
            table = table.take(pa.array(rows))
        matrix /= lengths[:, None]
        keys = (table.column("document_id").to_numpy(zero_copy_only=False), table.column("chunk_index").to_numpy(zero_copy_only=False))
        have = {
            name: levels.get_indexer(table.column(name).to_numpy(zero_copy_only=False)).astype(np.int32)
            for name, (levels, _) in self.wanted.items()
        }
        if self.block.cells is None:
            self._add_cell(np.arange(len(self.block.ids)), matrix, keys, have)
            return
        cells = batch.column("cell").to_numpy(zero_copy_only=False)[rows]
        for cell in np.unique(cells):
            own = np.flatnonzero(cells == cell)
            self._add_cell(self._probing(int(cell)), matrix[own], tuple(k[own] for k in keys), {n: h[own] for n, h in have.items()})

    def _probing(self, cell: int) -> np.ndarray:
        if cell not in self.probing:
            self.probing[cell] = np.flatnonzero((self.block.cells == cell).any(axis=1))
        return self.probing[cell]

    def _add_cell(self, asked: np.ndarray, matrix: np.ndarray, keys: tuple, have: dict[str, np.ndarray]) -> None:
        small = np.ascontiguousarray(matrix.T, dtype=np.float32)
        for at in range(0, len(asked), self.TILE):
            self._score(asked[at : at + self.TILE], matrix, small, keys, have)
            if self.n_waiting >= max(self.WAIT, len(self.best[0])):
                self._cut()

    def _score(self, asked: np.ndarray, matrix: np.ndarray, small: np.ndarray, keys: tuple, have: dict[str, np.ndarray]) -> None:
        n = small.shape[1]
        near = np.matmul(self.narrow[asked], small, out=self.room[: len(asked) * n].reshape(len(asked), n))
        floor = self.floor[asked]
        # a question without a full pool has no floor yet: its scope cuts first, then the best of these rows
        open_ = np.flatnonzero(floor == -np.inf)
        if len(open_):
            part = near[open_]
            for name, (_, ask) in self.wanted.items():
                mine = ask[asked[open_]][:, None]
                part[(mine != -1) & (mine != have[name])] = -np.inf
            near[open_] = part
            k = int(self.block.pools[asked[open_]].max())
            if n > k:
                floor[open_] = np.partition(part, n - k, axis=1)[:, n - k]
        least = (floor - self.margin).astype(np.float32)
        some = np.flatnonzero(near.max(axis=1) >= least)
        part = near[some]
        at = np.flatnonzero(part >= least[some, None])
        q, r = np.divmod(at[part.ravel()[at] > -np.inf], n)
        q = asked[some[q]]
        for name, (_, ask) in self.wanted.items():
            inside = (ask[q] == -1) | (ask[q] == have[name][r])
            q, r = q[inside], r[inside]
        step = max(1, self.CELLS // matrix.shape[1])
        for at in range(0, len(q), step):
            self._wait(q[at : at + step], r[at : at + step], matrix, keys)

    def _wait(self, q: np.ndarray, r: np.ndarray, matrix: np.ndarray, keys: tuple) -> None:
        scores = np.round(np.einsum("ij,ij->i", self.block.vectors[q], matrix[r]), SCORE_DIGITS)
        kept = scores >= self.floor[q]
        q, r = q[kept], r[kept]
        self.waiting.append((q, scores[kept], keys[0][r], keys[1][r].astype(np.int32)))
        self.n_waiting += len(q)

    def _cut(self) -> None:
        """The best rows among those kept and those waiting; equal scores by document, then chunk."""
        q, score, document, chunk = (np.concatenate(c) for c in zip(self.best, *self.waiting))
        self.waiting, self.n_waiting = [], 0
        if not len(q):
            return
        order = np.lexsort((-score, q))
        same = (q[order][1:] == q[order][:-1]) & (score[order][1:] == score[order][:-1])
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if len(tied):
            own = order[tied]
            names = pd.factorize(document[own], sort=True)[0]
            order[tied] = own[np.lexsort((chunk[own], names, -score[own], q[own]))]
        sizes = np.bincount(q, minlength=len(self.floor))
        first = np.cumsum(sizes) - sizes
        order = order[np.arange(len(order)) - first[q[order]] < self.block.pools[q[order]]]
        self.best = (q[order], score[order], document[order], chunk[order])
        full = np.flatnonzero(sizes >= self.block.pools)
        last = np.searchsorted(self.best[0], full, side="right") - 1
        self.floor[full] = self.best[1][last]

    def batches(self) -> Iterator[pa.RecordBatch]:
        self._cut()
        for at in range(0, len(self.best[0]), 50_000):
            q, score, document, chunk = (c[at : at + 50_000] for c in self.best)
            found = [pa.array(self.block.ids[q], pa.string()), pa.array(document, pa.string()), pa.array(chunk), pa.array(score)]
            yield pa.RecordBatch.from_arrays(found, ["question_id", "document_id", "chunk_index", "score"])


def best_rows_of(chunks: DataFrame, block: Broadcast, min_score: float | None, cfg: EngineConfig) -> DataFrame:
    """Scan chunks once; every task returns its best rows per question.

    The rows that leave the scan are tasks x questions x pool. ``cfg.scan_tasks``
    groups the splits of a very large scan into that many tasks (no shuffle); a
    longer task also raises its own floor sooner.
    """
    if cfg.scan_tasks:
        chunks = chunks.coalesce(cfg.scan_tasks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestRows(QuestionBlock(**block.value), min_score)
        for batch in batches:
            best.add(batch)
        yield from best.batches()

    return chunks.mapInArrow(scan, HIT_FIELDS)


@dataclass(frozen=True)
class Asked:
    """What a table of questions takes: rows, numbers of a vector, the widest pool."""

    rows: int
    width: int
    pool: int

    # Bytes that a task may hold of a block of questions, however small the broadcast limit is.
    TASK_BYTES = 64 * 1024 * 1024
    # A pooled row in a task, and the same row when it moves.
    POOLED, MOVED = 32, 40

    @classmethod
    def of(cls, asked: DataFrame) -> Asked:
        row = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q_vec")).alias("w"), F.max("pool").alias("p")).first()
        return cls(row["n"], max(row["w"] or 1, 1), max(row["p"] or 1, 1))

    @property
    def held(self) -> int:
        """Bytes of all questions in a task: vectors and the pools that it fills."""
        return self.rows * (8 * self.width + self.POOLED * self.pool + 64)

    def grid(self, chunks: int, tasks: int) -> tuple[int, int]:
        """Blocks of questions and parts of chunks: what moves least, with a task for every core and no block above its bytes."""
        least = max(1, -(-self.held // self.TASK_BYTES))
        a_question, a_chunk = 8 * self.width + self.MOVED * self.pool, 4 * self.width + 64

        def moved(blocks: int) -> int:
            return chunks * blocks * a_chunk + self.rows * -(-tasks // blocks) * a_question

        blocks = min(range(least, max(least, tasks) + 1), key=moved)
        return blocks, -(-tasks // blocks)


def best_rows_by_blocks(chunks: DataFrame, asked: DataFrame, size: Asked, cfg: EngineConfig, min_score: float | None) -> DataFrame:
    """Search for any number of questions: every block of questions meets every part of the chunks in a task.

    Rows are dealt out by a hash of their unique keys. A task reads its questions first and holds them; the
    chunks pass by. So memory is bounded by the block, and there are only as many blocks as that and the cores
    ask for: what moves grows with the tables, not with their product.
    """
    spark = chunks.sparkSession
    blocks, parts = size.grid(chunks.count(), spark.sparkContext.defaultParallelism)
    rows_at_once = cfg.chunk_block_bytes // (4 * size.width)

    def all_of(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    q_side = asked.drop("top_k").withColumns({"_side": F.lit(0), "_q": F.pmod(F.xxhash64("question_id"), F.lit(blocks)).cast("int")})
    c_side = chunks.withColumns({"_side": F.lit(1), "_c": F.pmod(F.xxhash64("document_id", "chunk_index"), F.lit(parts)).cast("int")})
    both = q_side.withColumn("_c", all_of(parts)).unionByName(c_side.withColumn("_q", all_of(blocks)), allowMissingColumns=True)
    order = ["_side", "cell"] if "cell" in both.columns else ["_side"]
    dealt = both.repartitionById(blocks * parts, F.col("_q") * parts + F.col("_c")).sortWithinPartitions(*order)
    of_question = [c for c in q_side.columns if not c.startswith("_")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best = [], None
        for batch in batches:
            n = int(np.searchsorted(batch.column("_side").to_numpy(), 1))
            if n:
                held.append(batch.slice(0, n).select(of_question))
            if n == batch.num_rows:
                continue
            if best is None:
                if not held:
                    return
                best = BestRows(QuestionBlock.of(pa.Table.from_batches(held).to_pandas()), min_score, rows_at_once)
                held = []
            best.add(batch.slice(n))
        if best is not None:
            yield from best.batches()

    return dealt.mapInArrow(search, HIT_FIELDS)


def rank_hits(hits: DataFrame, questions: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Merge the tasks' best rows into one ranked pool per question.

    Every task may send a whole pool of a question, so its rows are cut in ``cfg.merge_parts``
    parts by a hash of their keys first; what the parts keep is ranked together. One task then holds
    tasks x pool / parts rows of a question, and after that parts x pool.
    """
    best_first = [F.col("score").desc(), F.col("document_id"), F.col("chunk_index")]
    widest = questions.agg(F.max("pool").alias("p")).first()["p"] or 0
    part = F.pmod(F.xxhash64("document_id", "chunk_index"), F.lit(cfg.merge_parts))
    in_part = Window.partitionBy("question_id", "_part").orderBy(*best_first)
    cut = hits.withColumn("_part", part).withColumn("_place", F.row_number().over(in_part)).filter(F.col("_place") <= widest)
    order = Window.partitionBy("question_id").orderBy(*best_first)
    ranked = cut.drop("_part", "_place").withColumn("ann_rank", F.row_number().over(order)).filter(F.col("ann_rank") <= widest)
    limits = broadcast_if_bounded(questions.select("question_id", "pool", "top_k"), cfg.broadcast_bytes)
    return ranked.join(limits, "question_id").filter(F.col("ann_rank") <= F.col("pool"))


def knn_join(chunks: DataFrame, questions: DataFrame, cfg: EngineConfig, min_score: float | None = None) -> DataFrame:
    """The ``pool`` nearest chunks of every question, exact.

    ``chunks``: document_id, chunk_index, embedding and, for scoped questions,
    collection and user_id. ``questions``: question_id, q_vec and optional
    scopes and top_k. Equal scores are ordered by document, then chunk. With
    ``min_score`` weaker rows never leave a task; as rank and gate follow the
    same score, this equals gating after the limit.
    """
    # Question vectors often come from a model: compute them once.
    asked = stored(
        with_defaults(questions, cfg).select(
            F.col("question_id").cast("string").alias("question_id"), "q_vec", "pool", "top_k", *SCOPES
        ),
        "questions",
    )
    # A failed embedding has no vector: its question has no hits, the others are not touched.
    usual = asked.filter(F.size("q_vec") > 0).groupBy(F.size("q_vec").alias("w")).count().orderBy(F.desc("count"), F.desc("w"))
    width = usual.first()
    asked = asked.filter(F.size("q_vec") == (width["w"] if width else 0))
    names = ["document_id", "chunk_index", "embedding"]
    names += [n for n in ("collection", "user_id") if n in chunks.columns]
    narrow = chunks.select(*names).withColumn("chunk_index", F.col("chunk_index").cast("int"))
    for name in ("collection", "user_id"):
        if name not in names:
            narrow = narrow.withColumn(name, F.lit(None).cast("string"))
    size = Asked.of(asked)
    if size.held <= cfg.broadcast_bytes and is_bounded(asked, cfg.broadcast_bytes):
        block = chunks.sparkSession.sparkContext.broadcast(vars(QuestionBlock.of(asked.toPandas())))
        hits = best_rows_of(narrow, block, min_score, cfg)
    else:
        hits = best_rows_by_blocks(narrow, asked, size, cfg, min_score)
    return rank_hits(hits, asked, cfg)


def knn_topk(chunks: DataFrame, vector: list[float], k: int, cfg: EngineConfig) -> DataFrame:
    """One question: a scan and a top-k, without any shuffle of chunks."""
    spark = chunks.sparkSession
    one = spark.range(1).select(
        F.lit("q").alias("question_id"),
        F.array(*[F.lit(float(x)) for x in vector]).alias("q_vec"),
        F.lit(k).alias("pool"),
        F.lit(k).alias("top_k"),
        *[F.lit(None).cast("string").alias(n) for n in SCOPES],
    )
    narrow = chunks.select("document_id", F.col("chunk_index").cast("int").alias("chunk_index"), "embedding")
    block = spark.sparkContext.broadcast(vars(QuestionBlock.of(one.toPandas())))
    best = best_rows_of(narrow, block, None, cfg)
    return best.drop("question_id").orderBy(F.col("score").desc(), "document_id", "chunk_index").limit(k)


def score_gate(rows: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Keep rows whose cosine reaches the gate; a NaN never does."""
    return rows.filter((F.col("score") >= cfg.min_score) & ~F.isnan("score"))

