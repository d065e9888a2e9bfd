"""SimHash near-duplicates: fingerprints, tiled exact comparison, classes.

Fingerprints are compared exactly. Distinct ones are put into cells by the bit counts
of their upper and lower half; two fingerprints within the radius lie in cells whose
counts differ by at most the radius, so all other pairs of cells are skipped. Cells are
cut into tiles of bounded size; each tile meets its own rows, the other tiles of
its cell and the cells near it, streamed past it. Inside, blocks of rows whose
bit counts per byte differ beyond the radius are skipped, and the rest is compared by
exclusive-or and bit counts. A tile gives the links that connect what it found, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.components import components
from passagemill.llm.shared import id_text, stored

SEED = 42
TILE_ROWS = 1 << 15
_SIDE = 128  # rows of a compared block
_SLICE = 1 << 15  # shingles whose bits are unpacked at once


def fingerprint_of(text: str | None, words: int = 4) -> int:
    """Bitwise majority of the hashes of a text's shingles (repeats count); 0 without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[: -words]])
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    n = len(starts)
    for k in range(0, n, _SLICE):
        pairs = zip(starts[k : k + _SLICE].tolist(), (ends[words - 1 :][k : k + _SLICE] - 1).tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) per row of ``docs`` (doc_id, text); fp is the fingerprint as a signed long.

    A null or blank text has fingerprint 0. Rows are kept as they are, repeats included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint_of(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _byte_counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint8).reshape(-1, 8)).astype(np.int16)


def _ordered(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints sorted by bit counts, finer and finer; smallest and largest counts of each block."""
    counts = _byte_counts(fps)
    quarters = counts[:, ::2] + counts[:, 1::2]
    fps = fps[np.lexsort((counts[:, 6], counts[:, 4], counts[:, 2], counts[:, 0], quarters[:, 2], quarters[:, 0]))]
    counts, at = _byte_counts(fps), np.arange(0, len(fps), _SIDE)
    return fps, np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)


class _Tile:
    """A tile's rows; links them with each other and with rows that stream past."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.low, self.high = _ordered(fps)
        self.radius = radius
        self.label = np.arange(len(self.fps))
        self.links: list[np.ndarray] = []
        self.meet(self.fps)

    def _merge(self, labels: np.ndarray) -> int:
        """Make several labels one; a link keeps each of the others."""
        keep = labels[0]
        for other in labels[1:]:
            self.links.append(np.array([[self.fps[keep], self.fps[other]]], np.uint64))
            self.label[self.label == other] = keep
        return keep

    def meet(self, rows: np.ndarray) -> None:
        rows, low, high = _ordered(rows)
        apart = np.zeros((len(low), len(self.low)), np.int16)
        for k in range(8):
            gap = np.maximum(low[:, k, None] - self.high[None, :, k], self.low[None, :, k] - high[:, k, None])
            apart += np.maximum(gap, 0)
        found = np.full(len(rows), -1)
        for i, js in enumerate(apart <= self.radius):
            js = np.flatnonzero(js)
            a = rows[i * _SIDE : (i + 1) * _SIDE, None]
            for k in range(0, len(js), 16):
                own = (js[k : k + 16, None] * _SIDE + np.arange(_SIDE)).ravel()
                own = own[own < len(self.fps)]
                near = np.bitwise_count(a ^ self.fps[None, own]) <= self.radius
                hit = np.flatnonzero(near.any(axis=1))
                if len(hit):
                    self._link(near[hit], own, found, hit + i * _SIDE)
        seen = np.flatnonzero(found >= 0)
        if len(seen):
            pairs = np.stack([rows[seen], self.fps[self.label[found[seen]]]], axis=1)
            self.links.append(pairs[pairs[:, 0] != pairs[:, 1]])

    def _link(self, near: np.ndarray, own: np.ndarray, found: np.ndarray, at: np.ndarray) -> None:
        """``found`` holds some row of the tile each streamed row is linked with."""
        labels = self.label[own]
        least = np.where(near, labels, len(self.label)).min(axis=1)
        most = np.where(near, labels, -1).max(axis=1)
        had = found[at]
        known = np.where(had >= 0, self.label[had], least)
        for r in np.flatnonzero((least != most) | (known != least)):
            now = np.unique(self.label[own[near[r]]])
            if had[r] >= 0:
                now = np.unique(np.append(now, self.label[had[r]]))
            if len(now) > 1:
                self._merge(now)
        found[at] = np.where(had >= 0, had, least)

    def taken(self) -> np.ndarray:
        out = np.concatenate(self.links) if self.links else np.zeros((0, 2), np.uint64)
        self.links = []
        return out


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, tile = None, [], None

        def out(t: _Tile) -> pa.RecordBatch:
            pairs = t.taken().view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            cell, no, guest, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            if not len(cell):
                continue
            turn = np.flatnonzero((np.diff(cell) != 0) | (np.diff(no) != 0) | (np.diff(guest) != 0)) + 1
            for a, b in zip([0, *turn], [*turn, len(cell)]):
                here = (cell[a], no[a])
                if here != key:
                    if home:
                        yield out(_Tile(np.concatenate(home), radius))
                    elif tile:
                        yield out(tile)
                    key, home, tile = here, [], None
                rows = fp[a:b].astype(np.int64).view(np.uint64)
                if not guest[a]:
                    home.append(rows)
                elif home or tile:
                    if home:
                        tile, home = _Tile(np.concatenate(home), radius), []
                    tile.meet(rows)
        if home:
            yield out(_Tile(np.concatenate(home), radius))
        elif tile:
            yield out(tile)

    return run


def near_links(distinct: DataFrame, radius: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (fp long, distinct) within ``radius`` bits.

    The cells number at most 33 x 33, so their sizes are a bounded table.
    """
    spark = distinct.sparkSession
    high = F.bit_count(F.shiftrightunsigned("fp", 32))
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    placed = distinct.select("fp", (high * 64 + low).cast("int").alias("cell"))
    tiles = {r["cell"]: -(-r["n"] // tile_rows) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}

    def near(a: int, b: int) -> bool:
        return abs(a // 64 - b // 64) + abs(a % 64 - b % 64) <= radius

    meets = [(a, b, n) for a in tiles for b, n in tiles.items() if a <= b and near(a, b)]
    plan = spark.createDataFrame(meets, "cell int, other int, tiles int")
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    own = F.broadcast(plan.where("cell = other").select("cell", "tiles"))
    homes = placed.join(own, "cell").select("cell", tile.alias("tile"), F.lit(0).alias("guest"), "fp")
    guests = (
        placed.join(F.broadcast(plan), "cell")
        .select("cell", "other", "tiles", "fp", tile.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
        .where("cell <> other or tile > mine")
        .select(F.col("other").alias("cell"), "tile", F.lit(1).alias("guest"), "fp")
    )
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(tiles.values()) // 4)
    dealt = homes.unionByName(guests).repartition(n, "cell", "tile").sortWithinPartitions("cell", "tile", "guest")
    return dealt.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id.

    Rows whose fingerprints differ by at most ``radius`` bits are linked; a class is all
    that links reach, named by its smallest doc_id. Blank and null texts share fingerprint 0,
    which links like any other. A null doc_id keeps its row and never names a class unless the
    whole class has none (then component_id is null). Repeated rows give repeated rows; an empty table
    gives an empty one; other columns are not read.
    """
    fps = stored(fingerprints(id_text(docs, id_col, text_col), words), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = near_links(nodes.select("fp"), radius)
    labels = components(links)
    named = nodes.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = named.join(least, "label").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their class; every other column stays.

    Of a class without any doc_id all rows stay; equal rows of a kept doc_id all stay.
    """
    near = near_duplicates(docs, words, radius)
    gone = near.where("doc_id is null and component_id is not null or doc_id <> component_id").select(
        F.col("doc_id").alias("__gone")
    )
    return docs.join(gone.distinct(), docs["doc_id"].cast("long").eqNullSafe(F.col("__gone")), "left_anti")
