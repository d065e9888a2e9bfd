"""Helpers of this subpackage: tables, blocks of documents, packed key exchange, written steps.

A *block* is a set of rows given by a hash of their id, so each pass over the
documents finds the same rows together. A block's sorted distinct 64-bit keys are
cut at fixed hash ranges (*buckets*) and travel as packed arrays: one row per block
and bucket instead of one per key. What a bucket finds out goes back to the blocks
in the order of the keys, so the keys need not travel twice. With ever more blocks
and buckets the arrays shrink and the exchange becomes an ordinary shuffle of keys.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.session import stored

BLOCK_BYTES = 16 << 20
BUCKET_KEYS = 1 << 20
MIN_BLOCKS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0


def sizes(n_bytes: int, keys_per_byte: float = 0.16) -> tuple[int, int]:
    """Blocks of about BLOCK_BYTES of text; the power of two of buckets of about BUCKET_KEYS keys."""
    blocks = max(MIN_BLOCKS, -(-n_bytes // BLOCK_BYTES))
    bits = max(6, int(np.ceil(np.log2(max(1, n_bytes * keys_per_byte / BUCKET_KEYS)))))
    return int(blocks), int(bits)


def in_blocks(docs: DataFrame, blocks: int, *ids: str) -> DataFrame:
    return docs.withColumn("block", F.pmod(F.xxhash64(*(ids or ("doc_id",))), F.lit(blocks)).cast("int"))


def cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Positions at which sorted keys pass from one bucket (their highest bits) to the next."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def finished(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps whose results are written and whose frames are gone.

    Spark's cleaner works when the driver's garbage is collected, which can take half an hour by itself. The
    session holds on to the query run last, so an empty one takes its place before.
    """
    spark.range(0).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_stored(df: DataFrame) -> None:
    """Remove a table that ``stored`` wrote, once nothing will read it again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Lookup:
    """A fixed map from 64-bit keys to values, asked for whole arrays at a time.

    Keys sit in a few open tables of 32-bit places; a key whose slot is taken moves to the next, smaller
    table, and the last few are searched in sorted order. Keys and values themselves are held once.
    """

    def __init__(self, keys: np.ndarray, *values: np.ndarray, missing: tuple = ()):
        self.keys, self.values = np.asarray(keys, np.uint64), values
        self.levels: list[tuple] = []
        self.missing = missing or tuple(0 for _ in values)
        left = np.arange(len(self.keys), dtype=np.int32)
        odd = 0x9E3779B97F4A7C15
        for _ in range(3):
            if not len(left):
                break
            bits = max(4, int(np.ceil(np.log2(len(left) * 4))))
            mult, shift = np.uint64(odd), np.uint64(64 - bits)
            slot = (self.keys[left] * mult) >> shift
            at, first = np.unique(slot, return_index=True)
            place = np.full(1 << bits, -1, np.int32)
            place[at] = left[first]
            self.levels.append((mult, shift, place))
            left = np.delete(left, first)
            odd = (odd * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1
        self.rest = left[np.argsort(self.keys[left], kind="stable")]

    def __call__(self, asked: np.ndarray) -> list[np.ndarray]:
        found = np.full(len(asked), -1, np.int32)
        todo = None
        for mult, shift, place in self.levels:
            q = asked if todo is None else asked[todo]
            own = place[(q * mult) >> shift]
            at = np.flatnonzero(own >= 0)  # an empty slot proves that the key is in no table
            own = own[at]
            where = at if todo is None else todo[at]
            hit = self.keys[own] == q[at]
            found[where[hit]] = own[hit]
            todo = where[~hit]
            if not len(todo):
                break
        if len(self.rest) and todo is not None and len(todo):
            q, keys = asked[todo], self.keys[self.rest]
            at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
            hit = keys[at] == q
            found[todo[hit]] = self.rest[at[hit]]
        at = np.flatnonzero(found >= 0)
        out = [np.full(len(asked), m, v.dtype) for m, v in zip(self.missing, self.values)]
        for o, v in zip(out, self.values):
            o[at] = v[found[at]]
        return out


def chunks(sizes_: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes_):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes_):
        yield start, len(sizes_)


__all__ = [
    "BLOCK_BYTES", "BUCKET_KEYS", "Lookup", "chunks", "cuts", "drop_stored", "finished", "id_text", "in_blocks",
    "sizes", "stored", "table", "text_bytes",
]
