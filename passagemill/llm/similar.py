"""Near duplicates by the words they share: all pairs of texts with a Jaccard similarity of at least 0.8, exactly.

Texts that are equal but for case and blanks are one node. First, shingles are counted by a packed
exchange (``shared``). A shingle of one document alone can be shared with none, so a document with more
of them than the similarity allows has no near copy and is done. The others get a fingerprint and are
compared by the tiled SimHash comparison of ``simhash``; what it links is checked on the shingle sets. That finds
most classes, but not all links. The rest comes from rare shingles: with shingles ordered by how many documents hold
them, rarest first, two similar texts share one of their first n - ceil(0.8 n) + 1. Inside a shingle's group members are
first held against one centre, the text with the fewest shingles of its own, so a group of any size gives a link a
member; only members of groups that then still have several classes are compared in pairs, across classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm import words as W
from passagemill.llm.components import components
from passagemill.llm.shared import cuts, drop_stored, finished, id_text, in_blocks, sizes, stored, text_bytes
from passagemill.llm.simhash import near_links

WORDS = 5
LEAST = 0.8
RADIUS = 4
_SLICE = 1 << 15  # shingles whose bits are unpacked at once
_EPS = 1e-9


def _range_hash(pre: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The hash of runs of word hashes, given their prefix sums; the length is part of it."""
    inverse = W.powers(W._WORD_INVERSE, len(pre))[start]
    return W.mix((pre[start + length] - pre[start]) * inverse + W.mix(length.astype(np.uint64)))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key of each text, and the distinct shingles of all: owner and hash, by owner, then hash.

    A text with fewer words is one shingle, one without words has none. A-Z count as a-z.
    """
    key = np.zeros(len(texts), np.uint64)
    owners, found = [], []
    for a, b, buf, off in W.parts(texts):
        buf = W.LOWER[buf]
        starts, ends, row = W.spans(buf, off)
        hashes = W.span_hash(W.prefix(buf), starts, ends)
        pre = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * W.powers(W._WORD_BASE, len(hashes)), out=pre[1:])
        first = np.searchsorted(row, np.arange(b - a + 1))
        size = np.diff(first)
        key[a:b] = _range_hash(pre, first[:-1], size)
        n = np.where(size > 0, np.maximum(1, size - words + 1), 0)
        owner = np.repeat(np.arange(b - a), n)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        grams = _range_hash(pre, first[:-1][owner] + inner, np.minimum(size, words)[owner])
        order = np.lexsort((grams, owner))
        owner, grams = owner[order], grams[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        owners.append(owner[new] + a)
        found.append(grams[new])
    if not owners:
        return key, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return key, np.concatenate(owners), np.concatenate(found)


def _fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in more than half of the hashes."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _SLICE):
        bits = np.unpackbits(hashes[k : k + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _counted(texts: DataFrame, words: int, bits: int) -> DataFrame:
    """(block, bucket, level): for a block's distinct shingles, in their order, how many rows hold each.

    Level 0 is one row; higher ones grow with the logarithm. Buckets where all are 0 give no row.
    """

    def ask(part: pa.Table) -> pa.Table:
        keys, n = np.unique(shingle_sets(part["text"], words)[2], return_counts=True)
        edge = cuts(keys, bits)
        low = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :5])
        n = np.minimum(n, 255).astype(np.uint8)
        rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if hi > lo]
        return pa.table({
            "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
            "block": pa.array([part["block"][0].as_py()] * len(rows), pa.int32()),
            "keys": pa.array([low[lo:hi].tobytes() for _, lo, hi in rows], pa.binary()),
            "n": pa.array([n[lo:hi].tobytes() for _, lo, hi in rows], pa.binary()),
        })

    def answer(part: pa.Table) -> pa.Table:
        sent = [np.frombuffer(k.as_py(), np.uint8).reshape(-1, 5) for k in part["keys"]]
        wide = np.zeros((sum(map(len, sent)), 8), np.uint8)
        wide[:, :5] = np.concatenate(sent)
        n = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in part["n"]]).astype(np.float64)
        _, back = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
        total = np.bincount(back, weights=n)[back]
        level = np.minimum(255, np.where(total > 1, np.ceil(4 * np.log2(np.maximum(1, total))), 0)).astype(np.uint8)
        cut = np.split(level, np.cumsum([len(s) for s in sent])[:-1])
        keep = [i for i, c in enumerate(cut) if c.any()]
        return pa.table({
            "block": part["block"].take(pa.array(keep, pa.int64())),
            "bucket": part["bucket"].take(pa.array(keep, pa.int64())),
            "level": pa.array([cut[i].tobytes() for i in keep], pa.binary()),
        })

    asked = texts.groupBy("block").applyInArrow(ask, "bucket int, block int, keys binary, n binary")
    return asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, level binary")


_DESCRIBED = pa.schema([
    ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("fp", pa.int64()),
    ("tokens", pa.list_(pa.int64())), ("shingles", pa.binary()),
])


def _described(texts: DataFrame, levels: DataFrame, words: int, least: float, bits: int) -> DataFrame:
    """Per row: doc_id and key; where it may have near copies also n (shingles), own (those of no other row), fp, tokens and shingles.

    Tokens are the rarest shingles that other rows hold too, as many as a similar text must meet.
    """

    def run(part: pa.Table, told: pa.Table) -> pa.Table:
        if not part.num_rows:
            return _DESCRIBED.empty_table()
        key, owner, grams = shingle_sets(part["text"], words)
        keys, back = np.unique(grams, return_inverse=True)
        level = np.zeros(len(keys), np.uint8)
        edge = cuts(keys, bits)
        for bucket, packed in zip(told["bucket"].to_pylist(), told["level"]):
            level[edge[bucket] : edge[bucket + 1]] = np.frombuffer(packed.as_py(), np.uint8)
        level = level[back]
        first = np.searchsorted(owner, np.arange(part.num_rows + 1))
        n = np.diff(first)
        own = np.bincount(owner[level == 0], minlength=part.num_rows)
        meets = n - np.ceil(least * n - _EPS).astype(np.int64) + 1
        near = np.flatnonzero((n > 0) & (own < meets))
        order = np.lexsort((grams, level, owner))
        fp, tokens, sets = ([None] * part.num_rows for _ in range(3))
        for k in near.tolist():
            lo, hi = first[k], first[k + 1]
            fp[k] = _fingerprint(grams[lo:hi])
            tokens[k] = grams[order[lo + own[k] : lo + meets[k]]].view(np.int64)
            sets[k] = grams[lo:hi].tobytes()
        is_near = np.zeros(part.num_rows, bool)
        is_near[near] = True
        cols = [part["doc_id"], pa.array(key.view(np.int64)), pa.array(n, mask=~is_near), pa.array(own, mask=~is_near)]
        cols += [pa.array(fp, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
        return pa.table(cols, schema=_DESCRIBED)

    shape = "doc_id long, key long, n long, own long, fp long, tokens array<long>, shingles binary"
    return texts.groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(run, shape)


def _possible(least: float, n: Column, own: Column, m: Column, other_own: Column) -> Column:
    """Whether the sizes allow the similarity: no more can be shared than what either text does not have alone."""
    shared = F.least(n - own, m - other_own)
    return shared >= least * (n + m - shared) - _EPS


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b) whose shingles (key, shingles) have at least that Jaccard similarity; each pair once."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = both >= least * (len(x) + len(y) - both) - _EPS
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    one, two = (sets.select(F.col("key").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return stored(both.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b").mapInArrow(check, "a long, b long"), "confirmed")


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    labels = components(links).select(F.col("node").alias("key"), F.col("label").alias("near"))
    return stored(nodes.select("key").join(labels, "key", "left").select("key", F.coalesce("near", "key").alias("label")), "labels")


def fingerprint_pairs(nodes: DataFrame, radius: int, least: float) -> DataFrame:
    """(a, b): each fingerprint with the first that the tiled comparison links it to, and nodes of one fingerprint with
    the first of them; where sizes allow it. A pair a node at most."""
    lead = nodes.groupBy("fp").agg(F.min(F.struct("key", "n", "own")).alias("lead")).select("fp", "lead.*")
    met = near_links(lead.select("fp"), radius).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    close = met.groupBy("a").agg(F.min("b").alias("b"))
    one, two = (lead.select(F.col("fp").alias(c), F.struct("key", "n", "own").alias(f"{c}_")) for c in "ab")
    across = close.join(one, "a").join(two, "b").select("a_", "b_")
    same = nodes.select("fp", F.struct("key", "n", "own").alias("a_")).join(lead.select("fp", F.struct("key", "n", "own").alias("b_")), "fp")
    both = across.unionByName(same.select("a_", "b_")).where("a_.key <> b_.key")
    fits = _possible(least, F.col("a_.n"), F.col("a_.own"), F.col("b_.n"), F.col("b_.own"))
    return both.where(fits).select(F.col("a_.key").alias("a"), F.col("b_.key").alias("b"))


def _open(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Tokens (token, key, n, own, rank) of groups that hold several classes, with labels."""
    now = tokens.join(labels, "key")
    mixed = now.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    return stored(now.join(mixed, "token").select("token", "key", "n", "own", "rank", "label"), "open")


def centre_pairs(open_: DataFrame, least: float) -> DataFrame:
    """(a, b): each member of a token's group with its centre, if of another class; a pair for each member and centre at most."""
    best = F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "key", "n", "own", "label")).alias("c")
    centres = open_.groupBy("token").agg(best)
    met = open_.join(centres, "token").where(F.col("label") != F.col("c.label"))
    fits = _possible(least, F.col("n"), F.col("own"), F.col("c.n"), F.col("c.own"))
    return met.where(fits).select(F.col("key").alias("a"), F.col("c.key").alias("b")).distinct()


def crossing_pairs(open_: DataFrame, least: float) -> DataFrame:
    """(a, b): members of a token's group of different classes, the larger (or equal) text first.

    The smaller text of a similar pair shares one of its first n - ceil(2 s / (1 + s) n) + 1 shingles with it, as
    a text of its size or more must share that much. At any common shingle, no more can be shared before it than the
    fewer of the shingles before, and no more after it than the fewer of those after.
    """
    first = F.col("n") - F.ceil(F.lit(2 * least / (1 + least)) * F.col("n") - _EPS) + 1
    fields = ("key", "n", "own", "label", "rank")
    one = open_.select("token", *[F.col(c).alias(f"a_{c}") for c in fields])
    two = open_.where(F.col("rank") <= first).select("token", *[F.col(c).alias(f"b_{c}") for c in fields])
    before = F.least(F.col("a_rank") - F.col("a_own"), F.col("b_rank") - F.col("b_own"))  # the shingle itself included
    shared = before + F.least(F.col("a_n") - F.col("a_rank"), F.col("b_n") - F.col("b_rank"))
    larger = F.struct("a_n", "a_key") > F.struct("b_n", "b_key")
    fits = larger & (shared >= least * (F.col("a_n") + F.col("b_n") - shared) - _EPS)
    met = one.join(two, "token").where((F.col("a_label") != F.col("b_label")) & fits)
    return met.select(F.col("a_key").alias("a"), F.col("b_key").alias("b")).distinct()


def similar_classes(docs: DataFrame, words: int = WORDS, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id and component_id, the smallest doc_id that links reach.

    Rows are linked if their sets of shingles have a Jaccard similarity of at least ``least``; all such links
    count, whatever their fingerprints (``radius`` says only which are found first). Texts without words are one class. A
    null doc_id keeps its row and names no class unless a class has no other; repeated rows give repeated rows; an empty
    table gives an empty one; texts of any length are taken whole; other columns are not read.
    """
    spark = docs.sparkSession
    base = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    blocks, bits = sizes(text_bytes(base))
    base = in_blocks(base, blocks, "doc_id", "text")
    levels = stored(_counted(base, words, bits), "levels")
    finished(spark)
    rows = stored(_described(base, levels, words, least, bits), "described")
    drop_stored(levels)
    finished(spark)
    kept = [F.first(c).alias(c) for c in ("n", "own", "fp", "tokens", "shingles")]
    nodes = stored(rows.where("n is not null").groupBy("key").agg(*kept), "nodes")
    sets = nodes.select("key", "shingles")
    links = confirmed(fingerprint_pairs(nodes.select("key", "n", "own", "fp"), radius, least), sets, least)
    labels = _labelled(nodes, links)
    placed = nodes.select(F.posexplode("tokens").alias("at", "token"), "key", "n", "own")
    tokens = placed.select("token", "key", "n", "own", (F.col("own") + F.col("at") + 1).alias("rank"))
    while True:
        open_ = _open(tokens, labels)
        more = confirmed(centre_pairs(open_, least), sets, least)
        if not more.limit(1).count():
            break
        links = links.unionByName(more)
        drop_stored(labels)
        drop_stored(open_)
        labels = _labelled(nodes, links)
    links = links.unionByName(confirmed(crossing_pairs(open_, least), sets, least))
    drop_stored(labels)
    drop_stored(open_)
    labels = components(links).select(F.col("node").alias("key"), "label")
    named = rows.select("doc_id", "key").join(labels, "key", "left").select("doc_id", F.coalesce("label", "key").alias("label"))
    names = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = stored(named.join(names, "label").select("doc_id", "component_id"), "classes")
    for done in (rows, nodes, labels):
        drop_stored(done)
    finished(spark)
    return out


def one_of_each(docs: DataFrame, words: int = WORDS, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their class; every other column stays.

    Of a class without any doc_id all rows stay; equal rows of a kept doc_id all stay.
    """
    near = similar_classes(docs, words, least, radius)
    gone = near.where("doc_id is null and component_id is not null or doc_id <> component_id").select(
        F.col("doc_id").alias("__gone")
    )
    return docs.join(gone.distinct(), docs["doc_id"].cast("long").eqNullSafe(F.col("__gone")), "left_anti")
