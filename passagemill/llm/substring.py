"""Substring deduplication: words covered by windows that occur more than once.

Windows that are repeated at one length alone are extended to twice that length, up
to the window asked for (an overlap of the two halves makes the last length exact). A
level hashes every window of its length in the texts it is given, finds the hashes that occur
twice by a packed exchange, and keeps the runs of repeated windows that are long enough to hold a
repeated window of the final length. Only those runs are the texts of the next level. Where no
candidate survives, the work ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import words as W
from passagemill.llm.shared import cuts, drop_stored, finished, id_text, in_blocks, sizes, stored, text_bytes

FIRST = 9


def lengths(window: int, first: int = FIRST) -> list[int]:
    """Window lengths of the levels: halves of the window, rounded up, while at least ``first``; shortest first."""
    out = [window]
    while (out[-1] + 1) // 2 >= first:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def _window_keys(texts: pa.Array, length: int, exact: bool) -> Iterator[tuple]:
    """For runs of texts: word places and, per text with windows, where its windows begin; two keys each.

    The first key is the hash of the window's word hashes. Exact levels add a second,
    independent one from the window's words themselves.
    """
    for a, b, buf, off in W.parts(texts):
        starts, ends, doc = W.spans(buf, off)
        hashes = W.span_hash(W.prefix(buf), starts, ends)
        bounds = np.searchsorted(doc, np.arange(b - a + 1))
        keys = W.window_hash(hashes, length)
        inside = np.zeros(len(starts), bool)
        if len(keys):
            inside[: len(keys)] = doc[: len(keys)] == doc[length - 1 :]
        at = np.flatnonzero(inside)
        keys = keys[at] if len(at) else np.zeros(0, np.uint64)
        second = None
        if exact:
            second = np.zeros(len(at), np.uint64)
            raw = buf.tobytes()
            for d in np.unique(doc[at]):
                lo, hi = bounds[d], bounds[d + 1]
                parts = [raw[s:e] for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
                joined = b" ".join(parts)
                edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)])
                mine = slice(*np.searchsorted(at, [lo, hi]))
                places = at[mine] - lo
                spans = zip(edge[places].tolist(), (edge[places + length] - 1).tolist())
                digest = xxhash.xxh3_64_intdigest
                second[mine] = np.fromiter((digest(joined[s:e]) for s, e in spans), np.uint64, len(places))
        yield a, b, (buf, starts, ends, bounds), at, keys, second


def _sent(second: np.ndarray | None, keys: np.ndarray) -> bytes:
    """Low five bytes of keys (their high bits are the bucket), or all bytes of both keys on exact levels."""
    if second is None:
        return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
    return np.stack([keys, second], axis=1).tobytes()


def _distinct(texts: pa.Array, length: int, exact: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Sorted distinct keys of a block, how often each occurs, and the place of every window's key."""
    found = [(k, s) for *_, k, s in _window_keys(texts, length, exact)]
    keys = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.uint64)
    if not exact:
        keys, back, n = np.unique(keys, return_inverse=True, return_counts=True)
        return keys, None, n, back
    second = np.concatenate([s for _, s in found]) if found else np.zeros(0, np.uint64)
    order = np.lexsort((second, keys))
    k, s = keys[order], second[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    rank = np.cumsum(new) - 1
    back = np.empty(len(k), np.int64)
    back[order] = rank
    return k[new], s[new], np.bincount(rank, minlength=int(new.sum())), back


def _repeats(texts: DataFrame, length: int, exact: bool, bits: int) -> DataFrame:
    """(block, bucket, flags): which of a block's distinct keys occur more than once, in key order."""

    def ask(part: pa.Table) -> pa.Table:
        block = part["block"][0].as_py() if part.num_rows else 0
        keys, second, n, _ = _distinct(part["text"], length, exact)
        edge = cuts(keys, bits)
        rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if hi > lo]
        return pa.table({
            "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
            "block": pa.array([block] * len(rows), pa.int32()),
            "keys": pa.array([_sent(None if second is None else second[lo:hi], keys[lo:hi]) for _, lo, hi in rows], pa.binary()),
            "many": pa.array([np.packbits(n[lo:hi] > 1).tobytes() for _, lo, hi in rows], pa.binary()),
        })

    width = 16 if exact else 5

    def answer(part: pa.Table) -> pa.Table:
        sent = [np.frombuffer(k.as_py(), np.uint8).reshape(-1, width) for k in part["keys"]]
        sizes_ = [len(s) for s in sent]
        raw = np.concatenate(sent)
        many = np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=n).astype(bool) for m, n in zip(part["many"], sizes_)])
        if exact:
            pair = raw.view(np.uint64)
            order = np.lexsort((pair[:, 1], pair[:, 0]))
            same = (pair[order][1:] == pair[order][:-1]).all(axis=1)
        else:
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :5] = raw
            keys = wide.view(np.uint64).ravel()
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        flags = many
        flags[order] |= again
        cut = np.split(flags, np.cumsum(sizes_)[:-1])
        keep = [i for i, c in enumerate(cut) if c.any()]
        return pa.table({
            "block": part["block"].take(pa.array(keep, pa.int64())),
            "bucket": part["bucket"].take(pa.array(keep, pa.int64())),
            "flags": pa.array([np.packbits(cut[i]).tobytes() for i in keep], pa.binary()),
        })

    asked = texts.groupBy("block").applyInArrow(ask, "bucket int, block int, keys binary, many binary")
    return asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, flags binary")


def _repeated_windows(part: pa.Table, flags: pa.Table, length: int, exact: bool, bits: int) -> Iterator[tuple]:
    """Per text of a block: its row, its word places, and where its repeated windows begin."""
    keys, _, _, back = _distinct(part["text"], length, exact)
    edge = cuts(keys, bits)
    hot = np.zeros(len(keys), bool)
    for bucket, packed in zip(flags["bucket"].to_pylist(), flags["flags"].to_pylist()):
        lo, hi = edge[bucket], edge[bucket + 1]
        hot[lo:hi] = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(hi - lo)).astype(bool)
    hot = hot[back]
    done = 0
    for a, b, buf, off in W.parts(part["text"]):
        starts, ends, doc = W.spans(buf, off)
        bounds = np.searchsorted(doc, np.arange(b - a + 1))
        inside = np.zeros(len(starts), bool)
        if len(starts) >= length:
            inside[: len(starts) - length + 1] = doc[: len(starts) - length + 1] == doc[length - 1 :]
        at = np.flatnonzero(inside)
        mine = at[hot[done : done + len(at)]]
        done += len(at)
        where = np.searchsorted(mine, bounds)
        for d in range(b - a):
            lo, hi = bounds[d], bounds[d + 1]
            yield a + d, buf, starts[lo:hi], ends[lo:hi], mine[where[d] : where[d + 1]] - lo


def _runs(places: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs (first, last) of consecutive places, at least ``least`` long."""
    if not len(places):
        return []
    turn = np.flatnonzero(np.diff(places) != 1)
    first, last = places[np.concatenate([[0], turn + 1])], places[np.concatenate([turn, [len(places) - 1]])]
    keep = last - first + 1 >= least
    return list(zip(first[keep].tolist(), last[keep].tolist()))


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> bytes:
    places = zip(starts.tolist(), ends.tolist()) if keep is None else zip(starts[keep].tolist(), ends[keep].tolist())
    raw = buf.tobytes() if len(buf) < 1 << 16 else buf
    return b" ".join([bytes(raw[s:e]) for s, e in places])


def remove_repeats(
    docs: DataFrame, window: int = 35, first: int = FIRST, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (kept words joined by one space) and kept_sha256 of it.

    A word is removed if a window of ``window`` words that covers it has a word sequence that
    starts at some other place too, in the same or another row; the input decides, not what is left. Repeated rows
    are each other's copies, ties need no rule: all copies are removed. Null, empty and shorter texts
    lose nothing (a null text has no words). A null doc_id is kept. An empty table gives an empty one; other
    columns are not read. Texts of any length are worked through whole, in a block of their own size.
    """
    spark = docs.sparkSession
    base = id_text(docs, id_col, text_col)
    blocks, bits = sizes(text_bytes(base))
    levels = lengths(window, first)
    # rows that share an id, or have none, spread by their texts
    base = in_blocks(base, blocks, "doc_id", "text")
    left = window - levels[0] + 1

    def candidates(key: tuple, part: pa.Table, flags: pa.Table) -> pa.Table:
        rows: dict[str, list] = {n: [] for n in ("uid", "doc_id", "n_words", "kept", "text", "runs")}
        if part.num_rows:
            ids = part["doc_id"].to_pylist()
            for row, buf, starts, ends, hot in _repeated_windows(part, flags, levels[0], len(levels) == 1, bits):
                runs = _runs(hot, left)
                words = _joined(buf, starts, ends).decode("utf-8")
                spans = [{"start": s, "size": e - s + levels[0]} for s, e in runs]
                for name, value in zip(rows, (key[0].as_py() << 32 | row, ids[row], len(starts), None if runs else words, words if runs else None, spans)):
                    rows[name].append(value)
        return pa.table(
            list(rows.values()),
            schema=pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept", pa.string()), ("text", pa.string()),
                              ("runs", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())])))]),
        )

    flags = stored(_repeats(base, levels[0], len(levels) == 1, bits), "repeats")
    finished(spark)
    shape = "uid long, doc_id long, n_words long, kept string, text string, runs array<struct<start:long,size:long>>"
    state = stored(base.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(candidates, shape), "candidates")
    drop_stored(flags)
    finished(spark)

    found = state.where("text is not null")
    spans = found.select("uid", F.explode("runs").alias("run")).select("uid", F.col("run.start").alias("start"), F.col("run.size").alias("size"))
    if len(levels) > 1:
        cut = found.select("uid", F.explode("runs").alias("run"), F.split("text", " ").alias("w"))
        segments = stored(
            cut.select("uid", F.col("run.start").alias("start"), F.array_join(F.slice("w", (F.col("run.start") + 1).cast("int"), F.col("run.size").cast("int")), " ").alias("text")),
            "segments",
        )
        for k, length in enumerate(levels[1:], 1):
            segments = _next_level(segments, length, window, k == len(levels) - 1, blocks)
            if segments.limit(1).count() == 0:
                break
        spans = segments.select("uid", "start", "size")
    ranges = spans.groupBy("uid").agg(F.collect_list(F.struct("start", "size")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, n, kept, text, spans_ in zip(*(batch.column(i).to_pylist() for i in range(5))):
                removed = 0
                if text is not None:
                    parts = text.split(" ")
                    cover = np.zeros(n + 1, np.int64)
                    for s in spans_ or []:
                        cover[s["start"]] += 1
                        cover[s["start"] + s["size"]] -= 1
                    stay = np.cumsum(cover[:-1]) == 0
                    removed = int(n - stay.sum())
                    kept = " ".join([p for p, s in zip(parts, stay.tolist()) if s])
                rows.append((doc_id, n, removed, kept, hashlib.sha256(kept.encode()).hexdigest()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    whole = state.where("text is null").select("doc_id", "n_words", "kept", "text", F.lit(None).cast("array<struct<start:long,size:long>>").alias("spans"))
    hit = found.join(ranges, "uid", "left").select("doc_id", "n_words", "kept", "text", "spans")
    return whole.unionByName(hit).mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def _next_level(segments: DataFrame, length: int, window: int, last: bool, blocks: int) -> DataFrame:
    """Runs of repeated windows of ``length`` inside ``segments`` (uid, start, text), as segments again.

    On the last level the runs are the places to remove: (uid, start, size).
    """
    segments = in_blocks(segments.select("uid", "start", "text"), blocks, "uid", "start")
    _, bits = sizes(text_bytes(segments))
    flags = stored(_repeats(segments, length, last, bits), "repeats")

    def survivors(part: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if part.num_rows:
            uids, begins = part["uid"].to_pylist(), part["start"].to_pylist()
            for row, buf, starts, ends, hot in _repeated_windows(part, found, length, last, bits):
                for s, e in _runs(hot, window - length + 1):
                    size = e - s + length
                    text = None if last else _joined(buf, starts[s : s + size], ends[s : s + size]).decode("utf-8")
                    out.append((uids[row], begins[row] + s, size, text))
        cols = list(zip(*out)) if out else [[]] * 4
        kinds = {"uid": pa.int64(), "start": pa.int64(), "size": pa.int64(), "text": pa.string()}
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), cols)})

    both = segments.groupBy("block").cogroup(flags.groupBy("block"))
    out = stored(both.applyInArrow(survivors, "uid long, start long, size long, text string"), "segments")
    drop_stored(flags)
    drop_stored(segments)
    finished(segments.sparkSession)
    return out
