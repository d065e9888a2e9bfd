"""Document fingerprints as invertible Bloom lookup sketches.

The items of a text are the digests of its paragraphs: pieces that end at line breaks, at
sentence ends and at blanks that a hash of the eight bytes before them picks, so a change moves no border but
those next to it. The j-th copy of a paragraph is an item of its own. An item is added to one cell of each of three
tables; a cell holds a count, the sum of its items and the sum of their checks. Subtracting
two sketches leaves the items of one side only, and peeling cells that hold a single item
recovers them. A sketch too small to peel to the end is taken again at twice the size. All
documents of a run are sketched and peeled together in numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import words as W
from passagemill.llm.shared import id_text, stored

TABLES = 3
CELLS = 4  # of a table of the fingerprint that is given out
_RUN_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)
_BLANK = W.SPACE.copy()
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every paragraph of texts that lie one behind the other; they cover every byte."""
    n = len(buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    blank = _BLANK[buf]
    cut = buf == 10
    cut[1:] |= blank[1:] & _STOP[buf[:-1]]
    at = np.flatnonzero(blank & ~cut)
    at = at[at >= 8]
    if len(at):
        tail = np.zeros(len(at), np.uint64)
        for k in range(8):
            tail = (tail << np.uint64(8)) | buf[at - 8 + k].astype(np.uint64)
        # the eight bytes must be of the same text
        inside = at - 8 >= off[np.searchsorted(off, at, side="right") - 1]
        cut[at[inside & (W.mix(tail) & np.uint64(31) == 0)]] = True
    ends = np.unique(np.concatenate([np.flatnonzero(cut) + 1, off[1:][np.diff(off) > 0]]))
    starts = np.concatenate([[0], ends[:-1]])
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


class Items:
    """The distinct items of texts: sorted by text; ``off`` says where each text's begin."""

    def __init__(self, texts: pa.Array):
        buf, off = W.flat(texts)
        starts, ends, row = pieces(buf, off)
        keys = W.span_hash(W.prefix(buf), starts, ends)
        order = np.lexsort((keys, row))
        keys, row = keys[order], row[order]
        if len(keys):
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            copy = np.arange(len(keys)) - first[np.cumsum(new) - 1]
            keys = W.mix(keys + copy.astype(np.uint64) * _ODD)
        self.keys, self.off = keys, np.searchsorted(row, np.arange(len(texts) + 1))

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of some texts, in a row, and the position in ``rows`` of each."""
        n = self.off[rows + 1] - self.off[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return self.keys[np.repeat(self.off[rows], n) + inner], owner

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.off[rows + 1] - self.off[rows]


def _checks(keys: np.ndarray) -> np.ndarray:
    return W.mix(keys ^ _SALTS[TABLES])


def _cells(keys: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each key in each table of ``width`` cells."""
    return [(t * width + (W.mix(keys ^ _SALTS[t]) % np.uint64(width)).astype(np.int64)) for t in range(TABLES)]


def sketch(keys: np.ndarray, owner: np.ndarray, n: int, width: int) -> list[np.ndarray]:
    """Counts, sums of items and sums of checks of ``n`` sketches, one behind the other."""
    count, total, check = np.zeros(n * TABLES * width, np.int64), np.zeros(n * TABLES * width, np.uint64), np.zeros(n * TABLES * width, np.uint64)
    checks = _checks(keys)
    for cell in _cells(keys, width):
        at = owner * (TABLES * width) + cell
        count += np.bincount(at, minlength=len(count))
        np.add.at(total, at, keys)
        np.add.at(check, at, checks)
    return [count, total, check]


def peel(diff: list[np.ndarray], n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, item and sign (1: of the first side) of what ``n`` differences hold, and which of them are whole."""
    count, total, check = diff
    cells = TABLES * width
    found: list[tuple] = []
    look = np.flatnonzero(count)
    while len(look):
        sign = count[look]
        single = np.abs(sign) == 1
        at, sign = look[single], sign[single]
        keys = np.where(sign == 1, total[at], np.uint64(0) - total[at])
        sums = np.where(sign == 1, check[at], np.uint64(0) - check[at])
        own = at % cells
        right = (_checks(keys) == sums) & (np.stack(_cells(keys, width)) == own).any(axis=0)
        owner, keys, sign = at[right] // cells, keys[right], sign[right]
        if not len(keys):
            break
        first = np.unique(np.stack([owner.astype(np.uint64), keys]), axis=1, return_index=True)[1]
        owner, keys, sign = owner[first], keys[first], sign[first]
        found.append((owner, keys, sign))
        signed, checks = np.where(sign == 1, keys, np.uint64(0) - keys), _checks(keys)
        checks = np.where(sign == 1, checks, np.uint64(0) - checks)
        touched = []
        for cell in _cells(keys, width):
            at = owner * cells + cell
            np.subtract.at(count, at, sign)
            np.subtract.at(total, at, signed)
            np.subtract.at(check, at, checks)
            touched.append(at)
        look = np.unique(np.concatenate(touched))
        look = look[count[look] != 0]
    left = (count != 0) | (total != 0) | (check != 0)
    whole = ~left.reshape(n, cells).any(axis=1)
    cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate((np.int64, np.uint64, np.int64))]
    return *cols, whole


def differing(a: Items, rows_a: np.ndarray, b: Items, rows_b: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, item and side (1: first only, -1: second only) of all items in which pairs of texts differ.

    Pairs start at a size that their numbers of items do not rule out; those that do not peel to the end go on at twice the size.
    """
    gap = np.abs(a.sizes(rows_a) - b.sizes(rows_b))
    width = np.full(len(rows_a), cells, np.int64)
    while (small := width * TABLES < gap).any():
        width[small] *= 2
    out: list[tuple] = []
    todo = np.arange(len(rows_a))
    while len(todo):
        w = int(width[todo].min())
        now = todo[width[todo] == w]
        for k in range(0, len(now), step := max(1, (1 << 20) // (w * TABLES))):
            pairs = now[k : k + step]
            diff = [x - y for x, y in zip(sketch(*a.of(rows_a[pairs]), len(pairs), w), sketch(*b.of(rows_b[pairs]), len(pairs), w))]
            owner, keys, side, whole = peel(diff, len(pairs), w)
            use = whole[owner]
            out.append((pairs[owner[use]], keys[use], side[use]))
            width[pairs] = np.where(whole, 0, w * 2)
        todo = todo[width[todo] > 0]
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, t) for k, t in enumerate((np.int64, np.uint64, np.int64)))


def likeness(a: Items, rows_a: np.ndarray, b: Items, rows_b: np.ndarray) -> np.ndarray:
    """The share of items that both texts of a pair hold: twice their number over the items of both; two empty texts are alike."""
    pair, _, side = differing(a, rows_a, b, rows_b)
    n, m = a.sizes(rows_a), b.sizes(rows_b)
    both = n - np.bincount(pair[side == 1], minlength=len(n))
    return np.where(n + m > 0, 2 * both / np.maximum(1, n + m), 1.0)


def fingerprint(items: Items, rows: np.ndarray, cells: int = CELLS) -> list[bytes]:
    """The number of items and the cells of the smallest sketch: 4 bytes, then 2, 8 and 4 a cell."""
    count, total, check = (c.reshape(len(rows), -1) for c in sketch(*items.of(rows), len(rows), cells))
    head = items.sizes(rows).astype("<u4").reshape(-1, 1)
    parts = [head, count.astype("<u2"), total.astype("<u8"), check.astype("<u4")]
    raw = np.concatenate([np.ascontiguousarray(p).view(np.uint8).reshape(len(rows), -1) for p in parts], axis=1)
    return [r.tobytes() for r in raw]


def _edited(text: str, other: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
SHAPE = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
)


def _compared(ids: list, texts: list[str], others: list[str]) -> list[pa.Array]:
    """Columns of ``_ROW`` for documents and the ones that follow them."""
    edited = [_edited(t, o) for t, o in zip(texts, others)]
    # texts[1:] are others[:-1] in a run of rows: only the last has to be read besides
    chained = len(texts) and all(o is t for o, t in zip(others, texts[1:]))
    own = Items(pa.array([*texts, others[-1]] if chained else [*texts, *others], pa.large_string()))
    new = Items(pa.array(edited, pa.large_string()))
    rows = np.arange(len(texts))
    after = rows + (1 if chained else len(texts))
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
        pa.array(fingerprint(own, rows), pa.binary()), pa.array(fingerprint(new, rows), pa.binary()),
        pa.array(likeness(own, rows, new, rows), pa.float64()), pa.array(likeness(own, rows, own, after), pa.float64()),
    ]


def _passes(ids: list, texts: list[str], others: list[str]) -> Iterator[list[pa.Array]]:
    """``_compared`` for runs of rows of bounded size."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > _RUN_BYTES:
            yield _compared(ids[start:k], texts[start:k], others[start:k])
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield _compared(ids[start:], texts[start:], others[start:])


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and how alike the text is to the edited and to the next one.

    The next row follows by descending id (null ids last; equal ids by a hash of the text); after the last comes the first, and a
    lone row is its own next. The edited text has its last half (rounded down, code points) replaced by as much of the next text's
    beginning. Null counts as empty. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (hex), near_edited, near_next. Repeated rows give rows of their own; an empty table gives an empty
    one; texts of any length are read whole; other columns are not read.

    Rows are sorted by ranges, so texts move once and a range is passed through row by row. The
    last row of a range waits for the first of the next one: those two rows per range are joined apart.
    """
    base = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    keys = [F.col("doc_id").desc_nulls_last(), F.col("hash"), F.col("tie")]
    spread = base.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("tie"))
    placed = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text", F.spark_partition_id().alias("part"))
    schema = pa.schema([*_ROW, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None

        def edge(kind: str, row: tuple) -> pa.RecordBatch:
            nulls = [pa.nulls(1, f.type) for f in list(_ROW)[1:]]
            cols = [pa.array([row[0]], pa.int64()), *nulls, pa.array([row[2]], pa.int32()), pa.array([kind]), pa.array([row[1]], pa.large_string())]
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts, part = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)[0].as_py()
            if last is None:
                yield edge("first", (ids[0], texts[0], part))
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = (ids[-1], texts[-1], part)
            for cols in _passes(ids[:-1], texts[:-1], texts[1:]):
                n = len(cols[0])
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.large_string())], schema=schema)
        if last is not None:
            yield edge("last", last)

    rows = stored(placed.mapInArrow(run, f"{SHAPE}, part int, edge string, text string"), "compared")
    firsts = rows.where("edge = 'first'").select(F.col("part").alias("at"), F.col("text").alias("other"))
    # numbers of ranges that have rows, one each
    turn = rows.where("edge = 'first'").select("part", F.expr("coalesce(lead(part) over (order by part), min(part) over ())").alias("at"))
    open_ = rows.where("edge = 'last'").select("doc_id", "text", "part").join(turn, "part").join(firsts, "at").select("doc_id", "text", "other")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cols in _passes(*(batch.column(k).to_pylist() for k in range(3))):
                yield pa.RecordBatch.from_arrays(cols, schema=_ROW)

    out = rows.where("edge is null").select(*_ROW.names).unionByName(open_.mapInArrow(finish, SHAPE))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def differences(old: DataFrame, new: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What changed between two versions of documents: doc_id, removed, added (sorted paragraph digests, hex), likeness.

    Versions meet by id; a document that one side lacks has no paragraphs there, and a null text has none. Null ids
    take no part. Each id stands for one row on each side; of repeated ids the row with the greatest text counts.
    """

    def side(docs: DataFrame, name: str) -> DataFrame:
        rows = id_text(docs, id_col, text_col).where("doc_id is not null")
        return rows.groupBy("doc_id").agg(F.coalesce(F.max("text"), F.lit("")).alias(name))

    both = side(old, "old").join(side(new, "new"), "doc_id", "full")
    both = both.select("doc_id", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, rows = Items(batch.column(1)), Items(batch.column(2)), np.arange(batch.num_rows)
            pair, keys, side_ = differing(a, rows, b, rows)
            lists: list[list[list[str]]] = [[[] for _ in rows], [[] for _ in rows]]
            for p, k, s in sorted(zip(pair.tolist(), keys.tolist(), side_.tolist())):
                lists[0 if s == 1 else 1][p].append(f"{k:016x}")
            text = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lists[0], text), pa.array(lists[1], text), pa.array(likeness(a, rows, b, rows), pa.float64())],
                ["doc_id", "removed", "added", "likeness"],
            )

    return both.mapInArrow(compare, "doc_id long, removed array<string>, added array<string>, likeness double")
