"""Words of many texts at once: their places and 64-bit hashes, in numpy over Arrow's text buffer.

A word is ``[^\\x20\\x09-\\x0D]+``; words never reach over the end of a text. A hash is a
polynomial of the word's bytes modulo 2**64, mixed; prefix sums give it for all words
of a buffer without a loop. It is the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from passagemill.llm.shared import chunks

CHUNK_BYTES = 2 << 20
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_BASE = 0xC6A4A7935BD1E995
_WORD_INVERSE = pow(_WORD_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 23:  # a table for one huge text is not kept
            _tables[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the row of its text."""
    n = len(buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    gap = space[buf]
    begin = ~gap
    begin[1:] &= gap[:-1]
    heads = off[:-1][off[:-1] < n]
    begin[heads] = ~gap[heads]
    end = ~gap
    end[:-1] &= gap[1:]
    tails = off[1:][off[1:] > 0] - 1
    end[tails] = ~gap[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the byte polynomial."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(buf)), out=out[1:])
    return out


def span_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each byte range, wherever it lies."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    inverse = powers(_INVERSE, int(starts.max()) + 1)
    return mix((pre[ends] - pre[starts]) * inverse[starts])


def window_hash(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of every run of ``length`` word hashes."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(_WORD_BASE, n), out=pre[1:])
    return mix((pre[length:] - pre[:-length]) * powers(_WORD_INVERSE, n)[: n - length + 1])


def parts(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets of runs of texts of bounded size."""
    buf, off = flat(texts)
    for a, b in chunks(np.diff(off), limit):
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
