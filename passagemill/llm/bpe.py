"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece exactly one token can be the last one of its encoding. It is
found among the vocabulary entries that end there (an automaton gives them all in one
pass): the entry must encode to itself, and must be able to stand after the last token of
the prefix before it. Two tokens can stand side by side if undoing their merges, latest first,
never uncovers a pair at the seam that the merge order would have joined before. The
stored last tokens are followed back from the end of the piece.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from passagemill.llm.shared import id_text

#: Pieces that the byte-level splitter of the vocabulary's format cuts a text into (fixed by that format).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE = 200_000


def _latin_pattern() -> re.Pattern:
    """PIECES for texts below U+0100, in character lists."""
    chars = [chr(c) for c in range(256)]

    def listed(kind: str) -> str:
        return "".join(re.escape(c) for c in chars if regex.fullmatch(kind, c, regex.V0))

    space = "\t\n\x0b\x0c\r \x85\xa0"
    letter, number = listed(r"\p{L}"), listed(r"\p{N}")
    other = f"[^{re.escape(space)}{letter}{number}]"
    s, not_s = f"[{re.escape(space)}]", f"[^{re.escape(space)}]"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?{other}+|{s}+(?!{not_s})|{s}+")


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge order and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        unchar = _byte_chars()
        ids = held["model"]["vocab"]
        as_bytes = {t: bytes(unchar[c] for c in t) for t in ids if all(c in unchar for c in t)}
        self.bytes_of = {ids[t]: b for t, b in as_bytes.items()}
        self.special = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.made_by: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        self.gives: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(held["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            key, out = (ids[left], ids[right]), ids[left + right]
            self.rank[key], self.gives[key] = r, out
            self.made_by.setdefault(out, (r, *key))
        self.byte_ids = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1 and i not in self.special.values()}

    def _merged(self, text: bytes) -> list[int]:
        """Plain merging, used only to see which entries encode to themselves."""
        ids = [self.byte_ids[b] for b in text]
        while len(ids) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(ids, ids[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [self.gives[ids[at], ids[at + 1]]]
        return ids

    def usable(self) -> list[tuple[str, int, int]]:
        """Entries that are their own encoding: bytes as text, length, id."""
        special = set(self.special.values())
        own = ((b, i) for i, b in self.bytes_of.items() if i not in special)
        return [(b.decode("latin-1"), len(b), i) for b, i in own if self._merged(b) == [i]]


class Encoder:
    """Encodes and decodes texts; one lives in each Python worker."""

    def __init__(self, rank: dict, made_by: dict, usable: list, bytes_of: dict, special: dict):
        self.rank, self.made_by = rank, made_by
        self.match = ahocorasick.Automaton()
        for word, size, i in usable:
            self.match.add_word(word, (size, i))
        self.match.make_automaton()
        self.bytes_of = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.special = special
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.latin, self.full = _latin_pattern(), regex.compile(PIECES)
        self.fits: dict[tuple[int, int], bool] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _seam(self, a: int, b: int) -> bool:
        """Whether token ``b`` can follow token ``a``."""
        key = (a, b)
        known = self.fits.get(key)
        if known is not None:
            return known
        rank, made = self.rank, self.made_by
        bound = 1 << 60
        fits = True
        while True:
            r = rank.get((a, b))
            if r is not None and r < bound:
                fits = False
                break
            ra, rb = made.get(a, (-1,))[0], made.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                bound, a = ra, made[a][2]  # the pair at the seam lies right of this merge: it wins only by a lower rank
            else:
                bound, b = rb + 1, made[b][1]  # it lies left of this merge: it wins ties too
        if len(self.fits) > 4 * _CACHE:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece."""
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(text)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        done = 0
        for end, (size, token) in self.match.iter(text):
            end += 1
            if done == end:
                continue
            start = end - size
            if start == 0 or (last[start] >= 0 and self._seam(last[start], token)):
                last[end], back[end], done = token, start, end
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return tuple(out[::-1])

    def __missing(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.piece(piece)
        if len(piece) <= 64:
            if len(self.young) >= _CACHE:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def _plain(self, text: str) -> Iterator[tuple[int, ...]]:
        try:
            text.encode("latin-1")
            pieces = self.latin.findall(text)
        except UnicodeEncodeError:
            pieces = self.full.findall(text)
        get, missing = self.young.get, self.__missing
        return (get(p) or missing(p) for p in pieces)

    def encode(self, text: str) -> np.ndarray:
        if self.cut is None or not self.cut.search(text):
            return np.fromiter(chain.from_iterable(self._plain(text)), np.uint32)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += chain.from_iterable(self._plain(text[at : m.start()]))
            out.append(self.special[m.group()])
            at = m.end()
        out += chain.from_iterable(self._plain(text[at:]))
        return np.array(out, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def vocabulary(path: str) -> tuple[str, tuple]:
    """What an encoder needs, read once by the driver: its size is that of the vocabulary file."""
    v = Vocabulary(path)
    return path, (v.rank, v.made_by, v.usable(), v.bytes_of, v.special)


def encoder(held: tuple[str, tuple]) -> Encoder:
    """The worker's encoder; kept between tasks."""
    name, parts = held
    if name not in _encoders:
        _encoders[name] = Encoder(*parts)
    return _encoders[name]


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids and decoded text themselves.

    The ids are those of the vocabulary's own library with special strings in a text turned into
    their ids and nothing added; decoding keeps special tokens. A null text counts as empty: no ids,
    and the hash of nothing. Whole texts are encoded, of any length; repeated rows give repeated
    rows, an empty table an empty one; other columns are not read. With ``with_ids=False``
    the ids and the text are left out. Only encodings of short pieces are kept between rows, a bounded number.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[list] = [[] for _ in columns[1:]]
                for text in part.column(1):
                    ids = own.encode(text.as_py() or "")
                    back = own.decode(ids)
                    raw = ids.astype("<u4").tobytes()
                    made = [len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()]
                    for col, value in zip(rows, made + [ids.astype(np.int32), back]):
                        col.append(value)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(rows, kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return id_text(docs, id_col, text_col).mapInArrow(run, schema + ", ids array<int>, decoded string" * with_ids)
