"""Vector columns: cosine, norms, the text form, and the default hashed model."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double; null for a zero vector."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    dot = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot, norm(a) * norm(b))


def vector_text(v: Column) -> Column:
    return F.to_json(v)


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def micro_text(v: Column) -> Column:
    """Components in rounded millionths, comma-joined; an exact form to compare."""
    return F.array_join(
        F.transform(v, lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string")), ","
    )


def words(text: Column) -> Column:
    """Lower-case words, the unit of the default embedder and scorer."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)[^{SPACE}]++"), F.lit(0))


class HashedWords:
    """Default embedding model: word counts hashed to ``dim`` slots, unit length.

    The slot of a word is the first 8 hex digits of its md5, modulo ``dim``. No
    weights to load, so it stands in wherever a hosted model is not reachable.
    """

    MAX_CACHED = 200_000

    def __init__(self, dim: int):
        self.dim = dim
        self.slots: dict[str, int] = {}
        self.word = re.compile(rf"[^{SPACE}]+")

    def slot(self, word: str) -> int:
        found = self.slots.get(word)
        if found is None:
            if len(self.slots) >= self.MAX_CACHED:
                self.slots.clear()
            found = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim
            self.slots[word] = found
        return found

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [self.one(t) for t in texts]

    def one(self, text: str) -> np.ndarray:
        known, slot = self.slots, self.slot
        # split parts texts where ``word`` does, in a third of the time; only new words cost a call
        slots = [known[w] if w in known else slot(w) for w in text.lower().split()]
        counts = np.bincount(slots, minlength=self.dim).astype(np.float64) if slots else np.zeros(self.dim)
        length = np.sqrt((counts * counts).sum())
        return (counts / length if length else counts).astype(np.float32)
