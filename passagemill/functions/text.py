"""Markdown text functions as native columns: strip, sections, pages, windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EngineConfig

# All white space the text rules strip: Python's notion, as one string for trim.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# The same inside a character class of a pattern that starts with (?U).
SPACE = r"\s\x1C-\x1F"

# The heading pattern and the page-marker pattern.
HEADING = rf"(?mdU)^#{{1,3}}[{SPACE}]+(.+?)[{SPACE}]*$"
PAGE_MARKER = rf"(?iU)<!--[{SPACE}]*page:[{SPACE}]*(\d+)[{SPACE}]*-->"

Tokenizer = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A lambda argument is evaluated a single time, while a plain column
    expression repeated inside another lambda is evaluated per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Drop white space, line ends included, at both ends."""
    return F.trim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def empty_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def page_markers(text: Column) -> Column:
    """Every page number marked in the text, in order; oversized numbers are null.

    A text without the opening of a comment skips the pattern search.
    """
    found = F.regexp_extract_all(text, F.lit(PAGE_MARKER), F.lit(1))
    pages = F.transform(found, lambda d: d.try_cast("int"))
    return F.when(text.contains("<!--"), pages).otherwise(F.array().cast("array<int>"))


def last_page(text: Column) -> Column:
    """The last readable page marker, or null."""
    return F.try_element_at(F.filter(page_markers(text), lambda p: p.isNotNull()), F.lit(-1))


def sections(markdown: Column) -> Column:
    """``array<struct<heading, body>>`` between H1-H3 headings.

    The heading pattern is used twice, once to cut the bodies and once to pull
    the headings, so body ``i`` belongs to heading ``i - 1``. A blank body
    disappears together with its heading; if nothing remains, the whole text is
    one section without a heading; a blank document has no section.
    """

    def pair(parts: Column) -> Column:
        return F.transform(
            parts["bodies"],
            lambda body, i: F.struct(
                F.when(i > 0, strip(F.get(parts["heads"], i - 1))).alias("heading"),
                strip(body).alias("body"),
            ),
        )

    parts = F.struct(
        F.split(markdown, HEADING, -1).alias("bodies"),
        F.regexp_extract_all(markdown, F.lit(HEADING), F.lit(1)).alias("heads"),
    )
    kept = F.filter(let(parts, pair), lambda s: s["body"] != "")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("heading"), strip(markdown).alias("body")))
    headed = let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(whole))
    return (
        F.when(is_blank(markdown), F.slice(whole, 1, 0))
        .when(markdown.contains("#"), headed)
        .otherwise(whole)
    )


def carried_pages(pages: Column) -> Column:
    """For each position the last non-null page at or before it, in linear time.

    The marked positions are listed, and each marked page is repeated up to the
    next marked position.
    """

    def spread(b: Column) -> Column:
        marks, all_pages = b["marks"], b["pages"]
        size = F.size(all_pages)
        first = F.coalesce(F.get(marks, F.lit(0)), size)
        runs = F.transform(
            marks,
            lambda at, j: F.array_repeat(F.get(all_pages, at), F.coalesce(F.get(marks, j + 1), size) - at),
        )
        return F.concat(F.array_repeat(F.lit(None).cast("int"), first), F.flatten(runs))

    def find_marks(p: Column) -> Column:
        at = F.transform(p, lambda v, i: F.when(v.isNotNull(), i))
        return F.struct(p.alias("pages"), F.filter(at, lambda i: i.isNotNull()).alias("marks"))

    return let(let(pages, find_marks), spread)


def word_tokens(text: Column) -> Column:
    """Lossless default tokenizer: each token is a word with the space before it.

    Joining all tokens of a stripped text gives the text back.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?U)[{SPACE}]*+[^{SPACE}]++"), F.lit(0))


def window_count(n_tokens: Column, cfg: EngineConfig) -> Column:
    over = n_tokens - F.lit(cfg.chunk_size)
    steps = F.ceil(over / F.lit(cfg.stride)).cast("int")
    return F.when(over <= 0, F.lit(1)).otherwise(steps + 1)


def token_windows(body: Column, cfg: EngineConfig, tokenize: Tokenizer = word_tokens) -> Column:
    """``array<struct<content, token_count>>``: overlapping windows over the tokens."""

    def cut(tokens: Column) -> Column:
        n = F.size(tokens)
        starts = F.sequence(F.lit(0), window_count(n, cfg) - 1)

        def piece(w: Column) -> Column:
            start = w * cfg.stride
            return F.struct(
                F.array_join(F.slice(tokens, start + 1, cfg.chunk_size), "").alias("content"),
                F.least(F.lit(cfg.chunk_size), n - start).alias("token_count"),
            )

        return F.transform(starts, piece)

    return let(tokenize(body), cut)


class SubwordCodec:
    """A byte-pair vocabulary file, read by each Python worker when it first needs it; only the path travels.

    ``path`` is a file of the ``tokenizers`` library that every executor can read.
    """

    def __init__(self, path: str):
        self.path = path
        self._model = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "_model": None}

    def _loaded(self):
        if self._model is None:
            from tokenizers import Tokenizer

            self._model = Tokenizer.from_file(self.path)
            self._model.no_truncation()
            self._model.no_padding()
        return self._model

    def encode(self, text: str) -> list[int]:
        return self._loaded().encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self._loaded().decode(ids, skip_special_tokens=False)


def encoder_windows(encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], cfg: EngineConfig):
    """Windows over a subword encoder's ids, as a vectorised function of the body.

    ``encode`` and ``decode`` are loaded with the task, so any byte-pair
    vocabulary can replace the default tokenizer.
    """
    size, stride = cfg.chunk_size, cfg.stride

    def windows_of(text: str) -> list[dict]:
        ids = encode(text)
        if len(ids) <= size:
            return [{"content": text, "token_count": len(ids)}]
        last = -(-(len(ids) - size) // stride)
        cuts = [ids[w * stride : w * stride + size] for w in range(last + 1)]
        return [{"content": decode(c), "token_count": len(c)} for c in cuts]

    @F.pandas_udf("array<struct<content:string,token_count:int>>")
    def windows(bodies: pd.Series) -> pd.Series:
        return bodies.map(windows_of)

    return windows
