"""Spoken sentences of an answer text, as native columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, let

# A browser's white space: no separators U+001C-1F, no U+0085, but U+FEFF.
BROWSER_SPACES = "".join(c for c in SPACES if c not in "\x1c\x1d\x1e\x1f\x85") + "\ufeff"
BROWSER_SPACE = "".join(f"\\u{ord(c):04X}" for c in BROWSER_SPACES)

# The sentence pattern and the least length.
SENTENCE = rf"([^.!?\n]+[.!?])([{BROWSER_SPACE}]+)"
MIN_SENTENCE_CHARS = 20
# The same matches in linear time: one can only start where the last one ended
# or behind a terminator or line end, as a failed run fails from all its letters.
SENTENCE_ONCE = rf"(?:\G|(?<=[.!?\n]))([^.!?\n]++[.!?])([{BROWSER_SPACE}]++)"


_FIRST = re.compile(SENTENCE)
_BEHIND = re.compile(rf"(?<=[.!?\n]){SENTENCE}")


def sentence_matches(text: str) -> Iterator[re.Match]:
    """The matches one text at a time, in linear time like the column form."""
    at = 0
    while match := _FIRST.match(text, at) or _BEHIND.search(text, at):
        yield match
        at = match.end()


def browser_trim(text: Column) -> Column:
    return F.trim(text, F.lit(BROWSER_SPACES))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: a character outside the basic plane counts twice."""
    return F.length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "xx"))


def spoken_sentences(text: Column, min_chars: int = MIN_SENTENCE_CHARS) -> Column:
    """``array<string>`` of the sentences read aloud for a finished answer.

    Every match of the pattern that is long enough is emitted. Text before an
    emitted match, short sentences included, is passed over. What follows the
    last emitted match is emitted at the end unless blank. The text is cut into
    matches and the gaps between them, so the rest is rebuilt from its pieces.
    """

    def emit(b: Column) -> Column:
        found, spoken, gaps = b["found"], b["spoken"], b["gaps"]
        long_at = F.filter(
            F.transform(spoken, lambda s, i: F.when(utf16_length(s) >= min_chars, i)), lambda i: i.isNotNull()
        )
        rest_from = F.coalesce(F.array_max(long_at) + 1, F.lit(0))
        tail = F.zip_with(
            F.slice(gaps, rest_from + 1, F.size(gaps) - rest_from),
            F.slice(found, rest_from + 1, F.greatest(F.size(found) - rest_from, F.lit(0))),
            lambda gap, match: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(match, F.lit(""))),
        )
        rest = browser_trim(F.array_join(tail, ""))
        emitted = F.filter(spoken, lambda s: utf16_length(s) >= min_chars)
        return F.concat(emitted, F.filter(F.array(rest), lambda r: r != ""))

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(SENTENCE_ONCE), F.lit(0)).alias("found"),
        F.transform(F.regexp_extract_all(text, F.lit(SENTENCE_ONCE), F.lit(1)), browser_trim).alias("spoken"),
        F.split(text, SENTENCE_ONCE, -1).alias("gaps"),
    )
    return let(parts, emit)
