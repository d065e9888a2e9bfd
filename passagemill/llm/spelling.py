"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols. Two words one edit apart have reduced forms that are equal or one edit
apart, so the full one-edit neighbourhood of a word's reduced form holds the reduced form of every near word.
Neighbourhoods are hashes, computed from prefix and suffix sums without building the strings.
A bitmap of fixed size drops most hashes that no word has; the rest are joined with the hashes of the
reduced vocabulary, and pairs that meet are verified on the words. A bitmap that fills up only lets more through.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm import words as W
from passagemill.llm.shared import drop_stored, id_text, stored

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
SYMBOLS = 12
LEAST_LETTERS = 7
LEAST_COUNT = 2
TIMES = 10  # a form is at least so many times as frequent
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
FILTER_BITS = 25  # 4 MB
_SLICE_BITS = 16
_LETTERS = 1 << 17
_SENT_BYTES = 8 << 20


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def counted(docs: DataFrame, drop_one_in: int | None = None) -> DataFrame:
    """(word, n) of all runs of letters, A-Z in lower case, with no lower limit.

    With ``drop_one_in`` a run loses one letter where that number divides the unsigned crc32 of
    ``<doc_id>:<run>``: the one at that value modulo its length. A null id counts as empty there.
    """
    runs = id_text(docs).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(RUN), F.lit(0))).alias("run")
    )
    word = F.col("run")
    if drop_one_in:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % drop_one_in == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _reduced(words: list[str], length: int, symbols: int) -> np.ndarray:
    """The symbols of words of one length, a row each; symbols start at 1."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return (W.mix(codes + np.uint64(0x51ED)) % np.uint64(symbols) + np.uint64(1)).reshape(len(words), length)


def _hash(sums: np.ndarray, length: int) -> np.ndarray:
    return W.mix(sums + W.mix(np.array([length], np.uint64)))


def reduced_hash(reduced: np.ndarray) -> np.ndarray:
    """The hash of each reduced word (a row each)."""
    m = reduced.shape[1]
    return _hash((reduced * W.powers(_BASE, m)).sum(axis=1, dtype=np.uint64), m)


def neighbourhood(reduced: np.ndarray, symbols: int) -> Iterator[np.ndarray]:
    """Hashes of everything one deletion, replacement or insertion away from reduced words, and of themselves.

    A replacement by the same symbol gives the word itself. Each array has the words as rows.
    """
    m = reduced.shape[1]
    power = W.powers(_BASE, m + 1)
    terms = reduced * power[:m]
    pre = np.zeros((len(reduced), m + 1), np.uint64)
    np.cumsum(terms, axis=1, out=pre[:, 1:])
    whole = pre[:, -1:]
    after = whole - pre  # of places i..m-1
    yield _hash(pre[:, :-1] + after[:, 1:] * np.uint64(_INVERSE), m - 1)
    rest, room = whole - terms, pre + after * np.uint64(_BASE)
    for symbol in np.arange(1, symbols + 1, dtype=np.uint64):
        yield _hash(rest + symbol * power[None, :m], m)
        yield _hash(room + symbol * power[None, :], m + 1)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, int]]:
    """Positions of words of one length, at most ``_LETTERS`` letters together (one word at least), and the length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for m in np.unique(size).tolist():
        same = np.flatnonzero(size == m)
        for k in range(0, len(same), step := max(1, _LETTERS // max(1, m))):
            yield same[k : k + step], m


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _known(words: DataFrame, symbols: int) -> DataFrame:
    """(key, other, m): the reduced hash of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            keys = np.zeros(len(texts), np.uint64)
            for at, m in _by_length(texts):
                keys[at] = reduced_hash(_reduced([texts[i] for i in at], m, symbols))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0), batch.column(1)], ["key", "other", "m"])

    return words.mapInArrow(run, "key long, other string, m long")


def _filter(known: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** FILTER_BITS slots that says which the reduced vocabulary takes; of one size at every size of vocabulary."""
    part = 1 << _SLICE_BITS

    def run(rows: pa.Table) -> pa.Table:
        slots = _slot(rows["key"].to_numpy().view(np.uint64))
        bits = np.zeros(part, bool)
        bits[slots % part] = True
        return pa.table({"slice": pa.array([int(slots[0]) // part], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    slots = known.select(F.shiftrightunsigned("key", 64 - FILTER_BITS).alias("slot")).distinct()
    keys = slots.select(F.shiftleft("slot", 64 - FILTER_BITS).alias("key"), F.shiftright("slot", _SLICE_BITS).alias("slice"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in keys.groupBy("slice").applyInArrow(run, "slice int, bits binary").toLocalIterator():
        out[row["slice"] * part // 8 :][: part // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _asked(words: DataFrame, symbols: int, taken: np.ndarray) -> DataFrame:
    """(key, word, n): the hashes of each word's neighbourhood that the reduced vocabulary may hold, each once."""
    sent = words.sparkSession.sparkContext.broadcast(taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at, m in _by_length(texts):
                rows, keys = [], []
                for hashes in neighbourhood(_reduced([texts[i] for i in at], m, symbols), symbols):
                    slot = _slot(hashes)
                    row, col = np.nonzero(bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
                    rows.append(row.astype(np.uint64))
                    keys.append(hashes[row, col])
                pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(keys)]), axis=1)
                step = max(1, _SENT_BYTES // (16 + 4 * m))
                for k in range(0, pairs.shape[1], step):
                    part = batch.take(pa.array(at[pairs[0, k : k + step].astype(np.int64)]))
                    key = pa.array(np.ascontiguousarray(pairs[1, k : k + step]).view(np.int64))
                    yield pa.RecordBatch.from_arrays([key, part.column(0), part.column(1)], ["key", "word", "n"])

    return words.mapInArrow(run, "key long, word string, n long")


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, other, m): all ordered pairs of ``words`` (word, n; distinct) exactly one edit apart.

    ``other`` is reached by one hash of the neighbourhood of ``word`` only, so no pair repeats.
    """
    known = _known(words, symbols)
    asked = _asked(words, symbols, _filter(known))
    met = asked.join(known, "key").where((F.col("word") != F.col("other")) & (F.abs(F.length("word") - F.length("other")) <= 1))
    return met.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "m")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the end of each word's chain; forms grow tenfold a step, so jumps are few."""
    ends = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        over = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(ends.join(over, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_stored(ends)
        more = step.where("moved").limit(1).count()
        ends = step.select("word", "root")
        if not more:
            return ends


def variants(
    docs: DataFrame, drop_one_in: int | None = None, symbols: int = SYMBOLS, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, times: int = TIMES
) -> DataFrame:
    """Words of ``docs`` with the spelling each stands for: word, form, root, n, n_near, form_n.

    Words are runs of letters (A-Z in lower case, see ``counted``) of at least ``letters`` code points that occur ``least``
    times. Near words differ by exactly one code point inserted, deleted or replaced. ``form`` is the near word of largest
    count (ties: the first in code-point order) if it is at least ``times`` as frequent, else null; ``root`` follows forms to
    the last. Null and empty texts have no words; repeated rows count each; an empty table gives an
    empty one; other columns are not read. Texts and words of any length are taken whole.
    """
    words = stored(counted(docs, drop_one_in).where((F.length("word") >= letters) & (F.col("n") >= least)), "words")
    best = F.min_by(F.struct("other", "m"), F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best")
    near = near_pairs(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best)
    named = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("best.m") >= times * F.col("n"), F.col("best")).alias("best"),
        ), "forms",
    )
    named = named.select("word", "n", "n_near", F.col("best.other").alias("form"), F.col("best.m").alias("form_n"))
    ends = roots(named.where("form is not null").select("word", "form"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
