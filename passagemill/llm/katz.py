"""Katz backoff: Good-Turing discounted word and word-pair counts with normalised backoff weights.

The documents are worked through in blocks. A block sends its distinct words and word pairs with
their counts to buckets of key ranges; a bucket adds them up, gives the totals back to the
blocks in key order. Pairs that occur often enough (``least_pairs``) make the
model's second order; one of their blocks adds each of them to its context's sums, which a block
has the counts for, and the blocks' sums together give the weights. Every context's probabilities add up to one: what the discounted
pairs leave is shared among the other words in proportion to the word model, whose own remainder
is that of the unknown word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm import words as W
from passagemill.llm.shared import chunks, cuts, drop_stored, finished, in_blocks, sizes, stored, text_bytes

#: Stand for the end of a text and for what precedes its first word; no word hashes to them but by chance.
END, BEGIN = np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1)
_RUN, _PIECE = 1 << 19, 1 << 18  # bytes of texts, and tokens, that are worked on at once


@dataclass(frozen=True)
class KatzRule:
    #: Counts up to this are discounted; above it they are trusted.
    trusted: int = 5
    #: Pairs seen less often are left to the backoff.
    least_pairs: int = 2


def discounts(n: dict[int, int], trusted: int) -> dict[int, float]:
    """Discount factor by count 1..trusted from counts of counts.

    Good-Turing by Katz's formula; where it is outside (0, 1), as with few data, half a count is taken off.
    """
    out = {}
    cut = (trusted + 1) * n.get(trusted + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, trusted + 1):
        d = -1.0
        if n.get(r) and cut < 1:
            d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - cut) / (1 - cut)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass(frozen=True)
class WordModel:
    """First order: counts, their discounts, and the share of the unknown word."""

    tokens: int
    types: int
    factor: tuple[float, ...]  # by count, from 0
    scale: float
    unknown: float

    @staticmethod
    def of(tokens: int, types: int, n: dict[int, int], trusted: int) -> WordModel:
        d = discounts(n, trusted)
        factor = (0.0, *[d[r] for r in range(1, trusted + 1)])
        left = sum(n.get(r, 0) * r * (1 - d[r]) for r in d) / tokens if tokens else 1.0
        if left > 0:
            return WordModel(tokens, types, factor, 1.0, left)
        return WordModel(tokens, types, factor, tokens / (tokens + 1), 1 / (tokens + 1))  # no rare word: one more token is thought of

    def array(self, count: np.ndarray) -> np.ndarray:
        f = np.array([*self.factor, 1.0])[np.minimum(count, len(self.factor))]
        return np.where(count > 0, f * count / max(1, self.tokens) * self.scale, self.unknown)


def _tokens(texts: pa.Array, trains: np.ndarray) -> tuple:
    """A block's tokens: sorted distinct words (END and BEGIN among them), each token's number, its row; counts in training rows.

    Words are found a run of texts at a time, so that only two 32-bit numbers stay of each token.
    """
    kinds, numbers, rows = [np.array([BEGIN, END])], [], []
    for a, b, buf, off in W.parts(texts, _RUN):
        buf = W.LOWER[buf]
        starts, ends, doc = W.spans(buf, off)
        bounds = np.searchsorted(doc, np.arange(1, b - a + 1))
        h, number = np.unique(np.insert(W.span_hash(W.prefix(buf), starts, ends), bounds, END), return_inverse=True)
        kinds.append(h)
        numbers.append(number.astype(np.int32))
        rows.append((np.insert(doc, bounds, np.arange(b - a)) + a).astype(np.int32))
    words, place = np.unique(np.concatenate(kinds), return_inverse=True)
    place, begin = place.astype(np.int32), 2
    counted = np.zeros(len(words), np.uint32)
    for k, (h, number, row) in enumerate(zip(kinds[1:], numbers, rows)):
        own = place[begin : begin + len(h)]
        counted[own] += np.bincount(number[trains[row]], minlength=len(h)).astype(np.uint32)
        numbers[k] = own[number]
        begin += len(h)
    none = np.zeros(0, np.int32)
    return words, np.concatenate([none, *numbers]), np.concatenate([none, *rows]), counted


def _pairs(words: np.ndarray, number: np.ndarray, row: np.ndarray, trains: np.ndarray) -> tuple:
    """Sorted distinct pair keys of a block, their counts in training rows, each token's pair, and a pair's context and word."""
    code = np.empty(len(number), np.int64)
    code[1:] = number[:-1]
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    code[first] = np.searchsorted(words, BEGIN)
    code *= len(words)
    code += number
    order = np.argsort(code)
    code = code[order]
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    back = np.empty(len(code), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    del order
    code = code[new]
    left, right = (code // len(words)).astype(np.int32), (code % len(words)).astype(np.int32)
    del code
    keys = W.mix(words[left] * np.uint64(0x9FB21C651E98DF25) + words[right])
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    back = place[back]
    counted = np.zeros(len(keys), np.uint32)
    for k in range(0, len(row), _PIECE):
        used, n = np.unique(back[k : k + _PIECE][trains[row[k : k + _PIECE]]], return_counts=True)
        counted[used] += n.astype(np.uint32)
    return keys[order], counted, back, left[order], right[order]


def _numbers(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(v.as_py(), kind) for v in column]


def _total(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a bucket, their sums, each sent key's sum, and whether a sent key is the first of its kind."""
    k = np.concatenate(keys)
    unique, first, back = np.unique(k, return_index=True, return_inverse=True)
    total = np.bincount(back, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)
    owner = np.zeros(len(k), bool)
    owner[first] = True
    return unique, total, total[back], owner


_SENT = "bucket int, block int, words binary, word_n binary, pairs binary, pair_n binary"
_BACK = (
    "kind string, bucket int, block int, words binary, word_n binary, pair_n binary, owns binary, "
    "n long, rank int, word_types long, pair_types long, tokens long"
)


def _exchange(blocks: DataFrame, bits: int, rule: KatzRule) -> DataFrame:
    """Totals of all blocks: rows of kind ``back`` (per block and bucket) and ``stat`` (counts of counts)."""

    def ask(part: pa.Table) -> pa.Table:
        trains = part["trains"].to_numpy()
        words, number, row, word_n = _tokens(part["text"], trains)
        keys, pair_n, *_ = _pairs(words, number, row, trains)
        wcut, pcut = cuts(words, bits), cuts(keys, bits)
        block = part["block"][0].as_py()
        at = np.flatnonzero((np.diff(wcut) > 0) | (np.diff(pcut) > 0)).tolist()  # a block asks only buckets it has keys for
        return pa.table({
            "bucket": pa.array(at, pa.int32()),
            "block": pa.array([block] * len(at), pa.int32()),
            **{n: pa.array([v[c[b] : c[b + 1]].tobytes() for b in at], pa.binary())
               for n, v, c in (("words", words, wcut), ("word_n", word_n, wcut), ("pairs", keys, pcut), ("pair_n", pair_n, pcut))},
        })

    def answer(part: pa.Table) -> pa.Table:
        words, pairs = _numbers(part["words"], np.uint64), _numbers(part["pairs"], np.uint64)
        _, total, word_n, _ = _total(words, _numbers(part["word_n"], np.uint32))
        _, all_pairs, pair_n, owns = _total(pairs, _numbers(part["pair_n"], np.uint32))
        wcut, pcut = np.cumsum([0, *map(len, words)]), np.cumsum([0, *map(len, pairs)])
        # a count that the model does not keep travels as 0
        pair_n = np.where(pair_n >= rule.least_pairs, pair_n, 0).astype(np.uint32)
        rows = len(words)
        bucket = part["bucket"][0].as_py()
        back = {
            "kind": ["back"] * rows, "bucket": [bucket] * rows, "block": part["block"].to_pylist(),
            "words": part["words"].to_pylist(),
            "word_n": [word_n[a:b].astype(np.uint64).tobytes() for a, b in zip(wcut, wcut[1:])],
            "pair_n": [pair_n[a:b].tobytes() for a, b in zip(pcut, pcut[1:])],
            "owns": [np.packbits(owns[a:b]).tobytes() for a, b in zip(pcut, pcut[1:])],
        }
        known = total > 0
        ranks = np.arange(1, rule.trusted + 2)
        stat = {
            "kind": ["stat"] * len(ranks), "rank": ranks,
            "word_types": [(total == r).sum() for r in ranks], "pair_types": [(all_pairs == r).sum() for r in ranks],
            "n": [known.sum() if r == 1 else 0 for r in ranks], "tokens": [total.sum() if r == 1 else 0 for r in ranks],
        }
        schema = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.int32()), ("words", pa.binary()), ("word_n", pa.binary()),
                            ("pair_n", pa.binary()), ("owns", pa.binary()), ("n", pa.int64()), ("rank", pa.int32()),
                            ("word_types", pa.int64()), ("pair_types", pa.int64()), ("tokens", pa.int64())])
        tables = []
        for cols in (back, stat):
            n = len(cols["kind"])
            tables.append(pa.table([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema))
        return pa.concat_tables(tables)

    return blocks.groupBy("block").applyInArrow(ask, _SENT).groupBy("bucket").applyInArrow(answer, _BACK)


def _joined(back: pa.Table, column: str, kind: type, n_keys: int, edge: np.ndarray) -> np.ndarray:
    out = np.zeros(n_keys, kind)
    for bucket, raw in zip(back["bucket"].to_pylist(), back[column].to_pylist()):
        if raw is not None:
            out[edge[bucket] : edge[bucket + 1]] = np.frombuffer(raw, kind)
    return out


def score_documents(
    docs: DataFrame, trains: Column, rule: KatzRule = KatzRule(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, trains, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the text).

    ``trains`` says which rows the model learns from; all are scored. Tokens are the words (A-Z lower-cased) and one end. A null or empty text
    is its end alone. ``base_score`` adds 0.1 to every count, with one type for the unknown word; ``score`` is the backoff
    model's. Without training rows every token is the unknown word, whose probability is 1. A null ``trains`` counts as false; repeated rows
    count and are scored each; an empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(trains, F.lit(False)).alias("trains"),
    )
    n_blocks, bits = sizes(text_bytes(base))
    # rows that share an id, or have none, spread by their texts
    base = in_blocks(base, n_blocks, "doc_id", "text")
    totals = stored(_exchange(base, bits, rule), "totals")
    finished(spark)
    stats = [r.asDict() for r in totals.where("kind = 'stat'").groupBy("rank").agg(
        *[F.sum(c).alias(c) for c in ("word_types", "pair_types", "n", "tokens")]).collect()]
    tokens, types = sum(s["tokens"] for s in stats), sum(s["n"] for s in stats)
    model = WordModel.of(tokens, types, {s["rank"]: s["word_types"] for s in stats}, rule.trusted)
    factor = discounts({s["rank"]: s["pair_types"] for s in stats}, rule.trusted)
    begins = base.where("trains").count()
    contexts = _contexts(base, totals, bits, model, factor, begins)
    finished(spark)

    def score(part: pa.Table, back: pa.Table) -> pa.Table:
        names = ["doc_id", "trains", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not part.num_rows:
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.table([pa.array([], k) for k in kinds], names=names)
        learns = part["trains"].to_numpy()
        words, number, row, _ = _tokens(part["text"], learns)
        keys, _, pair_of, left, right = _pairs(words, number, row, learns)
        wcut, pcut = cuts(words, bits), cuts(keys, bits)
        word_n = _joined(back, "word_n", np.uint64, len(words), wcut).astype(np.int64)
        pair_n = _joined(back, "pair_n", np.uint32, len(keys), pcut).astype(np.int64)
        alpha = _joined(back, "alpha", np.float64, len(words), wcut)
        alpha[alpha == 0] = 1.0  # a context without kept pairs leaves all to the words
        context_n = word_n.copy()
        context_n[words == BEGIN] = begins
        full = alpha < 0  # nothing was left: one more token is thought of
        p_word = model.array(word_n)
        f = np.array([0.0, *[factor[r] for r in range(1, rule.trusted + 1)], 1.0])[np.minimum(pair_n, rule.trusted + 1)]
        seen = f * pair_n / np.maximum(1, context_n[left] + full[left])
        p_pair = np.log10(np.where(pair_n > 0, seen, np.abs(alpha[left]) * p_word[right]))
        del seen, f, left, right, pair_n, keys
        p_base = np.log10((word_n + 0.1) / (tokens + 0.1 * (types + 1)))
        rows = part.num_rows
        n_known, base_score, pair_score = np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
        edge = np.searchsorted(row, np.arange(rows + 1))
        for a, b in chunks(np.diff(edge), _PIECE):  # whole texts, some at a time
            mine, at = slice(edge[a], edge[b]), row[edge[a] : edge[b]] - a
            n_known[a:b] = np.bincount(at, weights=word_n[number[mine]] > 0, minlength=b - a)
            base_score[a:b] = np.bincount(at, weights=p_base[number[mine]], minlength=b - a)
            pair_score[a:b] = np.bincount(at, weights=p_pair[pair_of[mine]], minlength=b - a)
        return pa.table([
            part["doc_id"], part["trains"], pa.array(np.diff(edge).astype(np.int64)), pa.array(n_known),
            pa.array(np.full(rows, tokens, np.int64)), pa.array(base_score), pa.array(pair_score),
        ], names=names)

    # the words come again with their weights, so only the counts of pairs are read here
    counts = totals.where("kind = 'back'").select(
        "block", "bucket", "word_n", "pair_n", F.lit(None).cast("binary").alias("alpha"))
    weights = contexts.select("block", "bucket", F.lit(None).cast("binary").alias("word_n"), F.lit(None).cast("binary").alias("pair_n"), "alpha")
    back = counts.unionByName(weights)
    shape = "doc_id long, trains boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return base.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, shape)


def _contexts(base: DataFrame, totals: DataFrame, bits: int, model: WordModel, factor: dict[int, float], begins: int) -> DataFrame:
    """Backoff weights for the words of each block, in key order: (block, bucket, alpha).

    0 stands for a context without kept pairs; a negative weight for one that left nothing.
    """

    f = np.array([0.0, *factor.values(), 1.0])

    def kept(part: pa.Table, back: pa.Table) -> pa.Table:
        cols = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        if part.num_rows:
            learns = part["trains"].to_numpy()
            words, number, row, _ = _tokens(part["text"], learns)
            keys, _, _, left, right = _pairs(words, number, row, learns)
            edge = cuts(keys, bits)
            n = _joined(back, "pair_n", np.uint32, len(keys), edge).astype(np.int64)
            word_n = _joined(back, "word_n", np.uint64, len(words), cuts(words, bits)).astype(np.int64)
            owns = np.zeros(len(keys), bool)
            for bucket, raw in zip(back["bucket"].to_pylist(), back["owns"].to_pylist()):
                lo, hi = edge[bucket], edge[bucket + 1]
                owns[lo:hi] = np.unpackbits(np.frombuffer(raw, np.uint8), count=int(hi - lo)).astype(bool)
            at = np.flatnonzero(owns & (n > 0))
            taken = np.bincount(left[at], weights=f[np.minimum(n[at], len(f) - 1)] * n[at], minlength=len(words))
            covered = np.bincount(left[at], weights=model.array(word_n[right[at]]), minlength=len(words))
            own = np.unique(left[at])
            cols = words[own], taken[own], covered[own], word_n[own]
        kinds = pa.int64(), pa.float64(), pa.float64(), pa.int64()
        cols = cols[0].view(np.int64), *cols[1:]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["context", "taken", "covered", "n"])

    asked = totals.where("kind = 'back'").select("block", "bucket", "word_n", "pair_n", "owns")
    shares = base.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(kept, "context long, taken double, covered double, n long")
    sums = shares.groupBy("context").agg(F.sum("taken").alias("taken"), F.sum("covered").alias("covered"), F.max("n").alias("n"))
    begin = int(BEGIN.view(np.int64))
    n = F.when(F.col("context") == begin, begins).otherwise(F.col("n"))
    left = 1 - F.col("taken") / n
    rest = F.greatest(1 - F.col("covered"), F.lit(1e-300))
    alpha = F.when(left > 1e-9, left / rest).otherwise(-(1 - F.col("taken") / (n + 1)) / rest)
    bucket = F.shiftrightunsigned("context", 64 - bits).cast("int")
    weights = stored(sums.select("context", alpha.alias("alpha"), bucket.alias("bucket")), "weights")
    finished(base.sparkSession)

    def give(key: tuple, part: pa.Table, known: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary())], names=["block", "bucket", "alpha"])
        context = known["context"].to_numpy().view(np.uint64)
        order = np.argsort(context)
        context, alphas = context[order], known["alpha"].to_numpy()[order]
        out = []
        for words_ in _numbers(part["words"], np.uint64):
            value = np.zeros(len(words_))
            if len(context):
                at = np.minimum(np.searchsorted(context, words_), len(context) - 1)
                value = np.where(context[at] == words_, alphas[at], 0.0)
            out.append(value.tobytes())
        return pa.table([part["block"], part["bucket"], pa.array(out, pa.binary())], names=["block", "bucket", "alpha"])

    sent = totals.where("kind = 'back'").select("bucket", "block", "words")
    given = stored(sent.groupBy("bucket").cogroup(weights.groupBy("bucket")).applyInArrow(give, "block int, bucket int, alpha binary"), "alphas")
    drop_stored(weights)
    return given
