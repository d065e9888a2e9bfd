"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters by an embedding of itself, the mean embedding of its character n-grams, and
how much oftener it and its n-grams stood in toxic than in other training texts. Two gated
recurrent networks read each window of words from either side; attention weighs their states
into one value per window. All overlapping windows of a text are read, and its score comes
from the highest one, so a long text is judged by its worst place. Labels are given for
whole texts only: each round of training takes a toxic text's highest window as toxic and the
highest and some random windows of the others as not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm import words as W
from passagemill.llm.shared import chunks, finished

_BITS = 20  # of the numbers that words and n-grams hash to
_GRAMS = (3, 4, 5, 6)  # bytes, with a mark before and after the word
_EMB, _HIDDEN, _POOL = 8, 8, 8
_PIECE = 1 << 13  # words whose n-grams are looked up at once
_RUN = 1 << 19  # bytes of texts whose words are found at once


@dataclass(frozen=True)
class ToxicityRule:
    window: int = 32
    step: int = 24
    #: The training sample: labelled toxic and other texts at most; longer texts are not taken.
    toxic_docs: int = 1500
    other_docs: int = 3000
    longest_bytes: int = 20_000
    #: Texts that a word or n-gram must stand in to have an embedding of its own.
    least_texts: int = 30
    rounds: int = 4
    #: Every so many-th text of the sample sets the calibration and trains nothing.
    calibrates: int = 5
    seed: int = 7


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of every range, in a row."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


class Words:
    """Distinct words of some texts: their numbers and those of their n-grams; the words of each text."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        # a few texts at a time, so that only a number stays of each word that repeats
        hashes, starts, sizes, numbers, bounds, n_words = [], [], [], [], [], 0
        for a, b in chunks(np.diff(off), _RUN):
            part = W.LOWER[buf[off[a] : off[b]]]
            start, end, doc = W.spans(part, off[a : b + 1] - off[a])
            bounds.append(np.searchsorted(doc, np.arange(b - a)) + n_words)
            n_words += len(start)
            unique, first, number = np.unique(W.span_hash(W.prefix(part), start, end), return_index=True, return_inverse=True)
            hashes.append(unique)
            starts.append(start[first] + off[a])
            sizes.append((end - start)[first])
            numbers.append(number.astype(np.int32))
        self.bounds = np.concatenate([*bounds, [n_words]]).astype(np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *hashes])
        unique, first, number = np.unique(every, return_index=True, return_inverse=True)
        number = number.astype(np.int32)
        before = np.cumsum([0, *map(len, hashes)])
        self.number = np.concatenate([np.zeros(0, np.int32), *[number[k : k + len(h)][n] for k, h, n in zip(before, hashes, numbers)]])
        self.row = (unique >> np.uint64(64 - _BITS)).astype(np.int64)
        start, size = (np.concatenate([np.zeros(0, np.int64), *v])[first] for v in (starts, sizes))
        counts = [np.maximum(size + 2 - n + 1, 0) for n in _GRAMS]
        self.n_grams = sum(counts)
        self.begin = np.cumsum(self.n_grams) - self.n_grams
        self.gram = np.empty(int(self.n_grams.sum()), np.int32)
        for k in range(0, len(size), _PIECE):
            mine = slice(k, k + _PIECE)
            # each word between two marks
            wide = size[mine] + 2
            at = np.cumsum(wide) - wide
            marked = np.ones(int(wide.sum()), np.uint8)
            marked[_expand(at + 1, size[mine])] = W.LOWER[buf[_expand(start[mine], size[mine])]]
            marked[at + wide - 1] = 2
            pre = W.prefix(marked)
            place = self.begin[mine].copy()
            for n, count in zip(_GRAMS, counts):
                s = _expand(at, count[mine])
                self.gram[_expand(place, count[mine])] = W.span_hash(pre, s, s + n) >> np.uint64(64 - _BITS)
                place += count[mine]

    def __len__(self) -> int:
        return len(self.row)

    def windows(self, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of every window (len(self) where there is none), and the text of each; a text has one at least."""
        n_words = np.diff(self.bounds)
        n = 1 + np.maximum(0, -(-(n_words - size) // step))
        doc = np.repeat(np.arange(len(n_words)), n)
        first = self.bounds[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * step
        out = np.empty((len(doc), size), np.int32)
        number = np.append(self.number, np.int32(len(self)))
        for k in range(0, len(doc), _PIECE):
            mine = slice(k, k + _PIECE)
            at = first[mine, None] + np.arange(size)
            out[mine] = number[np.where(at < self.bounds[doc[mine] + 1][:, None], at, len(self.number))]
        return out, doc


def _init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = 2 * _EMB + 2, _HIDDEN

    def some(*shape: int, by: float = 0.3) -> np.ndarray:
        return rng.normal(0, by, shape).astype(np.float32)

    p = {}
    for side in "fb":
        p |= {f"W{side}": some(d, 3 * h), f"U{side}": some(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
    return p | {"A": some(2 * h, _POOL), "a": np.zeros(_POOL, np.float32), "v": some(_POOL), "o": some(2 * h), "k": np.zeros(1, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters, word odds, and the calibration of a text's highest window."""

    def __init__(self, rule: ToxicityRule):
        self.rule = rule
        self.p = _init(np.random.default_rng(rule.seed))
        # row 0 of an embedding table is that of all words or n-grams without an own one, and stays zero
        self.slot = {name: np.zeros(1 << _BITS, np.int32) for name in ("word", "char")}
        self.p |= {name: np.zeros((1, _EMB), np.float32) for name in self.slot}
        self.word_odds = np.zeros(1 << _BITS, np.float32)
        self.gram_odds = np.zeros(1 << _BITS, np.float32)
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, words: Words, used: np.ndarray | None = None) -> np.ndarray:
        """One row per distinct word, or per word of ``used``."""
        used = np.arange(len(words)) if used is None else used
        if len(used) > _PIECE:
            return np.concatenate([self.inputs(words, used[k : k + _PIECE]) for k in range(0, len(used), _PIECE)])
        x = np.zeros((len(used), 2 * _EMB + 2), np.float32)
        if not len(used):
            return x
        x[:, :_EMB] = self.p["word"][self.slot["word"][words.row[used]]]
        n = words.n_grams[used]
        have = n > 0
        gram = words.gram[_expand(words.begin[used], n)]
        begin = (np.cumsum(n) - n)[have]
        if len(begin):
            slot = self.slot["char"][gram]
            for a in range(_EMB):
                x[have, _EMB + a] = np.add.reduceat(self.p["char"][:, a][slot], begin) / n[have]
            x[have, -1] = np.maximum.reduceat(self.gram_odds[gram], begin)
        x[:, -2] = self.word_odds[words.row[used]]
        return x

    def _read(self, g: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (rows, places, hidden) of one direction from the words' gate inputs."""
        h_size, (rows, places) = _HIDDEN, mask.shape
        u = self.p[f"U{side}"]
        h = np.zeros((rows, h_size), np.float32)
        out = np.empty((rows, places, h_size), np.float32)
        steps: list = [None] * places
        for t in range(places) if side == "f" else range(places - 1, -1, -1):
            hu = h @ u
            gt = g[:, t]
            zr = _sigmoid(gt[:, : 2 * h_size] + hu[:, : 2 * h_size])
            z, r = zr[:, :h_size], zr[:, h_size:]
            n = np.tanh(gt[:, 2 * h_size :] + r * hu[:, 2 * h_size :])
            new = n + z * (h - n)
            m = mask[:, t, None]
            if keep:
                steps[t] = (h, z, r, n, hu[:, 2 * h_size :])
            h = new if m.all() else np.where(m, new, h)
            out[:, t] = h
        return out, steps

    def forward(self, gates: dict[str, np.ndarray], at: np.ndarray, keep: bool = False) -> tuple:
        """A logit per window; ``gates`` has the gate inputs of each word and, last, of no word."""
        mask = at < len(gates["f"]) - 1
        states, steps = [], {}
        for side in "fb":
            s, steps[side] = self._read(gates[side][at], mask, side, keep)
            states.append(s)
        s = np.concatenate(states, axis=2)
        u = np.tanh(s @ self.p["A"] + self.p["a"])
        e = np.where(mask, u @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        w = (e / e.sum(axis=1, keepdims=True)).astype(np.float32)
        pooled = np.einsum("bt,bth->bh", w, s)
        return pooled @ self.p["o"] + self.p["k"][0], (mask, s, steps, u, w, pooled)

    def gates(self, words: Words) -> dict[str, np.ndarray]:
        """Gate inputs of every distinct word and, last, of no word."""
        out = {side: np.empty((len(words) + 1, 3 * _HIDDEN), np.float32) for side in "fb"}
        for k in range(0, len(words), _PIECE):
            used = np.arange(k, min(k + _PIECE, len(words)))
            x = self.inputs(words, used)
            for side, g in out.items():
                g[used] = x @ self.p[f"W{side}"] + self.p[f"c{side}"]
        for side, g in out.items():
            g[-1] = self.p[f"c{side}"]
        return out

    def logits(self, words: Words, at: np.ndarray, batch: int = 512) -> np.ndarray:
        gates = self.gates(words)
        return np.concatenate([self.forward(gates, at[k : k + batch])[0] for k in range(0, len(at), batch)] or [np.zeros(0)])

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The score of every text: its highest window, calibrated."""
        words = Words(buf, off)
        at, doc = words.windows(self.rule.window, self.rule.step)
        top = np.maximum.reduceat(self.logits(words, at), np.searchsorted(doc, np.arange(len(off) - 1)))
        return 1 / (1 + np.exp(-(self.slope * top.astype(np.float64) + self.shift)))

    def gradients(self, words: Words, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the weighted log loss of some windows."""
        p, h_size = self.p, _HIDDEN
        used, place = np.unique(at, return_inverse=True)
        none = used == len(words)
        x = np.zeros((len(used), 2 * _EMB + 2), self.p["o"].dtype)
        x[~none] = self.inputs(words, used[~none])
        at = place.reshape(at.shape)
        gates = {side: x @ p[f"W{side}"] + p[f"c{side}"] for side in "fb"}
        if not none.any():
            gates = {s: np.concatenate([g, np.zeros((1, g.shape[1]), np.float32)]) for s, g in gates.items()}
        logit, (mask, s, steps, u, w, pooled) = self.forward(gates, at, keep=True)
        prob = _sigmoid(logit)
        loss = float(-(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum())
        dl = ((prob - y) * weight).astype(np.float32)
        grad = {"o": pooled.T @ dl, "k": dl.sum(keepdims=True)}
        d_pool = dl[:, None] * p["o"]
        dw = np.einsum("bh,bth->bt", d_pool, s)
        ds = w[:, :, None] * d_pool[:, None, :]
        de = w * (dw - (w * dw).sum(axis=1, keepdims=True))
        grad["v"] = np.einsum("bt,bta->a", de, u)
        du = de[:, :, None] * p["v"] * (1 - u * u)
        grad["A"], grad["a"] = np.einsum("bth,bta->ha", s, du), du.sum(axis=(0, 1))
        ds += du @ p["A"].T
        dx = np.zeros_like(x)
        places = at.shape[1]
        for i, side in enumerate("fb"):
            wu = p[f"U{side}"]
            d_out = ds[:, :, i * h_size : (i + 1) * h_size]
            dg = np.zeros((*at.shape, 3 * h_size), np.float32)
            d_u = np.zeros_like(wu)
            dh = np.zeros((len(at), h_size), np.float32)
            for t in range(places - 1, -1, -1) if side == "f" else range(places):
                h, z, r, n, hn = steps[side][t]
                m = mask[:, t, None]
                dh = dh + d_out[:, t]
                d_new = np.where(m, dh, 0)
                dz = d_new * (h - n) * z * (1 - z)
                dn = d_new * (1 - z) * (1 - n * n)
                dr = dn * hn * r * (1 - r)
                dg[:, t] = np.concatenate([dz, dr, dn], axis=1)
                d_hu = np.concatenate([dz, dr, dn * r], axis=1)
                d_u += h.T @ d_hu
                dh = np.where(m, d_new * z, dh) + d_hu @ wu.T
            by_word = np.zeros((len(used), 3 * h_size), np.float32)
            np.add.at(by_word, at.ravel(), dg.reshape(-1, 3 * h_size))
            grad[f"U{side}"], grad[f"W{side}"], grad[f"c{side}"] = d_u, x.T @ by_word, by_word.sum(axis=0)
            dx += by_word @ p[f"W{side}"].T
        real = used[~none]
        dx = dx[~none]
        grad["word"] = (self.slot["word"][words.row[real]], dx[:, :_EMB])
        n = words.n_grams[real]
        gram = words.gram[_expand(words.begin[real], n)]
        grad["char"] = (self.slot["char"][gram], np.repeat(dx[:, _EMB : 2 * _EMB] / np.maximum(n, 1)[:, None], n, axis=0))
        return grad, loss


def _texts_with(words: Words, kind: np.ndarray, n_kinds: int) -> dict[str, np.ndarray]:
    """In how many texts of each kind every number of a word or n-gram stands; a few texts at a time."""
    out = {name: np.zeros((n_kinds, 1 << _BITS), np.int32) for name in ("word", "char")}
    for a in range(0, len(kind), 20):
        b = min(a + 20, len(kind))
        lo, hi = words.bounds[a], words.bounds[b]
        doc = np.repeat(np.arange(b - a), np.diff(words.bounds[a : b + 1]))
        pairs = np.unique(doc * np.int64(max(1, len(words))) + words.number[lo:hi])
        doc, word = pairs // max(1, len(words)), pairs % max(1, len(words))
        n = words.n_grams[word]
        gram = words.gram[_expand(words.begin[word], n)]
        for name, d, row in (("word", doc, words.row[word]), ("char", np.repeat(doc, n), gram)):
            own = np.unique(d << _BITS | row)
            for k in range(n_kinds):
                mine = own[kind[a + (own >> _BITS)] == k] & ((1 << _BITS) - 1)
                out[name][k] += np.bincount(mine, minlength=1 << _BITS).astype(np.int32)
    return out


def _odds(yes: np.ndarray, no: np.ndarray, n_yes: int, n_no: int) -> np.ndarray:
    """How much oftener each number stands in toxic texts: a log ratio less two standard errors, at least 0."""
    ratio = np.log((yes + 0.5) / (n_yes + 1)) - np.log((no + 0.5) / (n_no + 1))
    return np.maximum(0, (ratio - 2 * np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))) / 2).astype(np.float32)


def train(texts: list[str] | pa.Array | pa.ChunkedArray, toxic: np.ndarray, share: float, rule: ToxicityRule = ToxicityRule()) -> Network:
    """A network from a bounded sample; ``share`` is the share of toxic texts among all that are labelled.

    While a text trains the network, its words' odds come from the other half of the texts. Embeddings
    of words and n-grams that stand in few texts are one and zero. With labels of one kind only, the score is the share for every text.
    """
    net = Network(rule)
    prior = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    toxic = np.asarray(toxic, np.float64)
    if not 0 < toxic.sum() < len(toxic):
        net.slope, net.shift = 0.0, float(prior)
        return net
    rng = np.random.default_rng(rule.seed)
    words = Words(*W.flat(pa.array(texts, pa.string()) if isinstance(texts, list) else texts))
    at, doc = words.windows(rule.window, rule.step)
    begin = np.searchsorted(doc, np.arange(len(texts)))
    half, aside = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for kind in (0, 1):
        own = np.flatnonzero(toxic == kind)
        half[own[::2]] = 1
        aside[own[:: rule.calibrates]] = True
    kind = half * 2 + toxic.astype(np.int64)
    seen, n = _texts_with(words, kind, 4), np.bincount(kind, minlength=4)
    for name, counts in seen.items():
        frequent = np.flatnonzero(counts.sum(axis=0) >= rule.least_texts)
        net.slot[name][frequent] = np.arange(1, len(frequent) + 1)
        net.p[name] = np.append(net.p[name], rng.normal(0, 0.05, (len(frequent), _EMB)).astype(np.float32), axis=0)
    # a half's odds are counted in the other half
    odds = [[_odds(c[o + 1], c[o], n[o + 1], n[o]) for c in seen.values()] for o in (2, 0)]
    every = [_odds(c[1] + c[3], c[0] + c[2], n[1] + n[3], n[0] + n[2]) for c in seen.values()]
    del seen
    score = np.zeros(len(at))

    def by_half(work) -> None:
        for h in (0, 1):
            net.word_odds, net.gram_odds = odds[h]
            work(half[doc] == h)

    def start(mine: np.ndarray) -> None:
        score[mine] = np.append(net.inputs(words)[:, -2:].max(axis=1), 0)[at[mine]].max(axis=1)

    def read(mine: np.ndarray) -> None:
        score[mine] = net.logits(words, at[mine])

    by_half(start)
    squares: dict[str, np.ndarray] = {k: np.full_like(v, 1e-6) for k, v in net.p.items()}
    weight_of = np.where(toxic == 1, (toxic == 0).sum() / toxic.sum(), 1.0)
    for _ in range(rule.rounds):
        top = np.lexsort((-score, doc))[begin]
        some = rng.integers(0, len(at), len(texts))
        picked = np.concatenate([top, some[toxic[doc[some]] == 0]])
        picked = picked[~aside[doc[picked]]]
        rng.shuffle(picked)
        parts = [picked[half[doc[picked]] == h][k : k + 256] for h in (0, 1) for k in range(0, len(picked), 256)]
        for k in rng.permutation(len(parts)):
            part = parts[k]
            if not len(part):
                continue
            net.word_odds, net.gram_odds = odds[half[doc[part[0]]]]
            y = toxic[doc[part]].astype(np.float32)
            weight = (weight_of[doc[part]] / len(part)).astype(np.float32)
            for name, g in net.gradients(words, at[part], y, weight)[0].items():
                if isinstance(g, tuple):
                    use = g[0] > 0
                    rows, place = np.unique(g[0][use], return_inverse=True)
                    total = np.zeros((len(rows), g[1].shape[1]), np.float32)
                    np.add.at(total, place, g[1][use])
                    squares[name][rows] += total * total
                    net.p[name][rows] -= 0.01 * total / np.sqrt(squares[name][rows])
                else:
                    squares[name] += g * g
                    net.p[name] -= 0.05 * g / np.sqrt(squares[name])
        by_half(read)
    net.word_odds, net.gram_odds = every
    if not 0 < toxic[aside].sum() < aside.sum():
        aside[:] = True
    _calibrate(net, np.maximum.reduceat(score, begin)[aside], toxic[aside], share)
    return net


def _calibrate(net: Network, top: np.ndarray, toxic: np.ndarray, share: float) -> None:
    """A logistic curve over the highest windows, weighted to the labelled share, a little smoothed."""
    weight = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    goal = np.where(toxic == 1, 0.99, 0.01)
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-(a * top + b)))
        g = np.array([(weight * (q - goal) * top).sum() + 1e-3 * (a - 1), (weight * (q - goal)).sum()])
        v = weight * q * (1 - q)
        hess = np.array([[(v * top * top).sum() + 1e-3, (v * top).sum()], [(v * top).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    net.slope, net.shift = float(max(a, 1e-3)), float(b)


def fit(docs: DataFrame, labels: DataFrame, learns: Column, rule: ToxicityRule = ToxicityRule()) -> Network:
    """Train on a sample of the labelled rows for whose doc_id ``learns`` holds; the sample has a fixed bound."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(learns & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fitting = text.where(F.octet_length("text").between(1, rule.longest_bytes)).select("doc_id").distinct()
    marked = marked.join(fitting, "doc_id")
    parts = [
        marked.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for kind, most in ((1, rule.toxic_docs), (0, rule.other_docs))
    ]
    chosen = parts[0].unionByName(parts[1])
    share = labels.where(learns & F.col("toxic").isin(0, 1)).agg(F.avg("toxic").alias("s")).first()["s"]
    rows = (
        text.where(F.octet_length("text").between(1, rule.longest_bytes))
        .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        .toArrow().sort_by("doc_id")
    )
    finished(docs.sparkSession)  # the network trains beside the driver's JVM, which gives back what its queries left
    return train(rows["text"], rows["toxic"].to_numpy(), 0.0 if share is None else share, rule)


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1) and predicted (1 from 0.5 on), from the text alone.

    All windows of whole texts are read. A null, empty or blank text is one window without words.
    Repeated rows get equal scores; an empty table gives an empty one; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = [own.scores(buf, off) for _, _, buf, off in W.parts(batch.column(1), 1 << 20)]
            score = np.concatenate(out) if out else np.zeros(0)
            cols = [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "predicted"])

    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id long, score double, predicted int")
