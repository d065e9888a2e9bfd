"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, overlap check.

Test items, cut into parts of bounded length, are the indexed documents; every passage of
the training texts is a query. Scores are a share of the part's own score, so one threshold
fits all. Document statistics come from all items. The index is built in shards of
bounded size, each broadcast for one pass over the texts. A pass finds the passages that can
reach the threshold at all from the block maxima of their rarer terms, runs WAND with block maxima on
those, and verifies each retrieved part by the share of its question's and its answer's
word shingles that the passage's text holds.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import words as W
from passagemill.llm.shared import Lookup, id_text, stored

#: Words end at white space and at ASCII signs.
SIGNS = W.SPACE.copy()
SIGNS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


@dataclass(frozen=True)
class Bm25Rule:
    k1: float = 1.2
    b: float = 0.75
    #: Words of an indexed part at most, and of a passage; passages begin every ``part_words``.
    part_words: int = 64
    passage_words: int = 128
    #: Least share of a part's own score.
    threshold: float = 0.6
    #: Least share of the question's and of the answer's shingles found, and words of a shingle.
    overlap: float = 0.8
    shingle: int = 5
    #: Postings of an index block, parts of a bound that all passages are held against, bytes of items indexed for one pass.
    block: int = 32
    near_parts: int = 4
    shard_bytes: int = 8 << 20


def _words(texts: pa.Array) -> Iterator[tuple]:
    """For runs of texts: rows, word hashes, text of each word, and where each text's words begin."""
    low = pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)
    for a, b, buf, off in W.parts(low):
        starts, ends, doc = W.spans(buf, off, SIGNS)
        yield a, b, W.span_hash(W.prefix(buf), starts, ends), np.searchsorted(doc, np.arange(b - a + 1))


def _halves(text: str) -> tuple[str, str]:
    """Question and answer: up to the last question mark or, without one, the last inner sentence end; else two halves by words."""
    body = text.rstrip()
    cut = body.rfind("?", 0, len(body) - 1)
    if cut < 0:
        cut = max(body.rfind(s, 0, len(body) - 1) for s in (". ", ".\n", "! ", "\n"))
    if cut >= 0:
        head, tail = body[: cut + 1], body[cut + 1 :]
        if len(tail.split()) >= 5 and len(head.split()) >= 5:
            return head, tail
    parts = body.split()
    return " ".join(parts[: len(parts) // 2]), " ".join(parts[len(parts) // 2 :])


class Index:
    """Postings of item parts with block maxima; shares of the own score as impacts."""

    def __init__(self, items: list[tuple[int, str]], rule: Bm25Rule, df: dict[int, int], n_parts: int, mean: float):
        self.rule = rule
        self.items: list[int] = []
        self.checks: list[tuple] = []
        posts: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for item, hashes, check in _parts_of(items, rule):
            part = len(self.items)
            tf = Counter(hashes.tolist())
            norm = rule.k1 * (1 - rule.b + rule.b * len(hashes) / mean)
            weight = {t: np.log(1 + (n_parts - df[t] + 0.5) / (df[t] + 0.5)) * n * (rule.k1 + 1) / (n + norm) for t, n in tf.items()}
            total = sum(weight.values())
            self.items.append(item)
            self.checks.append(check)
            for t, w in weight.items():
                posts[t].append((part, w / total))
        self.terms = np.array(sorted(posts), np.uint64)
        self.parts = [np.array([p for p, _ in posts[t]], np.int64) for t in self.terms.tolist()]
        self.impact = [np.array([w for _, w in posts[t]]) for t in self.terms.tolist()]
        self.most = np.array([i.max() for i in self.impact]) if posts else np.zeros(0)
        step = rule.block
        self.block_most = [np.maximum.reduceat(i, np.arange(0, len(i), step)) for i in self.impact]
        self.block_last = [p[np.minimum(np.arange(step, len(p) + step, step), len(p)) - 1] for p in self.parts]

    def common(self, seen: np.ndarray) -> np.ndarray:
        """Terms so frequent in the texts (by ``seen`` counts) that, together, they never give half the threshold to any part.

        A passage that reaches the threshold must get the rest from the other terms.
        """
        total = np.zeros(len(self.items))
        out = np.zeros(len(self.terms), bool)
        for t in np.argsort(-seen, kind="stable"):
            if not seen[t]:
                break
            total[self.parts[t]] += self.impact[t]
            if total[self.parts[t]].max() > self.rule.threshold / 2:
                total[self.parts[t]] -= self.impact[t]
            else:
                out[t] = True
        return out

    def bounds(self, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Block maxima by term (offsets, block of parts, maximum), and what each block still needs beside the common terms."""
        size = self.rule.near_parts
        n = -(-len(self.items) // size)
        reach = np.zeros(len(self.items))
        for t in np.flatnonzero(common):
            reach[self.parts[t]] += self.impact[t]
        need = self.rule.threshold - np.maximum.reduceat(reach, np.arange(0, len(reach), size))
        offsets, blocks, most = [0], [], []
        for parts, impact in zip(self.parts, self.impact):
            own = parts // size
            first = np.flatnonzero(np.diff(own, prepend=-1))
            blocks.append(own[first])
            most.append(np.maximum.reduceat(impact, first))
            offsets.append(offsets[-1] + len(first))
        assert need.shape == (n,)
        return np.array(offsets), np.concatenate(blocks), np.concatenate(most), need

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All parts whose score for this set of terms reaches the threshold, by WAND with block maxima."""
        at = {t: 0 for t in terms.tolist()}
        heap = [(int(self.parts[t][0]), t) for t in at]
        heapq.heapify(heap)
        lists = sorted(heap)
        out = []
        eps = threshold - 1e-12
        while lists:
            bound, pivot = 0.0, -1
            for k, (_, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= eps:
                    pivot = k
                    break
            if pivot < 0:
                break
            part = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == part:
                pivot += 1
            here = [t for _, t in lists[: pivot + 1]]
            local, last = 0.0, None
            for t in here:
                block = int(np.searchsorted(self.block_last[t], part))
                if block < len(self.block_last[t]):
                    local += self.block_most[t][block]
                    end = int(self.block_last[t][block])
                    last = end if last is None or end < last else last
            if local < eps:
                ahead = last + 1
                if pivot + 1 < len(lists):
                    ahead = min(ahead, lists[pivot + 1][0])
                target = max(ahead, part + 1)
            elif lists[0][0] == part:
                score = sum(float(self.impact[t][at[t]]) for t in here)
                if score >= eps:
                    out.append((part, score))
                target = part + 1
            else:
                target = part
            moved = []
            for p, t in lists[: pivot + 1]:
                if p < target:
                    at[t] += int(np.searchsorted(self.parts[t][at[t] :], target))
                    if at[t] == len(self.parts[t]):
                        continue
                    p = int(self.parts[t][at[t]])
                moved.append((p, t))
            lists = sorted(moved + lists[pivot + 1 :])
        return out


def _shingles(hashes: np.ndarray, size: int) -> tuple[int, np.ndarray]:
    """Number of words, and the distinct shingles (the whole where it has fewer words)."""
    if not len(hashes):
        return 0, np.zeros(0, np.uint64)
    return len(hashes), np.unique(W.window_hash(hashes, min(size, len(hashes))))


def _parts_of(items: list[tuple[int, str]], rule: Bm25Rule) -> Iterator[tuple]:
    """(item, word hashes, shingles of question and answer) of each part; items without words have none."""
    halves = [_halves(t or "") for _, t in items]
    both = pa.array([h for pair in halves for h in pair], pa.string())
    found: list[np.ndarray] = []
    for a, b, hashes, bounds in _words(both):
        found += [hashes[bounds[k] : bounds[k + 1]] for k in range(b - a)]
    for (item, _), q, a in zip(items, found[::2], found[1::2]):
        whole = np.concatenate([q, a])
        n = -(-len(whole) // rule.part_words)
        for cut in np.array_split(np.arange(len(whole)), n) if n else []:
            lo, hi = cut[0], cut[-1] + 1
            split = min(max(len(q), lo), hi)
            if split - lo < rule.shingle or hi - split < rule.shingle:  # a long item's part lies in one half
                split = (lo + hi) // 2
            yield item, whole[lo:hi], (_shingles(whole[lo:split], rule.shingle), _shingles(whole[split:hi], rule.shingle))


def _shares(text: np.ndarray, check: tuple, size: int) -> tuple[float, float]:
    """Share of the shingles of question and of answer that the text holds; a half without words is held by any."""
    out = []
    for words, part in check:
        own = W.window_hash(text, min(size, words)) if words else part
        out.append(float(np.isin(part, own).mean()) if words else 1.0)
    return out[0], out[1]


def contaminated(
    docs: DataFrame, items: DataFrame, rule: Bm25Rule = Bm25Rule(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs`` and test item found in it: doc_id, item_id, score, question_share, answer_share.

    ``items`` has (item_id, text). An item counts as found when some passage scores at least
    ``rule.threshold`` of the own score of one of its parts and holds at least ``rule.overlap`` of the shingles of both that
    part's question and its answer. Best values per row and item; all are found, ties included.
    Null and empty texts on either side match nothing, an empty table on either side gives an empty result; repeated rows of
    ``docs`` give repeated rows, repeated items one (the best). A null doc_id is kept, an item without an id is left out. Other columns
    are not read. Items are indexed in shards of ``rule.shard_bytes``, so an index sent to the tasks has a bound.
    """
    spark = docs.sparkSession
    given = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    given = given.where("item_id is not null and text is not null")
    n_bytes = given.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
    shards = int(-(-n_bytes // rule.shard_bytes)) or 1
    base = id_text(docs, id_col, text_col).where("text is not null")
    stats = _statistics(given, rule)
    out = None
    for shard in range(shards):
        rows = [tuple(r) for r in given.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard).orderBy("item_id", "text").collect()]
        index = _index(rows, rule, stats)
        found = _pass(base, index, rule)
        out = found if out is None else out.unionByName(found)
    return out


def _statistics(items: DataFrame, rule: Bm25Rule) -> DataFrame:
    """Per term of the items: in how many parts it stands. The row without a term has the number of parts and of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            parts = [h for _, h, _ in _parts_of(rows, rule)]
            terms = np.concatenate([np.unique(p) for p in parts]) if parts else np.zeros(0, np.uint64)
            t, n = np.unique(terms, return_counts=True)
            t = pa.array([*t.view(np.int64).tolist(), None], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [t, pa.array([*n.tolist(), len(parts)], pa.int64()), pa.array([*[0] * len(n), sum(map(len, parts))], pa.int64())],
                ["term", "n", "words"],
            )

    counted = items.mapInArrow(run, "term long, n long, words long")
    return stored(counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "terms")


def _index(rows: list[tuple[int, str]], rule: Bm25Rule, stats: DataFrame) -> Index:
    """The index of one shard; only the statistics of its own terms come to the driver."""
    spark = stats.sparkSession
    own = sorted({t for _, h, _ in _parts_of(rows, rule) for t in h.view(np.int64).tolist()})
    total = stats.where("term is null").first()
    terms = spark.createDataFrame(pa.table({"term": pa.array(own, pa.int64())}))
    df = {int(np.int64(r["term"]).view(np.uint64)): r["n"] for r in stats.join(F.broadcast(terms), "term").collect()}
    n_parts, words = (total["n"], total["words"]) if total else (0, 0)
    return Index(rows, rule, df, n_parts, words / n_parts if n_parts else 1.0)


def _pass(docs: DataFrame, index: Index, rule: Bm25Rule) -> DataFrame:
    """One shard's index against every passage."""
    schema = "doc_id long, item_id long, score double, question_share double, answer_share double"
    if not len(index.terms):
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = shared.value
        find = Lookup(own.terms, np.arange(len(own.terms), dtype=np.int32), missing=(-1,))
        common = None
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0)
            for a, b, hashes, bounds in _words(batch.column(1)):
                (term,) = find(hashes)
                at = np.flatnonzero(term >= 0)
                if common is None:
                    # which terms are common is a matter of speed alone: the first run of texts decides
                    common = own.common(np.bincount(term[at], minlength=len(own.terms)))
                    limits = own.bounds(common)
                first, doc = _passages(bounds, rule)
                last = np.minimum(first + rule.passage_words, bounds[doc + 1])
                reached = _reaching(at[~common[term[at]]], term, first, last, limits, len(own.terms))
                best: dict[tuple[int, int], tuple] = {}
                for k in reached:
                    lo, hi = first[k], last[k]
                    terms = np.unique(term[lo:hi])
                    for part, score in own.search(terms[terms >= 0], rule.threshold):
                        q, s = _shares(hashes[lo:hi], own.checks[part], rule.shingle)
                        if min(q, s) >= rule.overlap:
                            key = (int(doc[k]), own.items[part])
                            best[key] = max(best.get(key, (0.0,)), (score, q, s))
                out += [(ids[a + d].as_py(), item, *v) for (d, item), v in sorted(best.items())]
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            names = ["doc_id", "item_id", "score", "question_share", "answer_share"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return docs.mapInArrow(run, schema)


def _reaching(
    rare: np.ndarray, term: np.ndarray, first: np.ndarray, last: np.ndarray, limits: tuple, n_terms: int
) -> np.ndarray:
    """Passages some block of parts of which can reach the threshold: block maxima summed over each passage's own terms."""
    offsets, blocks, most, need = limits
    if (need <= 1e-9).any():
        return np.arange(len(first))
    out = []
    lo, hi = np.searchsorted(rare, first), np.searchsorted(rare, last)
    for start in range(0, len(first), 4096):
        n = (hi - lo)[start : start + 4096]
        passage = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(passage)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[start : start + 4096], n)
        pairs = np.unique(passage * n_terms + term[rare[place]])
        passage, t = pairs // n_terms, pairs % n_terms
        width = offsets[t + 1] - offsets[t]
        at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(offsets[t], width)
        cell = np.repeat(passage, width) * len(need) + blocks[at]
        cells, back = np.unique(cell, return_inverse=True)
        total = np.bincount(back, weights=most[at], minlength=len(cells))
        out.append(start + np.unique(cells[total >= need[cells % len(need)] - 1e-9] // len(need)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _passages(bounds: np.ndarray, rule: Bm25Rule) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of every passage; the last passage of a text ends with it."""
    sizes = np.diff(bounds)
    step = rule.passage_words - rule.part_words
    n = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - rule.passage_words) // step)), 0)
    doc = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return bounds[doc] + nth * step, doc


def clean_documents(docs: DataFrame, items: DataFrame, rule: Bm25Rule = Bm25Rule()) -> DataFrame:
    """The rows of ``docs`` in which no test item is found; all columns stay."""
    bad = contaminated(docs, items, rule).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col("__bad")), "left_anti")
