"""Spelling variants against all pairs of a small vocabulary."""

import collections
import re
import zlib

import numpy as np
import pytest

from passagemill.llm import spelling

SHAPE = "doc_id long, text string, word string, n string, key string, form string"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, one_in):
    low = {c: c + 32 for c in range(65, 91)}
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    meet = {w: [o for o in words if near(w, o)] for w in words}
    form = {w: min(found, key=lambda o: (-words[o], o)) for w, found in meet.items() if found}
    form = {w: f for w, f in form.items() if words[f] >= 10 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(meet[w]), words[form[w]] if w in form else None))
    return sorted(out)


def result(spark, rows, one_in=None, symbols=spelling.SYMBOLS):
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SHAPE)
    return sorted(tuple(r) for r in spelling.variants(docs, one_in, symbols).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize(("one_in", "symbols"), [(None, 12), (5, 12), (3, 1), (5, 3)])
def test_against_all_pairs(spark, one_in, symbols):
    rng = np.random.default_rng(4)
    stems = ["Letters", "lettres", "größere", "Grössere", "grossere", "ÀÉÎÕÜßÿ", "aaaaaaa", "aaaaaaaa", "abcdefgh", "bcdefghi"]
    rows = []
    for i in range(200):
        text = []
        for _ in range(int(rng.integers(1, 40))):
            w = stems[min(len(stems) - 1, int(rng.exponential(2)))]
            if rng.random() < 0.2:
                k = int(rng.integers(len(w)))
                w = w[:k] + "xyÄe"[int(rng.integers(4))] * int(rng.integers(0, 3)) + w[k + 1 :]
            text.append(w)
        rows.append((i, " ".join(text) + ". 12"))
    assert result(spark, rows, one_in, symbols) == brute(rows, one_in)


def test_chain_ties_nulls_and_empty_texts(spark):
    rows = [(1, "abcdefg " * 1000), (2, "abcdefgh " * 100), (3, "abcdefghi " * 10), (4, "bcdefghij " * 2), (None, "abcdefghij " * 2)]
    rows += [(5, None), (6, ""), (7, "short once_longenough"), (8, "zbcdefgh " * 1000 + "zzbcdefg zzbcdefg")]
    rows += [(9, "tiedone " * 50 + "tiedtwo " * 50 + "tiedxxo tiedxxo tiedqne tiedqne")] * 2
    assert result(spark, rows) == brute(rows, None)
    assert result(spark, rows, 31) == brute(rows, 31)


def test_empty_table(spark):
    assert result(spark, [], 31) == []


def test_long_words_and_repeated_rows(spark):
    long = "ab" * 40_000
    rows = [(1, long), (1, long), (2, long[:-1]), (3, f"{long[:-1]} {long[:-1]}"), (4, "x" * 300)]
    assert result(spark, rows, 31) == brute(rows, 31)


def test_a_full_bitmap_only_lets_more_through(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FILTER_BITS", 16)
    monkeypatch.setattr(spelling, "_SLICE_BITS", 14)
    rows = [(i, f"{w} {w} {w[:-1]}x {w[:-1]}x") for i, w in enumerate("".join(np.random.default_rng(i).choice(list("abcdefghij"), 7)) for i in range(300))]
    assert result(spark, rows) == brute(rows, None)
