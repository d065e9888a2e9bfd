"""Sketches against plain sets."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest

from passagemill.llm import iblt

SHAPE = "doc_id long, text string, part int, edge string, hash string"


def items(text):
    found = iblt.Items(pa.array([text]))
    return set(found.keys.tolist())


def alike(a, b):
    x, y = items(a), items(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def brute(rows):
    """By descending id, null ids last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), alike(text, edited), alike(text, after)))
    return sorted(out, key=repr)


def result(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SHAPE)
    found = iblt.against_next(docs).collect()
    return found, sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in found), key=repr)


TEXTS = ["", None, "One. Two. Three.", "Ünï\ncödé \U0001f600 end.\n\nlast", "a" * 5000, "same line\n" * 300, "x y " * 20_000, "No stop at all"]


def test_every_row_against_plain_sets(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 400)))) + ". " + "New line\n" * (i % 4)) for i in range(120)]
    rows += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "without an id")]
    found, got = result(spark, rows)
    want = brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want])
    texts = dict(rows)
    by_text = collections.defaultdict(set)
    for r in found:
        by_text[texts[r["doc_id"]] or ""].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_long_text_whole(spark):
    rows = [(1, "A long text. " * 100_000 + "end"), (2, " ".join(f"s{i}." for i in range(60_000)))]
    _, got = result(spark, rows)
    want = brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3:] for g in got], [w[3:] for w in want])


@pytest.mark.parametrize("rows", [[], [(7, "alone here. Twice.")], [(7, None)], [(1, "a. b. c."), (2, "a. b. c.")]])
def test_few_rows(spark, rows):
    assert result(spark, rows)[1] == brute(rows)


def test_repeated_rows_and_ids_keep_their_number(spark):
    rows = [(5, "same. text.")] * 40 + [(5, "other. text.")] + [(9, "first.")]
    found, got = result(spark, rows)
    assert len(found) == 42
    # equal texts follow each other, so at most one of the equal rows meets another text
    assert sum(g[0] == 5 and g[4] == 1.0 for g in got) >= 38


def test_peeling_recovers_what_differs_and_grows_where_it_fails():
    rng = np.random.default_rng(1)
    for n, m, common in [(0, 0, 0), (1, 0, 5), (3, 2, 50), (400, 380, 10), (3000, 1, 0)]:
        lines = [f"line {rng.integers(1 << 60)}" for _ in range(n + m + common)]
        a, b = "\n".join(lines[: n + common]), "\n".join(lines[n:])
        x, y = iblt.Items(pa.array([a])), iblt.Items(pa.array([b]))
        zero = np.zeros(1, np.int64)
        _, keys, side = iblt.differing(x, zero, y, zero)
        assert set(keys[side == 1].tolist()) == items(a) - items(b)
        assert set(keys[side == -1].tolist()) == items(b) - items(a)


def test_a_sketch_that_is_too_small_says_so():
    text = "\n".join(f"line {i}" for i in range(200))
    x = iblt.Items(pa.array([text]))
    *_, whole = iblt.peel(iblt.sketch(*x.of(np.zeros(1, np.int64)), 1, 4), 1, 4)
    assert not whole[0]


def test_pieces_cover_the_text_and_stay_in_it():
    texts = ["a b.c d. e\n\nf", "", " lead. trail ", "word " * 300]
    buf, off = iblt.W.flat(pa.array(texts))
    starts, ends, row = iblt.pieces(buf, off)
    for k, text in enumerate(texts):
        mine = row == k
        assert b"".join(bytes(buf[s:e]) for s, e in zip(starts[mine], ends[mine])) == text.encode()


def test_differences_between_versions(spark):
    shape = "doc_id long, text string, old string"
    old = spark.createDataFrame([(1, "One. Two. Three.", "c"), (2, "gone.", "c"), (4, None, "c"), (None, "x", "c"), (5, "b", "c"), (5, "a", "c")], shape)
    new = spark.createDataFrame([(1, "One. 2. Three.", "c"), (3, "came.", "c"), (4, "", "c"), (5, "b", "c")], shape)
    found = {r["doc_id"]: (len(r["removed"]), len(r["added"]), round(r["likeness"], 3)) for r in iblt.differences(old, new).collect()}
    assert found == {1: (1, 1, 0.667), 2: (1, 0, 0.0), 3: (0, 1, 0.0), 4: (0, 0, 1.0), 5: (0, 0, 1.0)}
