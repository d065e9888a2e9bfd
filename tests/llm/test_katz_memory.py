"""Memory of a block grows by few numbers a token."""

import tracemalloc

import numpy as np
import pyarrow as pa

from passagemill.llm import katz


def test_block_memory():
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(f"w{k}" for k in rng.integers(0, 50_000, 500)) for _ in range(2400)] + ["", None])
    trains = np.arange(len(texts)) % 10 != 0
    katz._tokens(texts[:100], trains[:100])  # tables of powers stay
    tracemalloc.start()
    words, number, row, counted = katz._tokens(texts, trains)
    middle, peak = tracemalloc.get_traced_memory()
    tracemalloc.reset_peak()
    keys, pair_n, pair_of, left, right = katz._pairs(words, number, row, trains)
    pairs_peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = len(number)
    assert n == 2400 * 501 + 2 and len(words) == 50_002
    assert peak < 60 * n and middle < 10 * n and pairs_peak < 72 * n
    # counts of the training rows, added up plainly
    assert counted.sum() == trains[row].sum() == pair_n.sum()
    assert np.array_equal(counted, np.bincount(number[trains[row]], minlength=len(words)))
    assert np.array_equal(pair_n, np.bincount(pair_of[trains[row]], minlength=len(keys)))
    assert np.array_equal(right[pair_of], number)
    before = np.where(np.diff(row, prepend=-1) > 0, np.searchsorted(words, katz.BEGIN), np.roll(number, 1))
    assert np.array_equal(left[pair_of], before)
