"""Memory of training on the driver grows with the sample by little more than a number a word."""

import tracemalloc

import numpy as np
import pyarrow as pa

from passagemill.llm import toxicity
from passagemill.llm import words as W


def test_words_of_many_texts():
    texts = [" ".join(f"word{k % 997}" for k in range(j, j + 1000)) for j in range(1200)]
    buf, off = W.flat(pa.array(texts))
    toxicity.Words(buf[: off[50]], off[:51])  # tables of powers stay
    tracemalloc.start()
    words = toxicity.Words(buf, off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words) == 997 and len(words.number) == 1_200_000
    assert peak < 5 * len(buf)
    one = toxicity.Words(*W.flat(pa.array(texts[-1:])))
    last = words.number[words.bounds[-2] :]
    assert np.array_equal(words.row[last], one.row[one.number])
