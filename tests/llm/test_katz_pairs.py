"""The registered query's model holds every pair of its training texts, those seen once too."""

import collections
import math
import random

import pytest
from passagemill.llm import katz, queries
from pyspark.sql import functions as F


def test_pairs_seen_once_are_scored_as_seen(spark):
    assert queries.ALL_PAIRS.least_pairs == 1
    random.seed(13)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(random.choices(words, weights=[1 / (k + 1) for k in range(60)], k=25)) for _ in range(60)]
    texts += ["only here", None, "", "w1 w1 never"]
    tokens = [[*(t or "").split(), None] for t in texts]
    learns = [i % 5 != 0 for i in range(len(texts))]
    count = collections.Counter(w for t, y in zip(tokens, learns) if y for w in t)
    two = collections.Counter(p for t, y in zip(tokens, learns) if y for p in zip([0, *t], t))
    assert sum(c == 1 for c in two.values()) > 100
    n = sum(count.values())
    d1, d2 = (katz.discounts(collections.Counter(c.values()), 5) for c in (count, two))
    unknown = sum(c * (1 - d1[c]) for c in count.values() if c in d1) / n
    word = lambda w: d1.get(count[w], 1.0) * count[w] / n if count[w] else unknown
    context = lambda x: sum(learns) if x == 0 else count[x]
    alpha, after = {}, collections.defaultdict(list)
    for (a, b), c in two.items():
        after[a].append((b, c))
    for a, seen in after.items():
        taken, covered = sum(d2.get(c, 1.0) * c for _, c in seen), sum(word(b) for b, _ in seen)
        more = 1 - taken / context(a) <= 1e-9
        alpha[a] = ((1 - taken / (context(a) + more)) / (1 - covered), more)

    def p(a, b):
        weight, more = alpha.get(a, (1.0, 0))
        return d2.get(two[a, b], 1.0) * two[a, b] / (context(a) + more) if two[a, b] else weight * word(b)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = dict(katz.score_documents(df, F.col("doc_id") % 5 != 0, queries.ALL_PAIRS).select("doc_id", "score").collect())
    for i, t in enumerate(tokens):
        assert got[i] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([0, *t], t)), abs=1e-6)
    for a in [0, *list(count)[:8]]:
        assert abs(sum(p(a, b) for b in count) + alpha.get(a, (1.0, 0))[0] * unknown - 1) < 1e-9
