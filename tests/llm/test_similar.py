"""Near copies by shingle similarity: planted ones go, in a table that is compared in many tiles."""

import random

import corpus_pipeline
from passagemill.llm import similar


def _set(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_go(spark):
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefghij", k=5))
    texts, group = [], 0
    for _ in range(60):
        w = [word() for _ in range(120)]
        texts.append(" ".join(w))
        for n in (1, 2, 6):  # words changed: similarity about 0.92, 0.85 and 0.6
            c = list(w)
            for p in range(n):
                c[10 + 18 * p] = word()
            texts.append(" ".join(c))
    base = [word() for _ in range(400)]
    for _ in range(40):  # one group of near copies
        c = list(base)
        c[random.randrange(400)] = word()
        texts.append(" ".join(c).upper())
        group += 1
    sets = [_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    rows = [*enumerate(texts), (1000, None), (1001, ""), (1002, " \n"), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for radius in (0, 16):  # what is found first does not matter
        got = dict(similar.similar_classes(df, radius=radius).where("doc_id < 1000").collect())
        assert got == dict(enumerate(label))
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, df, "").collect()}
    assert None not in kept and len({1000, 1001, 1002} & kept) == 1
    assert {i for i in kept if i < 1000} == set(label) and sum(i >= len(texts) - group for i in kept if i < 1000) == 1


def test_sizes_and_similarities_at_the_border(spark):
    random.seed(5)
    texts = []
    for n in (1, 3, 5, 6, 9, 14, 24, 40):
        base = [f"w{random.randrange(10**9)}" for _ in range(n)]
        for cut in range(0, min(n, 12)):
            texts += [" ".join(base[cut:]), " ".join(base[: n - cut]), " ".join(base) + " x" * cut, " ".join(base * 2)]
    sets = [_set(t) if t else set() for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both >= 0.8 * all_ - 1e-9 and both or texts[i].split() == texts[j].split():
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, block int")
    assert dict(similar.similar_classes(df).collect()) == dict(enumerate(label))


def test_a_large_group_gives_a_link_a_member(spark, monkeypatch):
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    base = [word() for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(2000):
        c = list(base)
        for p in random.sample(range(200), random.randrange(1, 3)):
            c[p] = word()
        texts.append(" ".join(c))
    checked = []
    real = similar.confirmed
    monkeypatch.setattr(similar, "confirmed", lambda pairs, *a: (checked.append(pairs.count()), real(pairs, *a))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r["component_id"] for r in similar.similar_classes(df).collect()} == {0}
    assert sum(checked) < 3 * len(texts)  # all pairs would be 2,001,000


def test_no_rows_and_only_odd_rows(spark):
    shape = "doc_id long, text string, __gone long, key string"
    assert similar.similar_classes(spark.createDataFrame([], shape)).count() == 0
    assert similar.one_of_each(spark.createDataFrame([], shape.replace("__gone", "n"))).count() == 0
    rows = [(None, None, 1, "k"), (None, "", 1, "k"), (None, "a b c d e f", 1, "k"), (3, "A b c d e  f", 1, "k"), (3, "a b c d e f", 1, "k"), (4, "lone", 1, "k")]
    got = similar.similar_classes(spark.createDataFrame(rows, shape)).collect()
    want = [(None, None)] * 2 + [(None, 3), (3, 3), (3, 3), (4, 4)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
