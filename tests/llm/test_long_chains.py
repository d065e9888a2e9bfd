"""A long chain with ids in no order settles."""

import random

from passagemill.llm.components import components


def test_shuffled_chain(spark):
    random.seed(14)
    ids = list(range(1000))
    random.shuffle(ids)
    got = dict(components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect())
    assert got == dict.fromkeys(ids, 0)
