"""Rows that all share one id, or have none: they spread over blocks, and the results are those of rows with ids of their own."""

import random

import numpy as np
import pyarrow as pa
import pytest
from passagemill.llm import katz, substring
from passagemill.llm.shared import in_blocks
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def texts():
    random.seed(31)
    words = [f"w{k}" for k in range(400)]
    said = [" ".join(random.choices(words, k=random.randint(0, 90))) for _ in range(250)]
    shared = " ".join(random.choices(words, k=50))
    return [f"{t} {shared} {i}" if i % 9 == 0 else t for i, t in enumerate(said)] + [None, "", "twice the same", "twice the same"]


@pytest.mark.parametrize("one_id", [None, 7])
def test_one_id_for_all(spark, texts, one_id):
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same = own.select(F.lit(one_id).cast("long").alias("doc_id"), "text")
    assert in_blocks(same, 64, "doc_id", "text").select("block").distinct().count() > 40
    shape = ["n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, substring.remove_repeats(same).select(*shape).collect())) == sorted(
        map(tuple, substring.remove_repeats(own).select(*shape).collect()))
    got, want = (
        sorted(map(tuple, katz.score_documents(d, F.length("text") % 4 != 0).select("n_tokens", "n_known", "base_score", "score").collect()))
        for d in (same, own)
    )
    assert len(got) == len(want) and np.allclose(np.array(got), np.array(want), atol=1e-9)


def test_blocks_ask_only_buckets_that_they_have_keys_for(spark):
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(20)], "doc_id long, text string").select("*", F.lit(True).alias("trains"))
    blocks = in_blocks(docs, 5, "doc_id", "text")
    back = katz._exchange(blocks, 14, katz.KatzRule()).where("kind = 'back'").toArrow()
    # two words, an id, begin and end, and the pairs of each text at most; 2**14 buckets for each of five blocks if all were asked
    assert 0 < back.num_rows <= 20 * 9
    assert isinstance(back, pa.Table) and back["bucket"].to_numpy().max() < 1 << 14
