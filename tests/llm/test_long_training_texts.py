"""Wording that only long labelled documents hold is learned."""

import random

from passagemill.llm import toxicity
from pyspark.sql import functions as F


def test_long_texts_train(spark):
    random.seed(15)
    plain = [f"word{k}" for k in range(200)]
    text = lambda bad: " ".join(random.choices(plain, k=1500) + (["vileslur"] * 12 if bad else [])) + " end"
    rows = [(i, text(i % 2)) for i in range(120)]
    assert min(len(t) for _, t in rows) > 8_000 and max(len(t) for _, t in rows) < 20_000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")), F.lit(True))
    new = spark.createDataFrame([(0, "word1 word2 word3"), (1, "word1 vileslur vileslur word2")], "doc_id long, text string")
    score = dict(toxicity.score_documents(new, net).select("doc_id", "score").collect())
    assert score[1] > score[0] + 0.2
