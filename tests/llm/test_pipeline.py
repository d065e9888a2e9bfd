"""Stages take effect, keep the columns of documents, and keep clean documents."""

import __spark_entry__ as entry
import corpus_pipeline
import pytest

from passagemill.llm import bpe, quality
from passagemill.llm.queries import byte_bpe_path
from passagemill.llm.shared import stored, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], SF), name))
    return docs


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}


def test_columns(steps):
    assert [d.columns for d in steps[:5]] == [steps[0].columns] * 5


def test_each_stage_does_its_work(spark, steps):
    raw, good, single, clean, private, ids = steps
    labels = table(spark, SF, "labels")
    kept = good.join(labels, "doc_id").groupBy("quality").count().collect()
    kept = {r["quality"]: r["count"] for r in kept}
    assert kept[1] > 0.97 * labels.where("quality = 1").join(raw, "doc_id").count()
    assert kept.get(0, 0) < 0.3 * labels.where("quality = 0").join(raw, "doc_id").count()
    rejected = quality.judge(raw, labels).where("not accepted")
    assert good.count() == raw.count() - rejected.count()
    assert single.select("text").distinct().count() == single.count() < good.count()
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    gone = set(texts) - {r["doc_id"] for r in clean.collect()}
    holds = {i for i, t in texts.items() if any(x in t for x in items)}
    assert holds <= gone and len(gone - holds) <= len(texts) * 0.005
    assert private.count() == clean.count() == ids.count()
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (clean, private))
    assert any("@" in t for t in before.values()) and sum(before[i] != after[i] for i in before) > 0
    again = bpe.encode_documents(private, byte_bpe_path()).select("doc_id", "ids_sha256")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, ids.select("doc_id", "ids_sha256").collect()))
