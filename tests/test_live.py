"""Streams with state: parse, fold, status view, file intake; each in many micro-batches and in any order."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.config import EngineConfig
from passagemill.operators.ordering import release_in_order
from passagemill.schemas import STREAM_EVENT
from passagemill.plans.answer import answer_events
from passagemill.sources.events import fold_events, sse_deltas
from passagemill.streaming.answers import stream_fold_events, stream_sse_deltas, use_rocksdb
from passagemill.streaming.framing import stream_answer_events
from passagemill.streaming.intake import REJECTED, arriving_files, stream_file_intake, taken
from passagemill.streaming.speech import stream_ordered_release
from passagemill.streaming.status import stream_status_view


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def in_batches(spark, root, batches, schema, make, mode="append"):
    """Run ``make`` on a stream of one micro-batch per list, with a new query for each; rows with their batch."""
    out = []
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = make(spark.readStream.schema(schema).parquet(f"{root}/in"))
        took = []
        query = (
            stream.writeStream.outputMode(mode).foreachBatch(lambda b, n: took.extend(b.collect()))
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        out += [(number, r) for r in took]
    return out


def chat(text):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})


def test_lines_behind_the_end_never_come_out(spark, tmp_path):
    lines = [("o", 0, "openai", chat("A")), ("o", 1, "openai", "event: x"), ("o", 2, "openai", chat("B")), ("o", 3, "openai", "data: [DONE]"),
             ("o", 4, "openai", chat("late")), ("o", 5, "openai", "data: [DONE]"), ("a", 0, "anthropic", "data: [DONE]"),
             ("a", 1, "anthropic", 'data: {"type": "content_block_delta", "delta": {"text": "C"}}'), ("a", 2, "anthropic", "data: {bro")]
    schema = "stream_id string, seq long, provider string, line string"
    order = [[lines[4], lines[2]], [lines[7], lines[5], lines[0]], [lines[3], lines[8]], [lines[1], lines[6]], [("o", 6, "openai", chat("later"))]]
    got = in_batches(spark, tmp_path, order, schema, stream_sse_deltas)
    assert [(n, tuple(r)) for n, r in got if r["stream_id"] == "o"] == [(1, ("o", 0, "A")), (3, ("o", 2, "B"))]
    want = {tuple(r) for r in sse_deltas(spark.createDataFrame(lines, schema)).collect()}
    assert {tuple(r) for _, r in got} == want


def test_fold_in_any_order(spark, tmp_path):
    schema = T.StructType([T.StructField("stream_id", T.StringType()), T.StructField("seq", T.LongType()), *STREAM_EVENT])
    cite = [(1, "d", "f.md", None, "H", 0.5)]
    events = [("s", 0, "citations", cite, None, None)] + [("s", i, "delta", None, f"t{i} ", None) for i in range(1, 12)] + [("s", 12, "done", None, None, None)]
    events += [("e", 0, "delta", None, "x", None), ("e", 1, "error", None, None, "first"), ("e", 2, "error", None, None, ""), ("q", 0, "done", None, None, None), ("c", 0, "citations", [], None, None)]
    random.seed(3)
    random.shuffle(events)
    batches = [events[i : i + 4] for i in range(0, len(events), 4)]
    got = in_batches(spark, tmp_path, batches, schema, stream_fold_events, "update")
    last = {}
    for _, r in got:
        last[r["stream_id"]] = tuple(r)
    want = {r["stream_id"]: tuple(r) for r in fold_events(spark.createDataFrame(events, schema)).collect()}
    assert last == want and len(got) > len(want)


def test_a_removed_document_leaves_the_view_and_the_state(spark, tmp_path):
    schema = "document_id string, at timestamp, event_id long, status string, error_message string"
    from datetime import datetime

    at = lambda k: datetime(2024, 1, 1, 0, k)
    batches = [
        [("a", at(1), 1, "processing", None), ("b", at(1), 2, "failed", "e")],
        [("a", at(5), 3, "deleted", None), ("b", at(0), 0, "queued", None)],
        [("a", at(4), 4, "completed", None), ("b", at(2), 5, "completed", None)],
        [("a", at(6), 6, "queued", None)],
    ]
    got = in_batches(spark, tmp_path, batches, schema, lambda s: stream_status_view(s, remember=True), "update")
    seen = [(n, r["document_id"], r["status"], r["removed"]) for n, r in got]
    assert sorted(seen) == [(0, "a", "processing", False), (0, "b", "failed", False), (1, "a", "deleted", True), (2, "b", "completed", False), (3, "a", "queued", False)]


def test_no_state_is_left_of_a_removed_document(spark, tmp_path):
    from datetime import datetime

    schema = "document_id string, at timestamp, event_id long, status string, error_message string"
    batches = [[("a", datetime(2024, 1, 1), 1, "queued", None), ("b", datetime(2024, 1, 1), 2, "queued", None)], [("a", datetime(2024, 1, 2), 3, "deleted", None)]]
    in_batches(spark, tmp_path, batches, schema, stream_status_view, "update")
    state = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "newest").load()
    assert [r["key"]["document_id"] for r in state.collect()] == ["b"]


def test_stream_and_batch_agree_on_repeated_numbers(spark, tmp_path):
    schema = "stream_id string, seq long, payload string, failed boolean"
    rows = [("s", 3, "z", False), ("s", 3, "c", True), ("s", 2, "b", False), ("s", 2, "a", False), ("s", 4, None, False), ("s", 4, "d", None), ("s", 5, "x", None)]
    want = {tuple(r) for r in release_in_order(spark.createDataFrame([*rows, ("s", 1, "1", False)], schema), ["stream_id"], "seq", "failed").select("stream_id", "seq", "payload").collect()}
    for k, order in enumerate(itertools.islice(itertools.permutations(rows), 0, 5040, 1700)):
        got = in_batches(spark, tmp_path / str(k), [list(order[:3]), list(order[3:]), [("s", 1, "1", False)]], schema, stream_ordered_release)
        assert {tuple(r) for _, r in got} == want


def test_files_are_taken_once_across_a_crash(spark, tmp_path):
    box = tmp_path / "box" / "deep"
    box.mkdir(parents=True)
    cfg = EngineConfig(max_upload_mb=1)
    for i in range(6):
        (box / f"f{i}.pdf").write_bytes(b"%d" % i * (i + 1))
    (box / "big.png").write_bytes(b"x" * (1 << 21))
    (box / "note.txt").write_bytes(b"text")
    root, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(after=None):
        stream_file_intake(arriving_files(spark, str(tmp_path / "box"), 3), root, cfg, checkpoint, after=after).awaitTermination()

    def die(number):
        if number == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(die)
    run()
    (box / "later.JPG").write_bytes(b"late")
    run()
    run()
    good = {r["filename"]: (r["mime"], r["length"], bytes(r["content"])) for r in taken(spark, root).collect()}
    assert taken(spark, root).count() == 7 and good["f3.pdf"] == ("application/pdf", 4, b"3333") and good["later.JPG"][2] == b"late"
    bad = {r["filename"]: r["reject_code"] for r in taken(spark, root, REJECTED).collect()}
    assert bad == {"big.png": 413, "note.txt": 415} and taken(spark, root, REJECTED).count() == 2
    assert taken(spark, str(tmp_path / "nothing")).count() == 0
    assert taken(spark, root).select(F.sum("length")).first()[0] == sum(range(1, 7)) + 4


def test_content_above_the_limit_is_never_read(spark, tmp_path):
    """Reading a file of more than 1.5 MB fails here, so the large one must be judged by its listed size."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "small.pdf").write_bytes(b"s" * 1000)
    (inbox / "large.pdf").write_bytes(b"l" * 2_000_000)
    cfg = EngineConfig(max_upload_mb=1)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1_500_000)
    try:
        stream_file_intake(arriving_files(spark, str(inbox)), str(tmp_path / "root"), cfg, str(tmp_path / "cp")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [(r["filename"], bytes(r["content"])) for r in taken(spark, str(tmp_path / "root")).collect()] == [("small.pdf", b"s" * 1000)]
    assert [(r["filename"], r["reject_code"]) for r in taken(spark, str(tmp_path / "root"), REJECTED).collect()] == [("large.pdf", 413)]


def test_a_table_in_a_folder_of_files_is_ingested(spark, tmp_path):
    from workload.ingesting import streamed_ingest

    docs = spark.createDataFrame([(i, f"text number {i}", "en", "src1", 13) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [r["n_chunks"] for r in streamed_ingest(spark, str(tmp_path)).collect()] == [1] * 9


def test_framing_in_any_order(spark, tmp_path):
    cite = [(1, "d", "f.md", None, "H", 0.5)]
    inputs = [("a", cite, None, None), ("b", [], "nothing", None), ("c", None, None, "refused"), ("d", cite, None, None), ("e", cite, None, None), ("g", cite, None, None)]
    deltas = [("a", i, f"t{i} ") for i in range(9)] + [("d", 0, "x"), ("d", 1, ""), ("e", 0, None), ("b", 0, "unheard"), ("c", 0, "unheard"), ("f", 0, "no input")]
    ends = [("a", 9, None), ("b", 1, None), ("c", 1, "late"), ("d", 2, "model"), ("e", 1, None), ("f", 1, None), ("g", 0, None)]
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("kind", T.StringType()), ("question_id", T.StringType()), ("citations", STREAM_EVENT["data"].dataType), ("answer", T.StringType()), ("error", T.StringType()),
        ("seq", T.LongType()), ("text", T.StringType()), ("n_deltas", T.LongType()), ("message", T.StringType()))])
    signals = [("i", *r, None, None, None, None) for r in inputs] + [("d", q, None, None, None, n, t, None, None) for q, n, t in deltas]
    signals += [("e", q, None, None, None, None, None, n, m) for q, n, m in ends]

    def make(s):
        of = lambda kind, *cols: s.filter(F.col("kind") == kind).select("question_id", *cols)
        return stream_answer_events(of("i", "citations", "answer", "error"), of("d", "seq", "text"), of("e", "n_deltas", "message"))

    batch = spark.createDataFrame(signals, schema)
    errors = batch.filter("kind = 'e' AND message IS NOT NULL").select("question_id", F.lit("model").alias("stage"), "message")
    told = answer_events(
        batch.filter("kind = 'i'").select("question_id", "citations", "answer", "error"),
        batch.filter("kind = 'd' AND text IS NOT NULL").select("question_id", "seq", "text"), errors,
    )
    fields = ["question_id", "seq", "type", "text", "message", "line"]
    want = sorted(tuple(r) for r in told.select(*fields).collect())
    for seed in (1, 2):
        random.seed(seed)
        order = signals + random.sample(signals, 6)  # some come twice
        random.shuffle(order)
        batches = [order[i : i + 7] for i in range(0, len(order), 7)] + [[signals[0], signals[-1]]]
        got = in_batches(spark, tmp_path / str(seed), batches, schema, make)
        assert sorted(tuple(r[f] for f in fields) for _, r in got) == want
        numbers = [r["seq"] for _, r in got if r["question_id"] == "a"]
        assert numbers == sorted(numbers) and len({n for n, r in got if r["question_id"] == "a"}) > 1


def test_framing_state_after_the_close(spark, tmp_path):
    inputs = spark.createDataFrame([("a", [], None, None)], T.StructType([
        T.StructField("question_id", T.StringType()), T.StructField("citations", STREAM_EVENT["data"].dataType),
        T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())]))
    deltas = spark.createDataFrame([("a", 0, "x"), ("a", 5, "beyond the end")], "question_id string, seq long, text string")
    ends = spark.createDataFrame([("a", 1, None)], "question_id string, n_deltas long, message string")
    streams = []
    for name, rows in (("i", inputs), ("d", deltas), ("e", ends)):
        rows.write.parquet(f"{tmp_path}/{name}")
        streams.append(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/{name}"))
    query = (
        stream_answer_events(*streams).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert [r["type"] for r in spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()] == ["citations", "delta", "done"]
    for name in ("end", "waiting"):
        reader = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", name)
        assert reader.load().count() == 0
