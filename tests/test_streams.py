"""Event lines, response capture, ordered work and keyed streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from passagemill.functions.wording import EMPTY_ANSWER
from passagemill.operators.ordering import carry_forward, concat_in_order, release_in_order, running_total
from passagemill.plans.answer import answer_events, assemble_answers
from passagemill.sources.events import (
    completion_text, embedding_rows, fold_events, read_event_lines, sse_deltas, write_event_lines,
)
from passagemill.streaming.speech import stream_ordered_release, stream_sentences


def test_sse_lines(spark):
    chat = lambda text: "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})
    block = lambda text: "data:" + json.dumps({"type": "content_block_delta", "delta": {"text": text}})
    rows = [
        ("o", 0, "openai", ""), ("o", 1, "openai", "event: x"), ("o", 2, "openai", chat("He")),
        ("o", 3, "openai", "data: {broken"), ("o", 4, "openai", 'data: {"choices": []}'),
        ("o", 5, "openai", 'data: {"choices": [{"delta": {"content": null}}]}'), ("o", 6, "openai", chat("")),
        ("o", 7, "openai", chat("y\n")), ("o", 8, "openai", "data: [DONE]  "), ("o", 9, "openai", chat("late")),
        ("o", 10, "openai", "data: [DONE]"), ("a", 0, "anthropic", 'data: {"type": "message_start"}'),
        ("a", 1, "anthropic", block("A")), ("a", 2, "anthropic", "data: [DONE]"), ("a", 3, "anthropic", block("B")),
        ("a", 4, "anthropic", 'data: {"type": "content_block_delta"}'), ("a", 5, "anthropic", "data:"),
    ]
    df = spark.createDataFrame(rows, "stream_id string, seq long, provider string, line string")
    got = {tuple(r) for r in sse_deltas(df).collect()}
    assert got == {("o", 2, "He"), ("o", 7, "y\n"), ("a", 1, "A"), ("a", 3, "B")}


def test_whole_responses(spark):
    rows = [
        ("openai", json.dumps({"choices": [{"message": {"content": "é"}}]})),
        ("anthropic", json.dumps({"content": [{"text": "a"}, {"type": "image"}, {"text": "b"}]})),
        ("anthropic", json.dumps({"id": 1})),
    ]
    df = spark.createDataFrame(rows, "provider string, payload string")
    got = [r[0] for r in df.select(completion_text(F.col("payload"), F.col("provider"))).collect()]
    assert got == ["é", "ab", ""]


def test_embedding_response_order(spark):
    payload = json.dumps({"data": [{"index": 1, "embedding": [1.5, 2]}, {"index": 0, "embedding": [0.25]}]})
    df = spark.createDataFrame([("b", payload)], "batch string, payload string")
    assert [tuple(r) for r in embedding_rows(df).collect()] == [("b", 0, [1.5, 2.0]), ("b", 1, [0.25])]


def test_event_lines_round_trip(spark, tmp_path):
    cite = [(1, "d", "f.md", None, "H", 0.5)]
    schema = "question_id string, citations array<struct<n:int,document_id:string,filename:string,page_number:int,heading:string,score:double>>, answer string"
    inputs = spark.createDataFrame([("hit", cite, None), ("none", [], "sorry"), ("early", [], None), ("late", cite, None), ("quiet", cite, None)], schema)
    deltas = spark.createDataFrame(
        [("hit", 0, "Hej "), ("hit", 1, ""), ("hit", 2, "då “x”"), ("late", 0, "part"), ("none", 0, "unused"), ("early", 0, "unused")],
        "question_id string, seq long, text string",
    )
    errors = spark.createDataFrame(
        [("early", "retrieval", "embedding failed"), ("late", "model", "503"), ("none", "model", "never called")],
        "question_id string, stage string, message string",
    )
    events = answer_events(inputs, deltas, errors)
    by_question = {}
    for r in events.orderBy("question_id", "seq").collect():
        by_question.setdefault(r["question_id"], []).append(json.loads(r["line"]))
    cited = {"type": "citations", "data": [{"n": 1, "document_id": "d", "filename": "f.md", "page_number": None, "heading": "H", "score": 0.5}]}
    done = {"type": "done"}
    assert by_question["hit"] == [cited, {"type": "delta", "text": "Hej "}, {"type": "delta", "text": "då “x”"}, done]
    assert by_question["none"] == [{"type": "citations", "data": []}, {"type": "delta", "text": "sorry"}, done]
    assert by_question["early"] == [{"type": "error", "message": "embedding failed"}]
    assert by_question["late"] == [cited, {"type": "delta", "text": "part"}, {"type": "error", "message": "llm call failed: 503"}]
    assert by_question["quiet"] == [cited, done]

    path = str(tmp_path / "lines")
    write_event_lines(events, path)
    parsed, bad = read_event_lines(spark.read.text(path).withColumnRenamed("value", "line"))
    assert parsed.count() == events.count() and bad.count() == 0

    folded = {r["stream_id"]: r for r in fold_events(events.withColumnRenamed("question_id", "stream_id")).collect()}
    assert folded["hit"]["answer"] == "Hej då “x”" and folded["hit"]["citations"][0]["heading"] == "H"
    assert folded["quiet"]["answer"] == EMPTY_ANSWER
    assert folded["late"]["answer"] == "Query failed: llm call failed: 503" and folded["late"]["is_error"]
    assert folded["early"]["citations"] == []


def test_line_framing(spark):
    lines = ["", "  \t", '{"type":"delta","text":"a"}', '{"type":"delta"', '{"type":"ping"}', "12", '{"type":"error"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string")
    events, bad = read_event_lines(df)
    assert {(r["i"], r["type"], r["text"]) for r in events.collect()} == {(2, "delta", "a"), (6, "error", None)}
    assert [r["i"] for r in bad.collect()] == [3]


def test_hot_keys_in_runs(spark):
    """Joined, carried and summed results do not depend on how a key is cut into runs."""
    rng = random.Random(9)
    rows = [("hot", i * 3, rng.choice([None, str(i)]), rng.choice([None, i])) for i in range(4000)]
    rows += [(f"k{i % 50}", i, f"t{i}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, at long, t string, v long").repartition(7)
    by_key: dict = {}
    for r in sorted(rows, key=lambda r: r[1]):
        by_key.setdefault(r[0], []).append(r)
    for span in (1, 7, 1024, 10**9):
        texts = {r["k"]: r["t"] for r in concat_in_order(df, ["k"], "at", "t", "-", span).collect()}
        assert texts == {k: "-".join(r[2] or "" for r in v) for k, v in by_key.items()}
        carried = {(r["k"], r["at"]): r["c"] for r in carry_forward(df, ["k"], "at", "v", "c", span).collect()}
        sums = {(r["k"], r["at"]): r["s"] for r in running_total(df, ["k"], "at", "v", "s", span).collect()}
        for k, v in by_key.items():
            last, total = None, 0
            for r in v:
                assert sums[(k, r[1])] == total
                total += r[3] or 0
                last = r[3] if r[3] is not None else last
                assert carried[(k, r[1])] == last


def test_rows_move_before_they_are_collected(spark):
    """Lists made on the map side are as large as their rows and sort, and spill, when a task has many keys."""
    df = spark.createDataFrame([("a", 0, "x")], "k string, at long, t string")
    plan = concat_in_order(df, ["k"], "at", "t")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and "collect_list" not in plan[plan.rindex("Exchange hashpartitioning(k") :]


RESULTS = "stream_id string, seq long, payload string, failed boolean"


def released(rows):
    by_stream: dict = {}
    for stream, seq, payload, failed in rows:
        by_stream.setdefault(stream, {})[seq] = (payload, failed)
    out = set()
    for stream, arrived in by_stream.items():
        seq = 1
        while seq in arrived:
            if not arrived[seq][1]:
                out.add((stream, seq, arrived[seq][0]))
            seq += 1
    return out


def result_rows(seed):
    rng = random.Random(seed)
    rows = [(f"s{s}", i, f"p{i}", rng.random() < 0.2) for s in range(30) for i in range(1, rng.randint(2, 40)) if rng.random() < 0.97]
    rng.shuffle(rows)
    return rows


def test_release_in_order(spark):
    rows = [("s", 2, "b", False), ("s", 1, "a", False), ("s", 4, "d", False), ("s", 3, "c", True), ("s", 6, "f", False), ("gap", 2, "x", False)]
    df = spark.createDataFrame(rows, RESULTS)
    got = {(r["stream_id"], r["seq"], r["payload"]) for r in release_in_order(df, ["stream_id"], "seq", "failed").collect()}
    assert got == {("s", 1, "a"), ("s", 2, "b"), ("s", 4, "d")}
    # Repeated numbers: a result beats a failure, then the least payload wins.
    again = rows + [("s", 1, "A", True), ("s", 2, "B", False), ("s", 3, "z", False)]
    for n in (1, 5):
        df = spark.createDataFrame(again, RESULTS).repartition(n)
        won = sorted((r["seq"], r["payload"]) for r in release_in_order(df, ["stream_id"], "seq", "failed").collect())
        assert won == [(1, "a"), (2, "B"), (3, "z"), (4, "d")]
    rows = result_rows(1)
    df = spark.createDataFrame(rows, RESULTS)
    got = {(r["stream_id"], r["seq"], r["payload"]) for r in release_in_order(df, ["stream_id"], "seq", "failed").collect()}
    assert got == released(rows)


def streamed(spark, tmp_path, rows, schema, make, parts):
    for part in range(parts):
        spark.createDataFrame(rows[part::parts], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = make(reader)
    query = (
        out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return [tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()]


@pytest.mark.parametrize("parts", [1, 4])
def test_streamed_release(spark, tmp_path, parts):
    rows = result_rows(2)
    got = streamed(spark, tmp_path, rows, RESULTS, lambda s: stream_ordered_release(s, idle_ms=None), parts)
    assert len(got) == len(set(got)) and set(got) == released(rows)


@pytest.mark.parametrize("parts", [1, 5])
def test_streamed_sentences_ignore_cuts(spark, tmp_path, parts):
    from test_text import plain_sentences

    rng = random.Random(parts)
    texts = {f"s{i}": "".join(rng.choice(["a few words here ", "Yes. ", "\n", "3.14 ", "one long enough sentence. ", "! "]) for _ in range(30)) for i in range(12)}
    rows = []
    for stream, text in texts.items():
        cuts = sorted(rng.sample(range(1, len(text)), 8))
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        rows += [(stream, i, "delta", p) for i, p in enumerate(pieces)] + [(stream, len(pieces), "done", None)]
    rng.shuffle(rows)
    schema = "stream_id string, seq long, type string, text string"
    got = streamed(spark, tmp_path, rows, schema, lambda s: stream_sentences(s, idle_ms=None), parts)
    said = {s: [t for _, _, t in sorted(r for r in got if r[0] == s)] for s in texts}
    assert said == {s: plain_sentences(t) for s, t in texts.items()}


def test_assembled_answers_are_stripped(spark):
    df = spark.createDataFrame([("q", 2, "c \n"), ("q", 0, " a"), ("q", 1, "b")], "question_id string, seq long, text string")
    assert [tuple(r) for r in assemble_answers(df).collect()] == [("q", "abc")]
