"""Answer events as lines of JSON: writing, reading, and model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sentences import browser_trim
from ..functions.text import strip
from ..functions.wording import EMPTY_ANSWER
from ..operators.ordering import concat_in_order
from ..schemas import STREAM_EVENT

# The event types of the wire format.
EVENT_TYPES = ["citations", "delta", "done", "error"]


def event_line(event_type: Column, data: Column, text: Column, message: Column) -> Column:
    """One JSON object per event with the fields of its type, nulls kept."""
    options = {"ignoreNullFields": "false"}
    return (
        F.when(event_type == "citations", F.to_json(F.struct(event_type.alias("type"), data.alias("data")), options))
        .when(event_type == "delta", F.to_json(F.struct(event_type.alias("type"), text.alias("text")), options))
        .when(event_type == "error", F.to_json(F.struct(event_type.alias("type"), message.alias("message")), options))
        .otherwise(F.to_json(F.struct(event_type.alias("type")), options))
    )


def write_event_lines(events: DataFrame, path: str) -> None:
    events.select(F.col("line").alias("value")).write.text(path)


def read_event_lines(lines: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(events, bad lines). Blank lines and unknown types are skipped."""
    filled = lines.filter(browser_trim(F.col(line)) != "")
    parsed = filled.withColumn("_ok", F.try_parse_json(F.col(line))).withColumn(
        "event", F.from_json(F.col(line), STREAM_EVENT)
    )
    good = parsed.filter(F.col("_ok").isNotNull() & F.col("event.type").isin(EVENT_TYPES))
    bad = filled.filter(F.try_parse_json(F.col(line)).isNull())
    kept = [c for c in lines.columns if c != line]
    return good.select(*kept, "event.*"), bad


def data_field(line: Column) -> Column:
    """The payload of a server-sent ``data:`` line, else null."""
    return F.when(line.startswith("data:"), strip(F.substring(line, 6, 2**31 - 1)))


def sse_parts(lines: DataFrame, provider: str = "provider") -> DataFrame:
    """Every captured line with its delta ``text`` (null if it has none) and whether it ``ends`` its stream.

    The chat-completion form ends with ``[DONE]``; the messages form has no such line. Broken JSON has no text.
    """
    data = data_field(F.col("line"))
    openai = F.lower(F.coalesce(F.col(provider), F.lit(""))) != "anthropic"
    valid = F.when(F.try_parse_json("data").isNotNull(), F.col("data"))
    text = F.when(openai, F.get_json_object(valid, "$.choices[0].delta.content")).when(
        F.get_json_object(valid, "$.type") == "content_block_delta", F.get_json_object(valid, "$.delta.text")
    )
    ends = F.coalesce(openai & (F.col("data") == "[DONE]"), F.lit(False))
    return lines.withColumn("data", data).withColumns({"text": text, "ends": ends}).drop("data")


def sse_deltas(lines: DataFrame, provider: str = "provider") -> DataFrame:
    """Text deltas of captured response streams, in (stream_id, seq).

    ``lines``: stream_id, seq, provider, line. Lines from a stream's first end on, and empty
    texts, are skipped. The end of a stream is one row, found with
    a partial minimum, so a long stream is not sorted in one task.
    """
    parts = sse_parts(lines, provider)
    ends = parts.filter("ends").groupBy("stream_id").agg(F.min("seq").alias("_end"))
    live = parts.join(ends, "stream_id", "left").filter(F.col("_end").isNull() | (F.col("seq") < F.col("_end")))
    return live.select("stream_id", "seq", "text").filter(F.col("text") != "")


def completion_text(payload: Column, provider: Column) -> Column:
    """The answer of a whole (not streamed) response."""
    blocks = F.from_json(F.get_json_object(payload, "$.content"), "array<struct<text:string>>")
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "")
    return F.when(provider == "anthropic", F.coalesce(joined, F.lit(""))).otherwise(
        F.get_json_object(payload, "$.choices[0].message.content")
    )


def embedding_rows(responses: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per returned vector, in input order."""
    kept = [c for c in responses.columns if c != payload]
    data = F.from_json(F.col(payload), "struct<data:array<struct<embedding:array<float>>>>")["data"]
    return responses.select(*kept, F.posexplode(data).alias("position", "item")).select(
        *kept, "position", F.col("item.embedding").alias("embedding")
    )


def failure_text(message: Column) -> Column:
    """What a reader sees of a failed stream."""
    return F.concat(F.lit("Query failed: "), F.coalesce(F.nullif(message, F.lit("")), F.lit("unknown error")))


def fold_events(events: DataFrame) -> DataFrame:
    """Per stream: the shown answer, its citations and whether it failed.

    ``events``: stream_id, seq and the event fields. Deltas join to the answer;
    an error replaces what was shown and ends the stream; ``done`` without a
    delta shows a fixed text. Long streams are joined run by run before their rows meet.
    """
    is_delta = F.col("type") == "delta"
    is_error = F.col("type") == "error"
    facts = events.groupBy("stream_id").agg(
        F.max_by("message", F.when(is_error, F.col("seq"))).alias("_message"),
        F.max(F.when(is_error, F.col("seq"))).alias("_error_at"),
        F.min(F.when(is_delta, F.col("seq"))).alias("_first_delta"),
        F.max(F.when(F.col("type") == "done", F.col("seq"))).alias("_done_at"),
        F.max_by("data", F.when(F.col("type") == "citations", F.col("seq"))).alias("_citations"),
        F.count_if(is_delta).alias("n_deltas"),
    )
    answers = concat_in_order(
        events.filter(is_delta).select("stream_id", "seq", "text"), ["stream_id"], "seq", "text"
    )
    folded = facts.join(answers, "stream_id", "left")
    failed = F.col("_error_at").isNotNull()
    answer = (
        F.when(failed, failure_text(F.col("_message")))
        .when(F.col("_first_delta").isNotNull(), F.col("text"))
        .when(F.col("_done_at").isNotNull(), F.lit(EMPTY_ANSWER))
        .otherwise(F.lit(""))
    )
    none = F.array().cast(STREAM_EVENT["data"].dataType)
    return folded.select(
        "stream_id", answer.alias("answer"), F.coalesce("_citations", none).alias("citations"),
        failed.alias("is_error"), "n_deltas",
    )

