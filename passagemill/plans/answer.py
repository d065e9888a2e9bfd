"""Answer streams as tables: events per question, their lines, assembled answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.ordering import concat_in_order
from ..schemas import STREAM_EVENT
from ..sources.events import event_line


def assemble_answers(deltas: DataFrame, key: str = "question_id") -> DataFrame:
    """All deltas of an answer joined in order and stripped."""
    whole = concat_in_order(deltas, [key], "seq", "text")
    return whole.select(key, strip(F.col("text")).alias("answer"))


def answer_events(inputs: DataFrame, deltas: DataFrame, errors: DataFrame) -> DataFrame:
    """The event rows of every question, in (question_id, seq).

    ``inputs``: question_id, citations, answer (the fixed answer without
    hits) and optionally error (the question was not searched for, like a retrieval error). ``deltas``: question_id, seq, text of captured model output, empty
    texts ignored. ``errors``: question_id, stage ('retrieval' or 'model') and
    message.

    A retrieval error is the only event of its stream. Otherwise citations come
    first; then either the fixed answer or the deltas; then ``done``, or an
    error if the model failed. Deltas stay rows of their own, so an answer of any
    length is never gathered. ``inputs`` is read twice and is best a stored table.
    """
    stages = errors.groupBy("question_id").agg(
        F.max(F.when(F.col("stage") == "retrieval", F.col("message"))).alias("_early"),
        F.max(F.when(F.col("stage") == "model", F.col("message"))).alias("_late"),
    )
    if "error" in inputs.columns:
        own = inputs.filter(F.col("error").isNotNull()).select("question_id", F.col("error").alias("_early"), F.lit(None).cast("string").alias("_late"))
        stages = stages.unionByName(own).groupBy("question_id").agg(F.max("_early").alias("_early"), F.max("_late").alias("_late"))
    called = inputs.filter(F.col("answer").isNull()).select("question_id")
    refused = stages.filter(F.col("_early").isNotNull()).select("question_id")
    spoken = (
        deltas.filter(F.col("text") != "")
        .join(called, "question_id", "left_semi")
        .join(refused, "question_id", "left_anti")
        .select("question_id", (F.col("seq") + 1).cast("bigint").alias("seq"), "text")
    )
    closes = spoken.groupBy("question_id").agg((F.max("seq") + 1).alias("_close"))
    rows = inputs.join(stages, "question_id", "left").join(closes, "question_id", "left")

    no_data = F.lit(None).cast(STREAM_EVENT["data"].dataType)
    no_text = F.lit(None).cast("string")

    def event(seq: Column, kind: str, data: Column = no_data, text: Column = no_text, message: Column = no_text) -> Column:
        return F.struct(
            seq.cast("bigint").alias("seq"), F.lit(kind).alias("type"),
            data.alias("data"), text.alias("text"), message.alias("message"),
        )

    first, second = F.lit(0), F.lit(1)
    model_error = F.concat(F.lit("llm call failed: "), F.col("_late"))
    close_at = F.coalesce("_close", second)
    cited = event(first, "citations", data=F.col("citations"))
    fixed = F.array(cited, event(second, "delta", text=F.col("answer")), event(F.lit(2), "done"))
    events = (
        F.when(F.col("_early").isNotNull(), F.array(event(first, "error", message=F.col("_early"))))
        .when(F.col("answer").isNotNull(), fixed)
        .when(F.col("_late").isNotNull(), F.array(cited, event(close_at, "error", message=model_error)))
        .otherwise(F.array(cited, event(close_at, "done")))
    )
    framed = rows.select("question_id", F.explode(events).alias("e")).select("question_id", "e.*")
    said = spoken.select(
        "question_id", "seq", F.lit("delta").alias("type"), no_data.alias("data"), "text", no_text.alias("message")
    )
    out = framed.unionByName(said)
    return out.withColumn("line", event_line(F.col("type"), F.col("data"), F.col("text"), F.col("message")))
