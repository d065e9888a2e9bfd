"""Answer streams: captured responses, event lines, sentences, ordered results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.sentences import spoken_sentences
from passagemill.functions.text import word_tokens
from passagemill.functions.wording import NO_HITS_ANSWER
from passagemill.operators.ordering import concat_in_order, release_in_order
from passagemill.plans.answer import answer_events, assemble_answers
from passagemill.session import new_run_dir, spread, stored
from passagemill.sources.events import completion_text, fold_events, read_event_lines, sse_deltas
from passagemill.streaming.answers import stream_fold_events, stream_sse_deltas, use_rocksdb
from passagemill.streaming.framing import stream_answer_events
from passagemill.streaming.speech import stream_ordered_release, stream_sentences

from . import standins as st
from .retrieving import FINAL_CTES, _answers, _quoted
from .standins import WS, strip_sql, table, with_ctes

TURN = ["conv_id", "turn", "role", "text"]

# Files of a micro-batch, as stored; their rows are sorted by stream outside memory.
MICRO_BATCH_BYTES = 256 * 1024 * 1024


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(*TURN)


# Captured responses -----------------------------------------------------------


def response_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as server-sent lines of two providers, with the noise real captures have."""
    text, role, turn = F.col("text"), F.col("role"), F.col("turn")
    odd = F.col("conv_id") % 2 == 1
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("delta"))).alias("choices")))
    block = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(text.alias("text")).alias("delta")))
    full = F.when(odd, block).otherwise(chat)
    line = (
        F.when(turn == 5, F.lit("data: [DONE]"))
        .when((role == "system") & odd, F.lit('data: {"type": "message_start"}'))
        .when(role == "system", F.lit('data: {"choices": []}'))
        .when(F.length(text) < 60, F.concat(F.lit("data: "), F.substring(full, 1, 20)))
        .when(F.length(text) > 1500, F.concat(F.lit("event: "), full))
        .otherwise(F.concat(F.lit("data:"), full, F.lit(" ")))
    )
    return turns(spark, sf).select(
        F.col("conv_id").alias("stream_id"), turn.alias("seq"),
        F.when(odd, F.lit("anthropic")).otherwise(F.lit("openai")).alias("provider"), line.alias("line"),
    )


def captured_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return sse_deltas(response_lines(spark, sf))


SSE_SQL = """SELECT conv_id AS stream_id, turn AS seq, text FROM conversations
WHERE role <> 'system' AND length(text) BETWEEN 60 AND 1500 AND turn <> 5 AND (conv_id % 2 = 1 OR turn < 5)"""


SSE_BIG_SQL = SSE_SQL.replace("turn AS seq", "CAST(turn AS BIGINT) AS seq")


def completions(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    odd = F.col("conv_id") % 2 == 1
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))
    blocks = F.to_json(F.struct(F.array(F.struct(F.col("role").alias("text")), F.struct(F.lit(None).cast("string").alias("text")), F.struct(text.alias("text"))).alias("content")))
    provider = F.when(odd, F.lit("anthropic")).otherwise(F.lit("openai"))
    payload = F.when(odd, blocks).otherwise(chat)
    return turns(spark, sf).select("conv_id", "turn", completion_text(payload, provider).alias("answer"))


COMPLETION_SQL = "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 1 THEN role || text ELSE text END AS answer FROM conversations"


def document_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Every document text as the deltas of an answer, one word each."""
    return spread(table(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").alias("question_id"), F.posexplode(word_tokens(F.col("text"))).alias("seq", "text")
    )


def assembled_answers(spark: SparkSession, sf: str) -> DataFrame:
    return assemble_answers(document_deltas(spark, sf))


ASSEMBLE_SQL = f"SELECT doc_id AS question_id, {strip_sql('text')} AS answer FROM documents WHERE {strip_sql('text')} <> ''"


# Events -----------------------------------------------------------------------


def streamed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Event rows of every benchmark question; the captured answer repeats the question."""
    q = st.text_questions(spark, sf)
    size = F.length("question")
    deltas = q.select("question_id", F.posexplode(word_tokens(F.col("question"))).alias("seq", "text"))
    errors = q.select(
        "question_id",
        F.when(size % 7 == 0, F.lit("retrieval")).when(size % 7 == 1, F.lit("model")).alias("stage"),
        F.concat(F.lit("code "), size.cast("string")).alias("message"),
    ).filter(F.col("stage").isNotNull())
    events = answer_events(stored(_answers(spark, sf), "answers"), deltas, errors)
    return events.select(
        "question_id", "seq", "type", "text", "message", F.size("data").alias("n_citations"),
        F.when(F.col("type") != "citations", F.col("line")).alias("line"),
    )


def framed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The same event rows while inputs, deltas and ends arrive as three streams, each in any order."""
    use_rocksdb(spark)
    root = new_run_dir(spark, "framing")
    q = st.text_questions(spark, sf)
    words, size = word_tokens(F.col("question")), F.length("question")
    code = F.concat(F.lit("code "), size.cast("string"))
    refused = q.select("question_id", F.when(size % 7 == 0, code).alias("error"))
    inputs = _answers(spark, sf).drop("error").join(refused, "question_id").select("question_id", "citations", "answer", "error")
    deltas = q.select("question_id", F.posexplode(words).alias("seq", "text"))
    ends = q.select("question_id", F.size(words).alias("n_deltas"), F.when(size % 7 == 1, code).alias("message"))
    inputs = stored(inputs, "answers")
    streams = [arriving(spark, f"{root}/{name}", rows) for name, rows in (("inputs", inputs), ("deltas", deltas), ("ends", ends))]
    events = drained(stream_answer_events(*streams), root)
    return events.select(
        "question_id", "seq", "type", "text", "message", F.size("data").alias("n_citations"),
        F.when(F.col("type") != "citations", F.col("line")).alias("line"),
    )


EVENTS_SQL = with_ctes(
    FINAL_CTES,
    f"""base AS (
  SELECT q.question_id, q.question, count(f.n) AS hits, length(q.question) % 7 AS m,
         regexp_extract_all(q.question, '[{WS}]*[^{WS}]+') AS toks
  FROM questions q LEFT JOIN final f USING (question_id) GROUP BY q.question_id, q.question),
ev AS (
  SELECT question_id, 0 AS seq, 'error' AS type, NULL AS text, 'code ' || length(question) AS message, NULL AS n_citations
    FROM base WHERE m = 0
  UNION ALL SELECT question_id, 0, 'citations', NULL, NULL, hits FROM base WHERE m <> 0
  UNION ALL SELECT question_id, 1, 'delta', {_quoted(NO_HITS_ANSWER)}, NULL, NULL FROM base WHERE m <> 0 AND hits = 0
  UNION ALL SELECT question_id, i, 'delta', toks[i], NULL, NULL
    FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM base) WHERE m <> 0 AND hits > 0
  UNION ALL SELECT question_id, CASE WHEN hits = 0 THEN 2 ELSE len(toks) + 1 END,
    CASE WHEN m = 1 AND hits > 0 THEN 'error' ELSE 'done' END, NULL,
    CASE WHEN m = 1 AND hits > 0 THEN 'llm call failed: code ' || length(question) END, NULL FROM base WHERE m <> 0)""",
    select="""SELECT question_id, CAST(seq AS BIGINT) AS seq, type, text, message, CAST(n_citations AS INTEGER) AS n_citations,
  CASE type WHEN 'delta' THEN CAST(to_json({'type': type, 'text': text}) AS VARCHAR)
            WHEN 'error' THEN CAST(to_json({'type': type, 'message': message}) AS VARCHAR)
            WHEN 'done' THEN '{"type":"done"}' END AS line FROM ev""",
)


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as answer-event lines: good, blank, unknown and cut-off ones."""
    text, role, turn = F.col("text"), F.col("role"), F.col("turn")
    cited = F.struct(
        F.lit("citations").alias("type"),
        F.array(F.struct((turn + 1).cast("int").alias("n"), F.col("conv_id").cast("string").alias("document_id"), text.alias("filename"), F.lit(0.5).alias("score"))).alias("data"),
    )
    line = (
        F.when(turn == 7, F.lit("  \t"))
        .when(turn == 6, F.lit('{"type": "ping", "text": "x"}'))
        .when(role == "system", F.lit('{"type":"done"}'))
        .when(F.length(text) < 60, F.concat(F.lit('{"type":"delta","text":"'), text))
        .when(role == "user", F.to_json(cited))
        .otherwise(F.to_json(F.struct(F.lit("delta").alias("type"), text.alias("text"))))
    )
    return turns(spark, sf).select("conv_id", "turn", line.alias("line"))


def parsed_lines(spark: SparkSession, sf: str) -> DataFrame:
    events, _ = read_event_lines(event_lines(spark, sf))
    return events.select(
        "conv_id", "turn", "type", "text", F.size("data").alias("n_citations"),
        F.get(F.col("data"), F.lit(0))["filename"].alias("filename"),
    )


PARSE_LINES_SQL = """SELECT conv_id, turn,
  CASE role WHEN 'system' THEN 'done' WHEN 'user' THEN 'citations' ELSE 'delta' END AS type,
  CASE WHEN role = 'assistant' THEN text END AS text,
  CASE WHEN role = 'user' THEN 1 END AS n_citations, CASE WHEN role = 'user' THEN text END AS filename
FROM conversations WHERE turn < 6 AND (role = 'system' OR length(text) >= 60)"""


def bad_lines(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = read_event_lines(event_lines(spark, sf))
    return bad.select("conv_id", "turn", "line")


BAD_LINES_SQL = """SELECT conv_id, turn, '{"type":"delta","text":"' || text AS line
FROM conversations WHERE turn < 6 AND role <> 'system' AND length(text) < 60"""


def turn_events(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as event streams: citations first, long turns fail, short ones end."""
    text, turn = F.col("text"), F.col("turn")
    kind = (
        F.when(turn == 0, F.lit("citations")).when(F.length(text) > 1700, F.lit("error"))
        .when(F.length(text) < 60, F.lit("done")).otherwise(F.lit("delta"))
    )
    data = F.array(
        F.struct(
            F.lit(1).alias("n"), F.col("conv_id").cast("string").alias("document_id"), text.alias("filename"),
            F.lit(None).cast("int").alias("page_number"), F.col("role").alias("heading"), F.lit(0.5).alias("score"),
        )
    )
    return turns(spark, sf).select(
        F.col("conv_id").alias("stream_id"), turn.alias("seq"), kind.alias("type"),
        F.when(kind == "citations", data).alias("data"), F.when(kind == "delta", text).alias("text"),
        F.when(kind == "error", F.col("role")).alias("message"),
    )


def folded(spark: SparkSession, sf: str) -> DataFrame:
    rows = fold_events(turn_events(spark, sf))
    return rows.select(
        "stream_id", "answer", F.get(F.col("citations"), F.lit(0))["filename"].alias("filename"), "is_error", "n_deltas"
    )


def newest_rows(changes: DataFrame, root: str, key: str) -> DataFrame:
    """The view that an update stream leaves: the last row of each key."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/view/batch={number}")

    query = (
        changes.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    view = changes.sparkSession.read.schema(T.StructType([*changes.schema, T.StructField("batch", T.IntegerType())])).parquet(f"{root}/view")
    row = F.struct(*[c for c in changes.columns if c != key])
    return view.groupBy(key).agg(F.max_by(row, F.col("batch")).alias("s")).select(key, "s.*")


def streamed_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The same fold while the events arrive in any order."""
    use_rocksdb(spark)
    root = new_run_dir(spark, "fold")
    rows = newest_rows(stream_fold_events(arriving(spark, root, turn_events(spark, sf))), root, "stream_id")
    return rows.select(
        "stream_id", "answer", F.get(F.col("citations"), F.lit(0))["filename"].alias("filename"), "is_error", "n_deltas"
    )


def streamed_sse(spark: SparkSession, sf: str) -> DataFrame:
    use_rocksdb(spark)
    root = new_run_dir(spark, "sse")
    return drained(stream_sse_deltas(arriving(spark, root, response_lines(spark, sf))), root)


FOLD_SQL = """WITH ev AS (
  SELECT *, CASE WHEN turn = 0 THEN 'citations' WHEN length(text) > 1700 THEN 'error'
                 WHEN length(text) < 60 THEN 'done' ELSE 'delta' END AS type FROM conversations)
SELECT conv_id AS stream_id,
  CASE WHEN count(*) FILTER (type = 'error') > 0 THEN 'Query failed: ' || arg_max(role, turn) FILTER (type = 'error')
       WHEN count(*) FILTER (type = 'delta') > 0 THEN string_agg(text, '' ORDER BY turn) FILTER (type = 'delta')
       WHEN count(*) FILTER (type = 'done') > 0 THEN '(empty answer)' ELSE '' END AS answer,
  max(text) FILTER (type = 'citations') AS filename,
  count(*) FILTER (type = 'error') > 0 AS is_error, count(*) FILTER (type = 'delta') AS n_deltas
FROM ev GROUP BY conv_id"""


# Sentences ----------------------------------------------------------------------


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Spoken sentences of every document text read as an answer."""
    return spread(table(spark, sf, "documents"), "doc_id").select(
        "doc_id", F.posexplode(spoken_sentences(F.col("text"))).alias("position", "sentence")
    )


SENT = r"([^.!?\n]+[.!?])([ \t\n\x0B\f\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+)"
TRIM = r"^[ \t\n\x0B\f\r\x{A0}\x{FEFF}\x{2028}\x{2029}]+|[ \t\n\x0B\f\r\x{A0}\x{FEFF}\x{2028}\x{2029}]+$"


def sentences_sql(source: str, key: str) -> str:
    return f"""SELECT {key}, CAST(unnest(range(0, len(said))) AS BIGINT) AS position, unnest(said) AS sentence FROM (
  SELECT {key}, list_concat([s FOR s IN spoken IF length(s) >= 20], [r FOR r IN [rest] IF r <> '']) AS said FROM (
    SELECT {key}, spoken, regexp_replace(array_to_string(
      [gaps[i] || coalesce(found[i], '') FOR i IN range(cut + 1, len(gaps) + 1)], ''), '{TRIM}', '', 'g') AS rest FROM (
      SELECT *, coalesce(list_max([i FOR i IN range(1, len(spoken) + 1) IF length(spoken[i]) >= 20]), 0) AS cut FROM (
        SELECT {key}, regexp_split_to_array(text, '{SENT}') AS gaps, regexp_extract_all(text, '{SENT}', 0) AS found,
          [regexp_replace(s, '{TRIM}', '', 'g') FOR s IN regexp_extract_all(text, '{SENT}', 1)] AS spoken
        FROM {source}))))"""


SENTENCES_SQL = sentences_sql("documents", "doc_id").replace("CAST(unnest(range(0, len(said))) AS BIGINT)", "CAST(unnest(range(0, len(said))) AS INTEGER)")


def arriving(spark: SparkSession, root: str, rows: DataFrame, parts: int = 3) -> DataFrame:
    """Rows as a file stream that arrives out of order, a third at a time.

    A micro-batch is bounded by its bytes: each one opens all state partitions, so a bound by files would make their
    number grow with the partitions of ``rows`` instead of their size. ``rows`` are read once for each part.
    """
    for part in range(parts):
        share = rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(parts)) == part)
        share.write.mode("append").parquet(f"{root}/in")
    reader = spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", MICRO_BATCH_BYTES)
    return reader.parquet(f"{root}/in")


def drained(stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def conversation_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as deltas of one answer each; the stream ends after its last turn."""
    rows = turns(spark, sf)
    stream = F.col("conv_id").cast("string").alias("stream_id")
    said = rows.select(stream, F.col("turn").alias("seq"), F.lit("delta").alias("type"), F.concat("text", F.lit(" ")).alias("text"))
    ends = rows.groupBy(stream).agg((F.max("turn") + 1).alias("seq"))
    return said.unionByName(ends.select("stream_id", "seq", F.lit("done").alias("type"), F.lit(None).cast("string").alias("text")))


def streamed_sentences(spark: SparkSession, sf: str) -> DataFrame:
    root = new_run_dir(spark, "sentences")
    return drained(stream_sentences(arriving(spark, root, conversation_deltas(spark, sf)), idle_ms=None), root)


def conversation_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the streamed sentences: assemble first, then cut."""
    deltas = conversation_deltas(spark, sf).filter(F.col("type") == "delta")
    whole = concat_in_order(deltas.select("stream_id", "seq", "text"), ["stream_id"], "seq", "text")
    rows = whole.select("stream_id", F.posexplode(spoken_sentences(F.col("text"))).alias("position", "sentence"))
    return rows.withColumn("position", F.col("position").cast("bigint"))


CONV_SENTENCES_SQL = (
    "WITH answers AS (SELECT CAST(conv_id AS VARCHAR) AS stream_id, string_agg(text || ' ', '' ORDER BY turn) AS text"
    " FROM conversations GROUP BY conv_id)\n" + sentences_sql("answers", "stream_id")
)


# Ordered results ------------------------------------------------------------------


def async_results(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as results that come back in any order; very long ones have not come back yet."""
    rows = turns(spark, sf).filter(F.length("text") <= 1500)
    return rows.select(
        F.col("conv_id").cast("string").alias("stream_id"), (F.col("turn") + 1).alias("seq"),
        F.col("text").alias("payload"), (F.col("role") == "system").alias("failed"),
    )


def released(spark: SparkSession, sf: str) -> DataFrame:
    rows = release_in_order(async_results(spark, sf), ["stream_id"], "seq", "failed")
    return rows.select("stream_id", "seq", "payload")


def streamed_release(spark: SparkSession, sf: str) -> DataFrame:
    root = new_run_dir(spark, "release")
    return drained(stream_ordered_release(arriving(spark, root, async_results(spark, sf)), idle_ms=None), root)


RELEASE_SQL = """SELECT CAST(conv_id AS VARCHAR) AS stream_id, turn + 1 AS seq, text AS payload FROM (
  SELECT *, bool_and(length(text) <= 1500) OVER (PARTITION BY conv_id ORDER BY turn) AS open FROM conversations)
WHERE open AND role <> 'system'"""


QUERIES = {
    "sse_deltas": captured_deltas,
    "extract_completion": completions,
    "assemble_answers": assembled_answers,
    "answer_events": streamed_answers,
    "stream_answer_events": framed_answers,
    "parse_event_lines": parsed_lines,
    "bad_event_lines": bad_lines,
    "fold_events": folded,
    "stream_fold_events": streamed_fold,
    "stream_sse_deltas": streamed_sse,
    "sentences": sentences,
    "conversation_sentences": conversation_sentences,
    "stream_sentences": streamed_sentences,
    "ordered_release": released,
    "stream_ordered_release": streamed_release,
}

ORACLE = {
    "sse_deltas": SSE_SQL,
    "extract_completion": COMPLETION_SQL,
    "assemble_answers": ASSEMBLE_SQL,
    "answer_events": EVENTS_SQL,
    "stream_answer_events": EVENTS_SQL,
    "parse_event_lines": PARSE_LINES_SQL,
    "bad_event_lines": BAD_LINES_SQL,
    "fold_events": FOLD_SQL,
    "stream_fold_events": FOLD_SQL,
    "stream_sse_deltas": SSE_BIG_SQL,
    "sentences": SENTENCES_SQL,
    "conversation_sentences": CONV_SENTENCES_SQL,
    "stream_sentences": CONV_SENTENCES_SQL,
    "ordered_release": RELEASE_SQL,
    "stream_ordered_release": RELEASE_SQL,
}
