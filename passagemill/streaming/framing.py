"""Answer events while they arise: citations, deltas as the model gives them, and the end of each answer.

State is kept per question and needs the RocksDB state store (``answers.use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schemas import STREAM_EVENT
from ..sources.events import event_line
from .answers import _mode

_OPENING, _DELTA, _END = "opening", "delta", "end"


def _signals(inputs: DataFrame, deltas: DataFrame, ends: DataFrame) -> DataFrame:
    """The three streams as one, a row per signal."""
    none, no_number = F.lit(None).cast("string"), F.lit(None).cast("long")
    error = F.col("error") if "error" in inputs.columns else none
    cited = F.to_json("citations", {"ignoreNullFields": "false"})
    opening = inputs.select("question_id", F.lit(_OPENING).alias("kind"), no_number.alias("seq"), F.col("answer").alias("text"), error.alias("message"), cited.alias("cited"))
    said = deltas.select("question_id", F.lit(_DELTA).alias("kind"), F.col("seq").cast("long").alias("seq"), "text", none.alias("message"), none.alias("cited"))
    ended = ends.select("question_id", F.lit(_END).alias("kind"), F.col("n_deltas").cast("long").alias("seq"), none.alias("text"), "message", none.alias("cited"))
    return opening.unionByName(said).unionByName(ended)


def _text(value) -> str | None:
    return None if pd.isna(value) else value


class _Framing(StatefulProcessor):
    """Opens a question's events once, releases deltas by number, closes after the last one."""

    OUT = ["question_id", "seq", "type", "cited", "text", "message"]

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # following: the next delta's number; close_at: the number of the event that closes
        self.place = handle.getValueState("place", "opened boolean, closed boolean, following long, close_at long", self.ttl_ms)
        self.end = handle.getValueState("end", "n_deltas long, message string", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "seq long", "text string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        opened, closed, following, close_at = self.place.get() if self.place.exists() else (False, False, 0, 1)
        if closed:
            return  # repeated signals after the close
        opening = None
        for part in rows:
            for kind, seq, text, message, cited in part[["kind", "seq", "text", "message", "cited"]].itertuples(index=False, name=None):
                if kind == _OPENING:
                    opening = (_text(text), _text(message), _text(cited))
                elif kind == _END:
                    self.end.update((int(seq), _text(message)))
                elif seq >= following:
                    self.waiting.updateValue((int(seq),), (_text(text),))
        out: list[tuple] = []

        def event(seq: int, kind: str, cited: str | None = None, text: str | None = None, message: str | None = None) -> None:
            out.append((key[0], seq, kind, cited, text, message))

        if opening and not opened:
            fixed, refused, cited = opening
            opened = True
            if refused is not None:
                event(0, "error", message=refused)
                closed = True
            else:
                event(0, "citations", cited=cited)
                if fixed is not None:
                    event(1, "delta", text=fixed)
                    event(2, "done")
                    closed = True
        if opened and not closed:
            n_deltas, failure = self.end.get() if self.end.exists() else (None, None)
            while (n_deltas is None or following < n_deltas) and self.waiting.containsKey((following,)):
                (text,) = self.waiting.getValue((following,))
                self.waiting.removeKey((following,))
                following += 1
                if text:
                    event(following, "delta", text=text)
                    close_at = following + 1
            if n_deltas is not None and following >= n_deltas:
                if failure is None:
                    event(close_at, "done")
                else:
                    event(close_at, "error", message="llm call failed: " + failure)
                closed = True
        if closed:
            self.waiting.clear()
            self.end.clear()
        self.place.update((opened, closed, following, close_at))
        if out:
            yield pd.DataFrame(out, columns=self.OUT)

    def close(self) -> None:
        pass


def stream_answer_events(inputs: DataFrame, deltas: DataFrame, ends: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """``answer_events`` on streams: every event once, as soon as all events before it are out (append).

    ``inputs``: question_id, citations, answer (the fixed answer without hits) and optionally error (the question was
    refused or its retrieval failed: the only event then). ``deltas``: question_id, seq from 0 without gaps, text.
    ``ends``: question_id, n_deltas (how many deltas there are, empty ones included) and message, the model's
    failure or null. The three arrive in any order: deltas and an end that come before their question's
    input wait for it, and an end waits for the deltas before it. Repeated signals change nothing once they are
    out; of repeated ones before that the last counts. A closed question keeps two numbers and two flags;
    ``ttl_ms`` drops the state of silent questions, as in ``answers``.
    """
    signals = _signals(inputs, deltas, ends)
    shape = f"question_id {dict(inputs.dtypes)['question_id']}, seq long, type string, cited string, text string, message string"
    framed = signals.groupBy("question_id").transformWithStateInPandas(_Framing(ttl_ms), shape, "append", _mode(ttl_ms))
    data = STREAM_EVENT["data"].dataType
    events = framed.withColumn("data", F.from_json("cited", data)).select("question_id", "seq", "type", "data", "text", "message")
    return events.withColumn("line", event_line(F.col("type"), F.col("data"), F.col("text"), F.col("message")))
