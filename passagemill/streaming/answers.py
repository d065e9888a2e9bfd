"""Answer streams while they arrive: response lines to deltas, events to shown answers.

State is kept per stream and entry (a map), so an entry costs one write however long the stream is.
Both need a state store with column families: set ``spark.sql.streaming.stateStore.providerClass``
to the RocksDB provider (``use_rocksdb``) before the query starts. ``ttl_ms`` drops the state of silent streams; Spark then
runs batches for ever, so a query that should end by itself (trigger ``availableNow``) passes None.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.wording import EMPTY_ANSWER
from ..sources.events import failure_text, sse_parts

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _mode(ttl_ms: int | None) -> str:
    return "none" if ttl_ms is None else "processingTime"


class _Release(StatefulProcessor):
    """Deltas in the order of their numbers, from 0 without gaps, up to the stream's end."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next long, ended boolean", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "seq long", "text string, ends boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        following, ended = self.place.get() or (0, False)
        if ended:
            return  # whatever comes after the end, or has waited beyond it, is dropped
        held = self.waiting.exists()
        for part in rows:
            # what the numbers at hand release never goes through the state: each call there is a message to the JVM
            arrived = {
                int(seq): (None if pd.isna(text) else text, bool(ends))
                for seq, text, ends in part[["seq", "text", "ends"]].itertuples(index=False, name=None)
                if seq >= following
            }
            out = []
            while not ended:
                waited = held and self.waiting.containsKey((following,))
                if following in arrived:
                    text, ended = arrived.pop(following)
                elif waited:
                    text, ended = self.waiting.getValue((following,))
                else:
                    break
                if waited:
                    self.waiting.removeKey((following,))
                if text and not ended:
                    out.append((key[0], following, text))
                following += 1
            if not ended:
                held = held or bool(arrived)
                for seq, entry in arrived.items():
                    self.waiting.updateValue((seq,), entry)
            if out:
                yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])
            if ended:
                break
        if ended and held:
            self.waiting.clear()
        self.place.update((following, ended))

    def close(self) -> None:
        pass


def stream_sse_deltas(lines: DataFrame, provider: str = "provider", ttl_ms: int | None = None) -> DataFrame:
    """``sse_deltas`` on a stream of lines in any order: (stream_id, seq, text), append.

    ``lines``: stream_id, seq from 0 without gaps, provider, line. A line is given out when all before it are here, so
    one behind ``[DONE]`` never is, even if it came first. Of a repeated number the last row before its turn counts.
    """
    parts = sse_parts(lines, provider).select("stream_id", "seq", "text", "ends")
    return parts.groupBy("stream_id").transformWithStateInPandas(
        _Release(ttl_ms), "stream_id " + dict(lines.dtypes)["stream_id"] + ", seq long, text string", "append", _mode(ttl_ms)
    )


class _Fold(StatefulProcessor):
    """What is shown of a stream so far."""

    FACTS = "error_at long, message string, cited_at long, cited string, n_deltas long, done boolean"

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getValueState("facts", self.FACTS, self.ttl_ms)
        self.deltas = handle.getMapState("deltas", "seq long", "text string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.facts.get()
        error_at, message, cited_at, cited, n, done = known or (-1, None, -1, None, 0, False)
        arrived: dict[int, str] = {}
        for part in rows:
            for seq, kind, text, said, data in part[["seq", "type", "text", "message", "cited"]].itertuples(index=False, name=None):
                seq = int(seq)
                if kind == "delta":
                    arrived[seq] = "" if pd.isna(text) else text
                elif kind == "error" and seq >= error_at:
                    error_at, message = seq, None if pd.isna(said) else said
                elif kind == "citations" and seq >= cited_at:
                    cited_at, cited = seq, None if pd.isna(data) else data
                elif kind == "done":
                    done = True
        # each call to the state is a message to the JVM: a stream's first deltas need not be looked up or read back
        before = n
        for seq, text in arrived.items():
            n += not (before and self.deltas.containsKey((seq,)))
            self.deltas.updateValue((seq,), (text,))
        self.facts.update((error_at, message, cited_at, cited, n, done))
        if error_at >= 0:
            answer = message
        else:
            said_so_far = ((k[0], v[0]) for k, v in self.deltas.iterator()) if before else arrived.items()
            answer = "".join(text for _, text in sorted(said_so_far))
            if not n and done:
                answer = EMPTY_ANSWER
        yield pd.DataFrame(
            [(key[0], answer, cited, error_at >= 0, n)], columns=["stream_id", "answer", "cited", "is_error", "n_deltas"]
        )

    def close(self) -> None:
        pass


def stream_fold_events(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """``fold_events`` on a stream, events in any order: each micro-batch gives the new fold of the streams it touched (update).

    Columns are those of the batch form. Of a repeated delta number the last row counts, once.
    """
    citations = events.schema["data"].dataType
    narrow = events.select("stream_id", "seq", "type", "text", "message", F.to_json("data", {"ignoreNullFields": "false"}).alias("cited"))
    shape = "stream_id " + dict(events.dtypes)["stream_id"] + ", answer string, cited string, is_error boolean, n_deltas long"
    folded = narrow.groupBy("stream_id").transformWithStateInPandas(_Fold(ttl_ms), shape, "update", _mode(ttl_ms))
    none = F.array().cast(citations)
    return folded.select(
        "stream_id", F.when(F.col("is_error"), failure_text(F.col("answer"))).otherwise(F.col("answer")).alias("answer"),
        F.coalesce(F.from_json("cited", citations.simpleString()), none).alias("citations"), "is_error", "n_deltas",
    )
