"""Continuous status views: the newest status per document, and what has been removed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.wording import shorten_error
from ..operators.lifecycle import TERMINAL, latest_status

REMOVED = "deleted"


def stream_latest_status(log: DataFrame) -> DataFrame:
    """The batch aggregate on a stream; write it in update or complete mode.

    State is one row per document. Two documents' entries may arrive in any
    order, as the newest entry wins by its own time.
    """
    return latest_status(log)


class _View(StatefulProcessor):
    """The newest entry of a document; a removal clears it and is remembered apart for a while."""

    def __init__(self, remember: bool, grace_ms: int | None):
        self.remember, self.grace_ms = remember, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at long, event_id long, status string, error_message string")
        self.gone = handle.getValueState("gone", "at long, event_id long", self.grace_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        had = self.newest.get()
        before = had and had[:2]
        gone = self.gone.get() if had is None else None  # what is shown is newer than any removal
        if gone:
            before = gone
        best = None
        for part in rows:
            for at, event, status, error in part[["at", "event_id", "status", "error_message"]].itertuples(index=False, name=None):
                place = (int(at), int(event))
                if (before is None or place > tuple(before)) and (best is None or place > best[:2]):
                    best = (*place, status, None if pd.isna(error) else error)
        if best is None:
            return
        removed = best[2] == REMOVED
        if removed:
            self.newest.clear()
            if self.remember:
                self.gone.update(best[:2])
        else:
            self.newest.update(best)
        yield pd.DataFrame([(key[0], best[2], best[3], best[0], removed)], columns=["document_id", "status", "error_message", "at", "removed"])

    def close(self) -> None:
        pass


def stream_status_view(log: DataFrame, remember: bool = False, grace_ms: int | None = None) -> DataFrame:
    """Changes of the live view: document_id, status, error_message, updated_at, is_terminal, removed (update).

    ``log`` is that of ``latest_status``; an entry with status ``deleted`` is a tombstone: the row leaves the view (one
    change with ``removed``) and its state goes. Entries older than what is shown change nothing. With ``remember`` two numbers
    of a removal stay, so that entries older than it are known as such, for ``grace_ms`` if given; else an old entry that arrives late
    shows the document again. With ``grace_ms`` Spark runs batches for ever to look for what has expired, so a query that should
    end by itself (trigger ``availableNow``) passes None. Needs the RocksDB state store (``answers.use_rocksdb``).
    """
    narrow = log.select(
        "document_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("event_id"),
        "status", shorten_error(F.col("error_message")).alias("error_message"),
    )
    shape = "document_id string, status string, error_message string, at long, removed boolean"
    mode = "none" if grace_ms is None else "processingTime"
    changes = narrow.groupBy("document_id").transformWithStateInPandas(_View(remember, grace_ms), shape, "update", mode)
    return changes.select(
        "document_id", "status", "error_message", F.timestamp_micros("at").alias("updated_at"), F.col("status").isin(TERMINAL).alias("is_terminal"), "removed",
    )


def shown(view: DataFrame) -> DataFrame:
    """The newest changes of documents (one row each) without the removed ones."""
    return view.filter(~F.col("removed")).drop("removed")
