"""Keyed stream state: sentences as they complete, results in their order.

Rows of a key may arrive in any order. State holds only what cannot be given
out yet: numbers after a gap, and the text after the last full sentence.

A silent stream's state can be dropped after ``idle_ms`` of processing time.
Spark then runs batches for ever to look for timeouts, so a query that should
end by itself (trigger ``availableNow``) passes None.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.sentences import BROWSER_SPACES, MIN_SENTENCE_CHARS, sentence_matches

STATE = "next_seq long, waiting string, text string, emitted long"



def _order(row: list, fields: list[str]) -> tuple:
    """Rows of one number by preference: those that did not fail, then the least by its values, null first."""
    bad = row[fields.index("failed")] if "failed" in fields else False
    return (bad is None or bool(bad), [(v is not None, v.encode() if isinstance(v, str) else v) for v in row])


def _in_sequence(batches: Iterator[pd.DataFrame], waiting: dict, next_seq: int, fields: list[str]):
    """Yield rows in gap-free order; keep the rows beyond a gap in ``waiting``.

    Of rows with one number the same wins as in the batch form, as long as none of them has been given out.
    """
    for batch in batches:
        for row in batch[["seq", *fields]].itertuples(index=False, name=None):
            if row[0] >= next_seq:
                new = [None if pd.isna(v) else _plain(v) if hasattr(v, "item") else v for v in row[1:]]
                old = waiting.get(str(int(row[0])))
                if old is None or _order(new, fields) < _order(old, fields):
                    waiting[str(int(row[0]))] = new
        while str(next_seq) in waiting:
            yield next_seq, waiting.pop(str(next_seq))
            next_seq += 1
    yield next_seq, None


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def stream_ordered_release(results: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Release payloads strictly by number from 1; failed ones do not block.

    ``results``: stream_id, seq, payload, failed.
    """

    def release(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        next_seq, waiting_text, _, _ = state.get if state.exists else (1, "{}", "", 0)
        waiting = json.loads(waiting_text)
        out = []
        for seq, row in _in_sequence(batches, waiting, next_seq, ["payload", "failed"]):
            next_seq = seq if row is None else seq + 1
            if row is not None and row[1] is not None and not row[1]:
                out.append((key[0], seq, row[0]))
        state.update((next_seq, json.dumps(waiting, default=_plain), "", 0))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "seq", "payload"])

    return results.groupBy("stream_id").applyInPandasWithState(
        release,
        "stream_id string, seq long, payload string",
        STATE,
        "append",
        _timeout(idle_ms),
    )


def _plain(value):
    return value.item() if hasattr(value, "item") else str(value)


def stream_sentences(events: DataFrame, min_chars: int = MIN_SENTENCE_CHARS, idle_ms: int | None = None) -> DataFrame:
    """Emit sentences while an answer is still being written.

    ``events``: stream_id, seq from 0 without gaps, type ('delta' or 'done') and
    text. The rest is emitted on ``done``. Output does not depend on how the
    text was cut into deltas, so it equals the batch function. A finished stream
    leaves no state behind.
    """

    def speak(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        next_seq, waiting_text, text, emitted = state.get if state.exists else (0, "{}", "", 0)
        waiting = json.loads(waiting_text)
        ended = False
        out = []

        def say(sentence: str) -> None:
            nonlocal emitted
            out.append((key[0], emitted, sentence))
            emitted += 1

        for seq, row in _in_sequence(batches, waiting, next_seq, ["type", "text"]):
            if row is None:
                next_seq = seq
                continue
            kind, delta = row
            if kind == "delta":
                text += delta or ""
                cut = 0
                for match in sentence_matches(text):
                    sentence = match.group(1).strip(BROWSER_SPACES)
                    if len(sentence.encode("utf-16-le")) // 2 >= min_chars:
                        say(sentence)
                        cut = match.end()
                text = text[cut:]
            elif kind == "done":
                rest = text.strip(BROWSER_SPACES)
                if rest:
                    say(rest)
                ended = True
        if ended:
            state.remove()
        else:
            state.update((next_seq, json.dumps(waiting), text, emitted))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "position", "sentence"])

    return events.groupBy("stream_id").applyInPandasWithState(
        speak,
        "stream_id string, position long, sentence string",
        STATE,
        "append",
        _timeout(idle_ms),
    )
