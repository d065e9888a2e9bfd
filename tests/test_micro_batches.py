"""Streams over tables of many files: few micro-batches, and few messages between a task and its state."""

import os

import pandas as pd
from pyspark.sql import functions as F
from workload.answering import arriving, drained

from passagemill.streaming.answers import _Fold, _Release


def test_the_number_of_files_does_not_set_the_number_of_micro_batches(spark, tmp_path):
    rows = spark.range(0, 600, 1, 12).select("id", F.concat(F.lit("r"), F.col("id").cast("string")).alias("text"))
    out = drained(arriving(spark, str(tmp_path), rows), str(tmp_path))
    assert len([f for f in os.listdir(tmp_path / "in") if f.endswith(".parquet")]) > 8
    assert len([f for f in os.listdir(tmp_path / "checkpoint/commits") if f.isdigit()]) == 1
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in rows.collect()}


class Counted:
    """A state variable in memory that counts how often it is asked or told."""

    def __init__(self):
        self.value, self.entries, self.calls = None, {}, 0

    def _call(self, result=None):
        self.calls += 1
        return result

    def get(self):
        return self._call(self.value)

    def exists(self):
        return self._call(self.value is not None or bool(self.entries))

    def update(self, value):
        self.value = self._call(value)

    def containsKey(self, key):  # noqa: N802
        return self._call(key in self.entries)

    def getValue(self, key):  # noqa: N802
        return self._call(self.entries[key])

    def updateValue(self, key, value):  # noqa: N802
        self.entries[key] = self._call(value)

    def removeKey(self, key):  # noqa: N802
        self._call(self.entries.pop(key))

    def iterator(self):
        return iter(self._call(list(self.entries.items())))

    def clear(self):
        self.value, self.entries = self._call(), {}


class Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, Counted())

    getMapState = getValueState  # noqa: N815

    def calls(self):
        return sum(s.calls for s in self.states.values())


def test_lines_that_come_together_do_not_pass_through_the_state():
    handle, release = Handle(), _Release(None)
    release.init(handle)

    def give(numbers, ends=()):
        part = pd.DataFrame([(n, f"t{n}", n in ends) for n in numbers], columns=["seq", "text", "ends"])
        return [tuple(r) for out in release.handleInputRows(("s",), iter([part]), None) for r in out.itertuples(index=False)]

    assert give(reversed(range(100))) == [("s", n, f"t{n}") for n in range(100)]
    assert handle.calls() <= 4
    assert give([102, 101]) == []  # wait in the state
    assert give([100, 104, 103], ends=(104,)) == [("s", n, f"t{n}") for n in (100, 101, 102, 103)]
    assert not handle.states["waiting"].entries
    assert give([105]) == []


def test_the_first_deltas_of_a_stream_are_told_once():
    handle, fold = Handle(), _Fold(None)
    fold.init(handle)
    names = ["seq", "type", "text", "message", "cited"]

    def give(rows):
        part = pd.DataFrame([(n, kind, text, None, None) for n, kind, text in rows], columns=names)
        (out,) = fold.handleInputRows(("s",), iter([part]), None)
        return out.loc[0, "answer"], out.loc[0, "n_deltas"]

    assert give([(n, "delta", f"{n} ") for n in (3, 1, 2, 1)]) == ("1 2 3 ", 3)
    assert handle.calls() <= 5
    assert give([(2, "delta", "two "), (4, "delta", "4"), (5, "done", None)]) == ("1 two 3 4", 4)
