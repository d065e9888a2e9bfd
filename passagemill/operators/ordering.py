"""Ordered work inside a key that may hold a large share of all rows.

Each function cuts a key into runs of ``SPAN`` order values, does the work in
every run in parallel, and then combines one row per run. No task sees all rows
of a hot key; only the run summaries, 1/SPAN of them, meet again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1024


def _run_no(order: str, span: int) -> Column:
    return F.floor(F.col(order) / F.lit(span))


def _sorted_texts(rows: Column) -> Column:
    return F.transform(F.array_sort(rows), lambda r: r["text"])


def concat_in_order(
    df: DataFrame, keys: Sequence[str], order: str, text: str, separator: str = "", span: int = SPAN
) -> DataFrame:
    """One row per key: its texts joined in order. Null texts count as empty."""
    keys = list(keys)
    value = F.coalesce(F.col(text), F.lit(""))
    # Rows move before they are collected: lists made before the move are as large, and sorting for them spills.
    rows = df.select(*keys, _run_no(order, span).alias("_run"), F.col(order).alias("_at"), value.alias("_text"))
    runs = (
        rows.repartition(*keys, "_run")
        .groupBy(*keys, "_run")
        .agg(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_text").alias("text"))).alias("_rows"))
        .select(*keys, "_run", F.array_join(_sorted_texts(F.col("_rows")), separator).alias("_text"))
    )
    return (
        runs.groupBy(*keys)
        .agg(F.collect_list(F.struct(F.col("_run").alias("at"), F.col("_text").alias("text"))).alias("_rows"))
        .select(*keys, F.array_join(_sorted_texts(F.col("_rows")), separator).alias(text))
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, span: int = SPAN
) -> DataFrame:
    """The sum of ``value`` over the rows before each row, in order, per key.

    Sums are taken inside each run; what comes before a run is a running sum
    over one row per run.
    """
    keys = list(keys)
    marked = df.withColumn("_run", _run_no(order, span))
    sums = marked.groupBy(*keys, "_run").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_run", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = marked.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(offsets, [*keys, "_run"])
    return ranked.withColumn(out, F.col("_before") + F.col("_in")).drop("_run", "_in", "_before")


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, span: int = SPAN
) -> DataFrame:
    """The last non-null ``value`` at or before each row, in order, per key."""
    keys = list(keys)
    marked = df.withColumn("_run", _run_no(order, span))
    filled = F.when(F.col(value).isNotNull(), F.col(order))
    last_of_run = marked.groupBy(*keys, "_run").agg(F.max_by(F.col(value), filled).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    incoming = last_of_run.select(
        *keys, "_run", F.last("_last", ignorenulls=True).over(before).alias("_in")
    )
    upto = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    here = marked.withColumn("_here", F.last(value, ignorenulls=True).over(upto))
    return (
        here.join(incoming, [*keys, "_run"])
        .withColumn(out, F.coalesce("_here", "_in"))
        .drop("_run", "_here", "_in")
    )


def release_in_order(arrived: DataFrame, keys: Sequence[str], seq: str, failed: str) -> DataFrame:
    """Arrived results up to the first missing number (from 1), failures skipped.

    A number is the end of the gap-free prefix when its successor has not
    arrived. Looking for successors is a join on (key, number), which is unique,
    so a long stream spreads over all tasks. Of a repeated number the row that did
    not fail wins, then the least by the other columns in their order.
    """
    keys = list(keys)
    place = [*keys, seq]
    others = [c for c in arrived.columns if c not in place]
    bad = F.coalesce(F.col(failed), F.lit(True)).alias("_bad")
    winner = F.min(F.struct(bad, *[F.col(c) for c in others])).alias("_row")
    rows = arrived.filter(F.col(seq) >= 1).groupBy(*place).agg(winner)
    rows = rows.select(*[F.col(c) if c in place else F.col("_row").getField(c).alias(c) for c in arrived.columns])
    has_next = rows.select(*keys, (F.col(seq) - 1).alias(seq))
    numbers = rows.select(*keys, seq).unionByName(
        rows.groupBy(*keys).agg(F.lit(0).cast("bigint").alias(seq))
    )
    ends = (
        numbers.join(has_next, [*keys, seq], "left_anti").groupBy(*keys).agg(F.min(seq).alias("_end"))
    )
    return rows.join(ends, keys).filter((F.col(seq) <= F.col("_end")) & ~F.col(failed)).drop("_end")
