"""From ranked rows to citations, source blocks and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wording


def _in_order(rows: Column, name: str) -> Column:
    return F.transform(F.array_sort(rows), lambda r: r[name])


def with_sources(ranked: DataFrame) -> DataFrame:
    """Add each row's numbered source label and block."""
    label = wording.source_label(F.col("original_filename"), F.col("page_number"), F.col("heading"))
    block = wording.source_block(F.col("n"), label, F.col("content"))
    return ranked.withColumn("source_label", label).withColumn("source_block", block)


def citation_struct() -> Column:
    return F.struct(
        F.col("n").cast("int").alias("n"),
        F.col("document_id").cast("string").alias("document_id"),
        F.col("original_filename").alias("filename"),
        F.col("page_number").cast("int").alias("page_number"),
        F.col("heading").alias("heading"),
        F.col("score").cast("double").alias("score"),
    )


def prompts(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per question: citations and prompt, or the fixed answer without hits.

    A question gathers at most top_k rows. ``user_prompt`` is null when nothing
    was found; then ``answer`` is filled and no model call is due. A question that
    has an ``error`` was not searched for: it gets neither, and keeps its error.
    """
    rows = with_sources(ranked).select(
        "question_id", F.struct("n", citation_struct().alias("citation"), "source_block").alias("row")
    )
    grouped = rows.groupBy("question_id").agg(F.collect_list("row").alias("rows"))
    joined = questions.withColumn("question_id", F.col("question_id").cast("string")).join(
        grouped, "question_id", "left"
    )
    blocks = F.array_join(_in_order(F.col("rows"), "source_block"), "\n\n")
    no_citation = F.array().cast("array<struct<n:int,document_id:string,filename:string,page_number:int,heading:string,score:double>>")
    voice = F.col("voice") if "voice" in questions.columns else F.lit(False)
    lang = F.col("lang") if "lang" in questions.columns else F.lit(None).cast("string")
    error = F.col("error") if "error" in questions.columns else F.lit(None).cast("string")
    return joined.select(
        "question_id",
        "question",
        F.coalesce(_in_order(F.col("rows"), "citation"), no_citation).alias("citations"),
        F.when(F.col("rows").isNotNull(), wording.user_prompt(F.col("question"), blocks)).alias("user_prompt"),
        wording.system_prompt(voice, lang).alias("system_prompt"),
        F.when(F.col("rows").isNull() & error.isNull(), F.lit(wording.NO_HITS_ANSWER)).alias("answer"),
        error.alias("error"),
    )
