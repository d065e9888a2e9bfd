"""Heading-aware token-window chunks; local to each row, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as txt
from ..session import small_batches, stored
from .ordering import carry_forward, running_total


def section_rows(docs: DataFrame, key: str = "document_id", markdown: str = "markdown") -> DataFrame:
    """One row per section: position, heading, body and its last page marker."""
    rows = docs.select(key, F.posexplode(txt.sections(F.col(markdown))).alias("section_no", "section"))
    return rows.select(
        key,
        "section_no",
        F.col("section.heading").alias("heading"),
        F.col("section.body").alias("body"),
        txt.last_page(F.col("section.body")).alias("marked_page"),
    )


def chunks_of(markdown: Column, cfg: EngineConfig, windows=None) -> Column:
    """``array<struct<content, heading, page_number, token_count>>`` of one text.

    The page of a window is its own last marker, else the last marker of all
    sections up to and including its own.
    """
    make_windows = windows or (lambda body: txt.token_windows(body, cfg))

    def section_chunks(s: Column, carried: Column) -> Column:
        def chunk(w: Column) -> Column:
            return F.struct(
                w["content"].alias("content"),
                s["heading"].alias("heading"),
                F.coalesce(txt.last_page(w["content"]), carried).alias("page_number"),
                w["token_count"].alias("token_count"),
            )

        return F.transform(make_windows(s["body"]), chunk)

    def all_chunks(sections: Column) -> Column:
        pages = txt.carried_pages(F.transform(sections, lambda s: txt.last_page(s["body"])))
        return F.flatten(F.zip_with(sections, pages, section_chunks))

    return txt.let(txt.sections(markdown), all_chunks)


def chunk_documents(
    docs: DataFrame, cfg: EngineConfig, markdown: str = "markdown", keep: tuple[str, ...] = ("document_id",)
) -> DataFrame:
    """Explode every document into numbered chunks."""
    rows = docs.select(*keep, F.posexplode(chunks_of(F.col(markdown), cfg)).alias("chunk_index", "c"))
    return rows.select(*keep, "chunk_index", "c.page_number", "c.heading", "c.content", "c.token_count")


def chunk_documents_encoded(
    docs: DataFrame, windows: Callable[[Column], Column], key: str = "document_id", markdown: str = "markdown"
) -> DataFrame:
    """The same chunks with a user encoder's windows (``text.encoder_windows``).

    Sections become rows for the vectorised encoder, and the encoded windows are
    stored once. Chunk numbers and carried pages come from one narrow row per
    section, so a long document is spread over all tasks.
    """
    small_batches(docs.sparkSession)
    sections = section_rows(docs, key, markdown)
    cut = stored(
        sections.select(
            key, "section_no", "heading", "marked_page", F.posexplode(windows(F.col("body"))).alias("window_no", "w")
        ),
        "windows",
    )
    sized = cut.groupBy(key, "section_no").agg(
        F.count(F.lit(1)).alias("_windows"), F.first("marked_page").alias("marked_page")
    )
    placed = running_total(sized, [key], "section_no", "_windows", "_first")
    placed = carry_forward(placed, [key], "section_no", "marked_page", "_carried")
    rows = cut.drop("marked_page").join(placed.select(key, "section_no", "_first", "_carried"), [key, "section_no"])
    return rows.select(
        key,
        (F.col("_first") + F.col("window_no")).cast("int").alias("chunk_index"),
        F.coalesce(txt.last_page(F.col("w.content")), F.col("_carried")).alias("page_number"),
        "heading",
        F.col("w.content").alias("content"),
        F.col("w.token_count").alias("token_count"),
    )
