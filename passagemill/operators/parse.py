"""From file bytes to Markdown: the parser hook, HTML, and page assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.wording import shorten_error
from ..schemas import PARSED_PAGE
from ..session import BATCH_BYTES
from .ordering import SPAN

ParseFn = Callable[[bytes], list[str]]


def parse_files(files: DataFrame, make_parser: Callable[[], ParseFn]) -> DataFrame:
    """Run a user parser over (document_id, content): one row per page.

    The parser is built once per task. A file that raises yields one row with
    the error, so that the other files go on. Pages of small files leave together: a frame for each file costs more than most parsers.
    """

    def pages_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = make_parser()
        waiting, size = [], 0
        for batch in batches:
            for document_id, content in zip(batch["document_id"], batch["content"]):
                try:
                    texts = parse(content)
                    rows = [(document_id, i, text, None) for i, text in enumerate(texts, start=1)]
                    rows = rows or [(document_id, 0, None, None)]
                except Exception as exc:  # noqa: BLE001 - any parser failure belongs to its file
                    rows = [(document_id, 0, None, str(exc)[:1000])]
                waiting += rows
                size += sum(len(text or "") + 64 for _, _, text, _ in rows)
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(waiting, columns=PARSED_PAGE.names)
                    waiting, size = [], 0
        if waiting:
            yield pd.DataFrame(waiting, columns=PARSED_PAGE.names)

    return files.select("document_id", "content").mapInPandas(pages_of, PARSED_PAGE)


def document_markdown(
    pages: DataFrame, key: str = "document_id", order: str = "page_no", text: str = "text", error: str | None = "error"
) -> DataFrame:
    """(key, markdown, error) of every document from its page rows, in one pass.

    A single page is kept as it is. With several, each is stripped and put below
    a marker with its position. Numbers below 1 are not pages: they only carry an
    error, and a document without pages has an empty text. Texts are joined per
    run of pages first; one row per run, with the count of pages before it, then
    makes up the document.
    """
    at = F.col(order)
    page = F.when(at >= 1, F.struct(at.alias("at"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    message = F.col(error) if error else F.lit(None).cast("string")
    runs = (
        pages.groupBy(key, F.floor(at / F.lit(SPAN)).alias("_run"))
        .agg(F.array_sort(F.collect_list(page)).alias("_rows"), F.min(message).alias("_error"))
        .withColumn("_n", F.size("_rows"))
    )
    by_key = Window.partitionBy(key)
    before = by_key.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "_pages", F.sum("_n").over(by_key)
    )

    def marked(row: Column, i: Column) -> Column:
        number = (F.col("_before") + i + 1).cast("string")
        return F.concat(F.lit("<!-- page: "), number, F.lit(" -->\n\n"), strip(row["text"]))

    joined = F.array_join(F.transform("_rows", marked), "\n\n")
    only = F.try_element_at(F.col("_rows"), F.lit(1))["text"]
    shown = F.when(F.col("_pages") == 1, only).otherwise(joined)
    part = F.when(F.col("_n") > 0, F.struct("_run", shown.alias("text")))
    return (
        placed.select(key, part.alias("_part"), "_error")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("_part")).alias("_parts"), F.min("_error").alias("_error"))
        .select(
            key,
            F.array_join(F.transform("_parts", lambda p: p["text"]), "\n\n").alias("markdown"),
            shorten_error(F.col("_error")).alias("error"),
        )
    )


def assemble_pages(
    pages: DataFrame, key: str = "document_id", order: str = "page_no", text: str = "text"
) -> DataFrame:
    """One Markdown text per document from its page rows, numbered from 1."""
    return document_markdown(pages, key, order, text, error=None).drop("error")


# The HTML parts dropped whole, and the entities read back.
DROPPED_HTML = ["script", "style", "nav", "footer", "head"]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def html_to_markdown(html: Column) -> Column:
    """An offline parser for web pages: headings, paragraphs, plain text."""
    out = html
    for tag in DROPPED_HTML:
        out = F.regexp_replace(out, rf"(?is)<{tag}[ >].*?</{tag}>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    for level in (1, 2, 3):
        out = F.regexp_replace(out, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    out = F.regexp_replace(out, r"(?i)<br[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?i)</?(p|div|article|li|ul|ol|section)[^>]*>", "\n\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(out, r"\n[ \n]*\n", "\n\n"))
