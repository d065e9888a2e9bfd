"""Texts shown to a model or a reader: sources, prompts, labels, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt texts, language names and the answer without sources.
SYSTEM_PROMPT = (
    "You are a warm, helpful assistant that answers questions from the user's documents. "
    "Use a friendly, conversational tone - clear and human, never robotic - but stay focused "
    "and avoid filler. Answer ONLY using the provided sources; never invent facts or rely on "
    "outside knowledge. Cite sources inline as [#] using the source numbers shown. If the "
    "answer is not in the sources, say so honestly and kindly, and suggest what the user "
    "could try next (rephrasing the question, or sharing a document that covers it)."
)
SYSTEM_PROMPT_VOICE = (
    "You are a warm, helpful voice assistant that answers from the user's documents. Speak "
    "naturally and kindly, the way you would help a colleague - clear and easy to follow "
    "aloud, but never invent facts. Answer ONLY using the provided sources. Do NOT include "
    "bracketed citation markers like [1], [2] in your spoken text; the UI shows sources "
    "separately. Keep answers concise. If the answer is not in the sources, say so honestly "
    "in a sentence or two and gently suggest what the user could try next."
)
NO_HITS_ANSWER = (
    "I looked through the indexed documents but couldn't find anything relevant to that "
    "question. Try rephrasing it, or upload a document that covers this topic and I'll take "
    "another look."
)
LANGUAGES = {"en": "English", "sv": "Swedish"}
CLOSING_INSTRUCTION = (
    "Please answer the question using only these sources, in a warm and conversational "
    "tone. Cite with [#]."
)
EMPTY_ANSWER = "(empty answer)"
UNNAMED_FILE = "upload.bin"


def present(text: Column) -> Column:
    """True for a text that is neither null nor empty."""
    return F.coalesce(text != "", F.lit(False))


def filled_page(page: Column) -> Column:
    return F.coalesce(page != 0, F.lit(False))


def embedding_input(filename: Column, heading: Column, content: Column) -> Column:
    """The text given to the embedder; the stored content stays raw."""
    title = F.when(present(heading), F.concat(F.lit("\n# "), heading)).otherwise(F.lit(""))
    return F.concat(F.coalesce(filename, F.lit("")), title, F.lit("\n\n"), content)


def source_label(filename: Column, page: Column, heading: Column) -> Column:
    """``file, p.N — heading``; an absent page or heading is left out."""
    return F.concat(
        filename,
        F.when(filled_page(page), F.concat(F.lit(", p."), page.cast("string"))).otherwise(F.lit("")),
        F.when(present(heading), F.concat(F.lit(" — "), heading)).otherwise(F.lit("")),
    )


def source_block(n: Column, label: Column, content: Column) -> Column:
    return F.concat(F.lit("["), n.cast("string"), F.lit("] ("), label, F.lit(")\n"), content)


def user_prompt(question: Column, blocks: Column) -> Column:
    return F.concat(
        F.lit("Question: "), question, F.lit("\n\nSources:\n"), blocks, F.lit("\n\n" + CLOSING_INSTRUCTION)
    )


def system_prompt(voice: Column, lang: Column) -> Column:
    base = F.when(F.coalesce(voice, F.lit(False)), F.lit(SYSTEM_PROMPT_VOICE)).otherwise(F.lit(SYSTEM_PROMPT))
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    name = F.try_element_at(names, F.lower(F.coalesce(lang, F.lit(""))))
    return F.when(name.isNull(), base).otherwise(F.concat(base, F.lit(" Answer in "), name, F.lit(".")))


def citation_label(n: Column, filename: Column, page: Column, heading: Column, score: Column) -> Column:
    """``[n] file - p.N - heading (score 0.83)``, absent parts left out."""
    where = F.concat_ws(
        " - ",
        F.when(present(filename), filename),
        F.when(filled_page(page), F.concat(F.lit("p."), page.cast("string"))),
        F.when(present(heading), heading),
    )
    shown = F.when(score.isNotNull(), F.format_string(" (score %.2f)", score)).otherwise(F.lit(""))
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), where, shown)


def format_bytes(size: Column) -> Column:
    """Human size in steps of 1024 up to GB."""
    n = size.cast("double")
    step = (
        F.when(n >= 1024.0**3, 3).when(n >= 1024.0**2, 2).when(n >= 1024.0, 1).otherwise(0)
    )
    value = n / F.pow(F.lit(1024.0), step)
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), step + 1)
    digits = F.when(
        (value >= 10) | (step == 0), F.format_string("%.0f", value)
    ).otherwise(F.format_string("%.1f", value))
    unusable = n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")) | (n <= 0)
    return F.when(unusable, F.lit("0 B")).otherwise(F.concat(digits, F.lit(" "), unit))


def short_id(document_id: Column) -> Column:
    return F.concat(F.substring(document_id, 1, 8), F.lit("..."))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def shorten_error(message: Column, limit: int = 1000) -> Column:
    return F.substring(message, 1, limit)
