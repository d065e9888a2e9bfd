"""From raw documents to token ids: five stages, each over everything its predecessor kept.

Quality rejects documents, near-duplicate removal keeps one of each class, decontamination
drops documents that hold test items, personal data are replaced, and texts become token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import bpe, decontam, pseudonym, quality, similar
from passagemill.llm.queries import byte_bpe_path, pseudonym_key
from passagemill.llm.shared import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity of their language accepts."""
    return quality.accepted_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: 5-word shingles, similarity 0.8."""
    return similar.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without test items."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms in their texts."""
    done = pseudonym.replace_personal(docs, pseudonym_key(spark)).drop("personal")
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the hashes of the ids and of what they decode to."""
    return bpe.encode_documents(docs, byte_bpe_path()).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("personal_data", replace_personal),
    ("encoding", encode),
]

#: Models, fingerprints, retrieval and encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
