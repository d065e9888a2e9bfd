"""The registered queries of this subpackage; each reads its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import (
    bpe, decontam, graph_ann, iblt, katz, merkle, oracle, pseudonym, quality, secrets, simhash, spelling, substring, toxicity,
)
from passagemill.llm.shared import table

#: The setting that holds the key of pseudonyms, and the key of sessions that have none: known to every reader, so for tests only.
PSEUDONYM_SETTING, PSEUDONYM_KEY = "spark.passagemill.pseudonym.key", "linked-across-documents"


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get(PSEUDONYM_SETTING, PSEUDONYM_KEY)


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Pairs seen once are part of the model.
ALL_PAIRS = katz.KatzRule(least_pairs=1)


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = toxicity.score_documents(docs, net)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonym.report(table(spark, sf_dir, "documents"), pseudonym_key(spark))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz.score_documents(table(spark, sf_dir, "documents"), remainder(10) != 0, ALL_PAIRS)
    return scored.select(
        "doc_id", (remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), byte_bpe_path(), with_ids=False)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"), remainder(3) == 0, spelling.lower_ascii(F.col("text")))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.against_next(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), drop_one_in=31)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_substring, op3_pseudonyms, op4_neighbours, op5_simhash, op6_katz, op7_quality,
        op8_decontamination, op9_bpe, op10_secrets, op11_manifest, op12_fingerprints, op13_spelling,
    )
}
#: The others cannot be written in SQL whole; tests hold them against brute force.
ORACLE: dict[str, str] = {"op11_manifest": oracle.MERKLE, "op13_spelling": oracle.SPELLING}
