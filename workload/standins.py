"""How the given tables stand in for the engine's inputs, in Spark and in SQL.

Each Spark function has a SQL twin: named common table expressions, joined by
``with_ctes`` in the order they are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.config import EngineConfig
from passagemill.operators.parse import assemble_pages
from passagemill.session import spread

# 128 slots keep the hashed model's vectors small enough for the SQL twin.
CFG = EngineConfig(embedding_dim=128)
# Small windows, so that conversation sections are cut into several pieces.
SMALL = EngineConfig(chunk_size=64, chunk_overlap=16, embedding_dim=128)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# White space of the text rules, spelled for SQL regular expressions.
WS = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
HEADING_SQL = rf"(?m)^#{{1,3}}[{WS}]+(.+?)[{WS}]*$"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def with_ctes(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


# Registry -------------------------------------------------------------------

MIME_BY_LANG = {"en": "application/pdf", "fr": "image/PNG", "de": "text/plain", "es": "image/jpeg"}


def mime_of_lang(lang: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, mime in MIME_BY_LANG.items():
        out = F.when(lang == name, F.lit(mime)).otherwise(out)
    return out


MIME_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MIME_BY_LANG.items()) + " END"


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Registry rows: labels give the status, sources are collections, languages users."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    doc_id = F.col("doc_id").cast("string")
    name = F.concat(F.lit("doc_"), doc_id, F.lit(".md"))
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("n_chars") * 60)
    bad = F.col("quality") == 0
    return rows.select(
        doc_id.alias("document_id"),
        name.alias("original_filename"),
        mime_of_lang(F.col("lang")).alias("file_type"),
        F.when(F.col("quality").isNull(), F.lit(""))
        .otherwise(F.concat(F.lit("/data/storage/originals/"), doc_id, F.lit("__"), name))
        .alias("storage_path"),
        F.lit(None).cast("string").alias("markdown_storage_path"),
        F.when(bad, F.lit("failed"))
        .when(F.col("toxic") == 1, F.lit("processing"))
        .otherwise(F.lit("completed"))
        .alias("status"),
        F.when(bad, F.lit("unreadable file")).alias("error_message"),
        F.col("lang").alias("user_id"),
        F.col("source").alias("collection"),
        F.lit("{}").alias("metadata"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


REGISTRY = f"""registry AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS document_id,
         'doc_' || d.doc_id || '.md' AS original_filename,
         {MIME_SQL} AS file_type,
         CASE WHEN l.quality IS NULL THEN ''
              ELSE '/data/storage/originals/' || d.doc_id || '__doc_' || d.doc_id || '.md' END AS storage_path,
         CASE WHEN l.quality = 0 THEN 'failed' WHEN l.toxic = 1 THEN 'processing' ELSE 'completed' END AS status,
         CASE WHEN l.quality = 0 THEN 'unreadable file' END AS error_message,
         d.lang AS user_id, d.source AS collection,
         1704067200 + d.n_chars * 60 AS created_s
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


# Chunks ---------------------------------------------------------------------


def vector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """One chunk per embedding; the vector number is the document."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding", "label"
    )


def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("original_filename"),
        F.col("text").alias("markdown"),
    )


DOC_TEXTS = """texts AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, 'doc_' || doc_id || '.md' AS original_filename, text AS markdown
  FROM documents)"""


def conversation_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as parsed pages; the role is the page's heading."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"),
        (F.col("turn") + 1).cast("int").alias("page_no"),
        F.concat(F.lit("# "), F.col("role"), F.lit("\n\n"), F.col("text")).alias("text"),
    )


CONV_PAGES = """conv_pages AS (
  SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn + 1 AS INTEGER) AS page_no,
         '# ' || role || chr(10) || chr(10) || text AS text
  FROM conversations)"""


def conversation_texts(spark: SparkSession, sf: str) -> DataFrame:
    pages = assemble_pages(conversation_pages(spark, sf))
    return pages.withColumn("original_filename", F.concat(F.lit("conv_"), F.col("document_id"), F.lit(".md")))


CONV_TEXTS = f"""conv_numbered AS (
  SELECT document_id, text, row_number() OVER (PARTITION BY document_id ORDER BY page_no) AS pos,
         count(*) OVER (PARTITION BY document_id) AS n
  FROM conv_pages),
conv_texts AS (
  SELECT document_id, 'conv_' || document_id || '.md' AS original_filename,
         string_agg(CASE WHEN n = 1 THEN text
                         ELSE '<!-- page: ' || pos || ' -->' || chr(10) || chr(10) || {strip_sql('text')} END,
                    chr(10) || chr(10) ORDER BY pos) AS markdown
  FROM conv_numbered GROUP BY document_id)"""


def sections_ctes(source: str, out: str) -> str:
    """Sections of ``source`` (document_id, original_filename, markdown) by the heading rule."""
    return f"""{out}_cut AS (
  SELECT document_id, original_filename, markdown,
         regexp_split_to_array(markdown, '{HEADING_SQL}') AS bodies,
         regexp_extract_all(markdown, '{HEADING_SQL}', 1) AS heads
  FROM {source}),
{out}_all AS (
  SELECT document_id, original_filename, markdown, i,
         CASE WHEN i > 1 THEN {strip_sql('heads[i - 1]')} END AS heading,
         {strip_sql('bodies[i]')} AS body
  FROM (SELECT *, unnest(range(1, len(bodies) + 1)) AS i FROM {out}_cut)),
{out}_kept AS (
  SELECT document_id, original_filename, i, heading, body FROM {out}_all WHERE body <> ''
  UNION ALL
  SELECT document_id, original_filename, 1, NULL, {strip_sql('markdown')} FROM {source} s
  WHERE {strip_sql('markdown')} <> ''
    AND NOT EXISTS (SELECT 1 FROM {out}_all a WHERE a.document_id = s.document_id AND a.body <> '')),
{out} AS (
  SELECT document_id, original_filename, heading, body,
         CAST(row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS INTEGER) AS section_no
  FROM {out}_kept)"""


MARKER_SQL = r"(?i)<!--[" + WS + r"]*page:[" + WS + r"]*(\d+)[" + WS + r"]*-->"


def last_mark(text: str) -> str:
    return f"CAST(list_extract(regexp_extract_all({text}, '{MARKER_SQL}', 1), -1) AS INTEGER)"


def chunks_ctes(sections: str, out: str, cfg: EngineConfig) -> str:
    """Token windows of sections with page carry and chunk numbers."""
    size, stride = cfg.chunk_size, cfg.stride
    return f"""{out}_tok AS (
  SELECT *, regexp_extract_all(body, '[{WS}]*[^{WS}]+') AS toks,
         last_value({last_mark('body')} IGNORE NULLS)
           OVER (PARTITION BY document_id ORDER BY section_no) AS carried
  FROM {sections}),
{out}_win AS (
  SELECT document_id, original_filename, heading, section_no, carried, toks, w
  FROM (SELECT *, unnest(range(0, CASE WHEN len(toks) <= {size} THEN 1
               ELSE 1 + CAST(ceil((len(toks) - {size}) / {float(stride)}) AS BIGINT) END)) AS w FROM {out}_tok)),
{out} AS (
  SELECT document_id, original_filename, heading,
         CAST(row_number() OVER (PARTITION BY document_id ORDER BY section_no, w) - 1 AS INTEGER) AS chunk_index,
         coalesce({last_mark('content')}, carried) AS page_number, content, token_count
  FROM (SELECT *, array_to_string(toks[w * {stride} + 1 : w * {stride} + {size}], '') AS content,
               CAST(least({size}, len(toks) - w * {stride}) AS INTEGER) AS token_count FROM {out}_win))"""


# Hashed vectors -------------------------------------------------------------


def slots_ctes(source: str, key: str, text: str, out: str, dim: int) -> str:
    """Sparse hashed vectors (key, slot, v) of texts, unit length, single precision."""
    return f"""{out}_words AS (
  SELECT {key}, unnest(regexp_extract_all(lower({text}), '[^{WS}]+')) AS word FROM {source}),
{out}_counts AS (
  SELECT {key}, CAST('0x' || substr(md5(word), 1, 8) AS UBIGINT) % {dim} AS slot, count(*) AS c
  FROM {out}_words GROUP BY ALL),
{out} AS (
  SELECT {key}, slot, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS v
  FROM {out}_counts)"""


INPUT_SQL = (
    "original_filename || CASE WHEN coalesce(heading, '') <> '' THEN chr(10) || '# ' || heading ELSE '' END"
    " || chr(10) || chr(10) || content"
)


# Questions ------------------------------------------------------------------


def text_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts as questions; their own shape decides scope, top_k and voice."""
    q = F.col("text")
    size = F.length(q)
    item = F.col("item_id").cast("string")
    return table(spark, sf, "benchmark").select(
        item.alias("question_id"),
        q.alias("question"),
        F.when(q.startswith("T"), F.concat(F.lit("src"), (size % 20).cast("string"))).otherwise(F.lit("")).alias("collection"),
        F.when(size > 250, F.lit("en")).when(size < 130, F.lit("")).alias("user_id"),
        F.when(q.startswith("A"), (size % 100).cast("string")).alias("document_id"),
        F.when(size % 2 == 0, (size % 9 + 1).cast("int")).alias("top_k"),
        (size % 3 == 0).alias("voice"),
        F.when(size % 5 == 0, F.lit("EN")).when(size % 5 == 1, F.lit("sv")).when(size % 5 == 2, F.lit("xx")).alias("lang"),
    )


QUESTIONS = """questions AS (
  SELECT CAST(item_id AS VARCHAR) AS question_id, text AS question,
         CASE WHEN starts_with(text, 'T') THEN 'src' || (length(text) % 20) ELSE '' END AS collection,
         CASE WHEN length(text) > 250 THEN 'en' WHEN length(text) < 130 THEN '' END AS user_id,
         CASE WHEN starts_with(text, 'A') THEN CAST(length(text) % 100 AS VARCHAR) END AS document_id,
         CASE WHEN length(text) % 2 = 0 THEN CAST(length(text) % 9 + 1 AS INTEGER) END AS top_k,
         length(text) % 3 = 0 AS voice,
         CASE length(text) % 5 WHEN 0 THEN 'EN' WHEN 1 THEN 'sv' WHEN 2 THEN 'xx' END AS lang
  FROM benchmark)"""
