"""Intake, parsing, chunking, embedding and whole ingest runs."""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.config import EngineConfig
from passagemill.functions import text as txt
from passagemill.functions.vectors import HashedWords, micro_text
from passagemill.functions.wording import embedding_input
from passagemill.operators.chunk import chunk_documents, chunk_documents_encoded, section_rows
from passagemill.operators.embed import attach_vectors, embed_chunks
from passagemill.operators.ordering import carry_forward
from passagemill.operators.parse import assemble_pages, document_markdown, html_to_markdown, parse_files
from passagemill.operators.validate import check_questions, check_uploads
from passagemill.plans.ingest import run_ingest
from passagemill.session import new_run_dir, spread
from passagemill.sources.events import embedding_rows
from passagemill.sources.files import register, scan_files, store_path
from passagemill.sources.tables import Tables
from passagemill.streaming.ingest import stream_ingest
from passagemill.streaming.intake import REJECTED, arriving_files, stream_file_intake, taken

from . import standins as st
from .standins import CFG, SMALL, WS, strip_sql, table, with_ctes

RUN_TS = datetime(2024, 2, 1, tzinfo=timezone.utc)


# Intake ---------------------------------------------------------------------


def file_intake(spark: SparkSession, sf: str) -> DataFrame:
    files = scan_files(spark, sf, CFG.max_upload_bytes)
    reason = F.when(F.col("content").isNull(), F.lit("larger than the upload limit"))
    return files.select("filename", "mime", "length", F.md5("content").alias("digest"), reason.alias("reason"))


def streamed_intake(spark: SparkSession, sf: str) -> DataFrame:
    """The table files as they arrive: checked once, accepted ones with a digest of their content, the others with their code."""
    root = new_run_dir(spark, "intake")
    cfg = EngineConfig(allowed_mime_types="application/octet-stream", max_upload_mb=1)
    stream_file_intake(arriving_files(spark, sf, 4), root, cfg, f"{root}/checkpoint").awaitTermination()
    good = taken(spark, root).select("filename", "mime", "length", F.md5("content").alias("digest"), F.lit(None).cast("int").alias("reject_code"))
    return good.unionByName(taken(spark, root, REJECTED).select("filename", "mime", "length", F.lit(None).cast("string").alias("digest"), "reject_code"))


def upload_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    name = F.concat(F.lit("inbox/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select(
        "doc_id",
        F.when(F.col("lang") == "es", F.lit("")).otherwise(name).alias("filename"),
        st.mime_of_lang(F.col("lang")).alias("mime"),
        (F.col("n_chars") * 1024).alias("length"),
        F.concat(F.lit(" "), F.col("source"), F.lit("\n")).alias("collection"),
        F.when(F.col("lang") == "fr", F.lit(" \t")).otherwise(F.col("lang")).alias("user_id"),
    )


def register_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = register(upload_rows(spark, sf), CFG, F.col("doc_id"), F.lit(RUN_TS).cast("timestamp"))
    return rows.select(
        "document_id", "original_filename", "file_type", "storage_path", "status", "user_id", "collection"
    )


REGISTER_SQL = f"""WITH ids AS (
  SELECT md5(CAST(doc_id AS VARCHAR)) AS h, * FROM documents),
named AS (
  SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4)
           || '-' || substr(h, 21, 12) AS document_id,
         CASE WHEN lang = 'es' THEN 'upload.bin' ELSE 'inbox/doc_' || doc_id || '.md' END AS original_filename,
         {st.MIME_SQL} AS file_type, source, lang, doc_id
  FROM ids)
SELECT document_id, original_filename, file_type,
       '/data/storage/originals/' || document_id || '__' ||
         CASE WHEN lang = 'es' THEN 'upload.bin' ELSE 'doc_' || doc_id || '.md' END AS storage_path,
       'uploaded' AS status, CASE WHEN lang <> 'fr' THEN lang END AS user_id, source AS collection
FROM named"""


def storage_path(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", store_path(CFG, F.col("page_id").cast("string"), F.col("url")).alias("storage_path")
    )


STORAGE_PATH_SQL = """SELECT page_id, '/data/storage/originals/' || page_id || '__' ||
  regexp_extract(url, '[^/]*$') AS storage_path FROM pages"""


def validate_uploads(spark: SparkSession, sf: str) -> DataFrame:
    return check_uploads(upload_rows(spark, sf), CFG).select("doc_id", "reject_code")


VALIDATE_UPLOADS_SQL = f"""SELECT doc_id,
  CASE WHEN lower({st.MIME_SQL}) NOT IN ('application/pdf', 'image/jpeg', 'image/jpg', 'image/png') THEN 415
       WHEN n_chars * 1024 > 50 * 1024 * 1024 THEN 413 END AS reject_code
FROM documents"""


def validate_questions(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("question"), (F.col("n_chars") % 60).cast("int").alias("top_k")
    )
    return check_questions(asked).select("doc_id", "reason")


VALIDATE_QUESTIONS_SQL = """SELECT doc_id,
  CASE WHEN length(text) < 1 THEN 'question too short' WHEN length(text) > 2000 THEN 'question too long'
       WHEN n_chars % 60 NOT BETWEEN 1 AND 50 THEN 'top_k out of range' END AS reason
FROM documents"""


# Parsing --------------------------------------------------------------------


def web_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "pages"), "page_id").select(
        F.col("page_id").cast("string").alias("document_id"),
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("original_filename"),
        html_to_markdown(F.col("html")).alias("markdown"),
    )


def _html_sql(html: str) -> str:
    out = html
    for tag in ("script", "style", "nav", "footer", "head"):
        out = f"regexp_replace({out}, '(?is)<{tag}[ >].*?</{tag}>', '', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', '', 'g')"
    for level in (1, 2, 3):
        heading = f"chr(10) || chr(10) || '{'#' * level} \\1' || chr(10) || chr(10)"
        out = f"regexp_replace({out}, '(?is)<h{level}[^>]*>(.*?)</h{level}>', {heading}, 'g')"
    out = f"regexp_replace({out}, '(?i)<br[^>]*>', chr(10), 'g')"
    out = f"regexp_replace({out}, '(?i)</?(p|div|article|li|ul|ol|section)[^>]*>', chr(10) || chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return strip_sql(f"regexp_replace({out}, '\\n[ \\n]*\\n', chr(10) || chr(10), 'g')")


WEB_TEXTS = f"""web_texts AS (
  SELECT CAST(page_id AS VARCHAR) AS document_id, 'page_' || page_id AS original_filename,
         {_html_sql('html')} AS markdown
  FROM pages)"""


def markdown_of_html(spark: SparkSession, sf: str) -> DataFrame:
    return web_markdown(spark, sf).select("document_id", "markdown")


def paragraph_parser():
    """A user parser for the hook: paragraphs are pages; German pages are refused."""

    def parse(content: bytes) -> list[str]:
        html = bytes(content).decode("utf-8")
        if 'lang="de"' in html:
            raise ValueError("unsupported language: de")
        return html.split("</p>")

    return parse


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "pages"), "page_id").select(
        F.col("page_id").cast("string").alias("document_id"), F.encode("html", "UTF-8").alias("content")
    )


def parse_hook(spark: SparkSession, sf: str) -> DataFrame:
    return parse_files(page_files(spark, sf), paragraph_parser)


PARSE_HOOK_SQL = """SELECT CAST(page_id AS VARCHAR) AS document_id, CAST(i AS INTEGER) AS page_no,
       string_split(html, '</p>')[i] AS text, CAST(NULL AS VARCHAR) AS error
FROM (SELECT *, unnest(range(1, len(string_split(html, '</p>')) + 1)) AS i FROM pages
      WHERE NOT contains(html, 'lang="de"'))
UNION ALL
SELECT CAST(page_id AS VARCHAR), 0, NULL, 'unsupported language: de' FROM pages WHERE contains(html, 'lang="de"')"""


def assembled_pages(spark: SparkSession, sf: str) -> DataFrame:
    return st.conversation_texts(spark, sf).select("document_id", "markdown")


ASSEMBLED_SQL = with_ctes(st.CONV_PAGES, st.CONV_TEXTS, select="SELECT document_id, markdown FROM conv_texts")


# Chunking -------------------------------------------------------------------


def split_sections(spark: SparkSession, sf: str) -> DataFrame:
    return section_rows(web_markdown(spark, sf)).select("document_id", "section_no", "heading", "body")


SPLIT_SECTIONS_SQL = with_ctes(
    WEB_TEXTS, st.sections_ctes("web_texts", "sec"), select="SELECT document_id, section_no, heading, body FROM sec"
)


def page_markers(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("markdown")
    marks = F.array_join(F.transform(txt.page_markers(text), lambda p: p.cast("string")), ",")
    return st.conversation_texts(spark, sf).select(
        "document_id", marks.alias("pages"), txt.last_page(text).alias("last_page")
    )


PAGE_MARKERS_SQL = with_ctes(
    st.CONV_PAGES,
    st.CONV_TEXTS,
    select=rf"""SELECT document_id,
  array_to_string(regexp_extract_all(markdown, '(?i)<!--[{WS}]*page:[{WS}]*(\d+)[{WS}]*-->', 1), ',') AS pages,
  {st.last_mark('markdown')} AS last_page FROM conv_texts""",
)


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    tokens = txt.word_tokens(txt.strip(F.col("text")))
    return spread(table(spark, sf, "documents"), "doc_id").select("doc_id", F.size(tokens).alias("token_count"))


TOKEN_COUNTS_SQL = f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{WS}]+')) AS INTEGER) AS token_count
FROM documents"""


def chunk_texts(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_documents(st.document_texts(spark, sf), CFG)


DOC_CHUNKS = ",\n".join(
    [st.DOC_TEXTS, st.sections_ctes("texts", "sec"), st.chunks_ctes("sec", "chunks", CFG)]
)
CHUNK_COLUMNS = "document_id, chunk_index, page_number, heading, content, token_count"
CHUNK_TEXTS_SQL = with_ctes(DOC_CHUNKS, select=f"SELECT {CHUNK_COLUMNS} FROM chunks")


def chunk_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_documents(st.conversation_texts(spark, sf), SMALL)


def subword_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def chunk_subwords(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks cut by the tokens of a byte-pair vocabulary; a Python encoder, so tests hold it against a plain restatement."""
    codec = txt.SubwordCodec(subword_path())
    return chunk_documents_encoded(st.document_texts(spark, sf), txt.encoder_windows(codec.encode, codec.decode, CFG))


CONV_CHUNKS = ",\n".join(
    [st.CONV_PAGES, st.CONV_TEXTS, st.sections_ctes("conv_texts", "sec"), st.chunks_ctes("sec", "chunks", SMALL)]
)
CHUNK_MARKDOWN_SQL = with_ctes(CONV_CHUNKS, select=f"SELECT {CHUNK_COLUMNS} FROM chunks")


def page_carry(spark: SparkSession, sf: str) -> DataFrame:
    rows = section_rows(st.conversation_texts(spark, sf)).select("document_id", "section_no", "marked_page")
    return carry_forward(rows, ["document_id"], "section_no", "marked_page", "page_number")


PAGE_CARRY_SQL = with_ctes(
    st.CONV_PAGES,
    st.CONV_TEXTS,
    st.sections_ctes("conv_texts", "sec"),
    select=f"""SELECT document_id, section_no, {st.last_mark('body')} AS marked_page,
  last_value({st.last_mark('body')} IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY section_no) AS page_number
FROM sec""",
)


# Embedding ------------------------------------------------------------------


def embedding_inputs(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunk_documents(st.conversation_texts(spark, sf), SMALL, keep=("document_id", "original_filename"))
    text = embedding_input(F.col("original_filename"), F.col("heading"), F.col("content"))
    return rows.select("document_id", "chunk_index", text.alias("input"))


EMBEDDING_INPUT_SQL = with_ctes(CONV_CHUNKS, select=f"SELECT document_id, chunk_index, {st.INPUT_SQL} AS input FROM chunks")


def embedded_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunk_documents(st.document_texts(spark, sf), CFG, keep=("document_id", "original_filename"))
    return embed_chunks(rows, CFG).select("document_id", "chunk_index", micro_text(F.col("embedding")).alias("vector"))


EMBED_SQL = with_ctes(
    DOC_CHUNKS,
    st.slots_ctes("chunks", "document_id, chunk_index", st.INPUT_SQL, "vec", CFG.embedding_dim),
    select=f"""SELECT c.document_id, c.chunk_index,
  string_agg(CAST(CAST(round(coalesce(v.v, 0) * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY s.slot) AS vector
FROM chunks c CROSS JOIN (SELECT unnest(range({CFG.embedding_dim})) AS slot) s
LEFT JOIN vec v ON v.document_id = c.document_id AND v.chunk_index = c.chunk_index AND v.slot = s.slot
GROUP BY ALL""",
)


def attached_vectors(spark: SparkSession, sf: str) -> DataFrame:
    chunks = st.document_texts(spark, sf).select("document_id", F.lit(0).alias("chunk_index"))
    vectors = st.vector_chunks(spark, sf).drop("label")
    return attach_vectors(chunks, vectors).select(
        "document_id", "chunk_index", "vector_missing", micro_text(F.col("embedding")).alias("vector")
    )


ATTACH_SQL = """SELECT CAST(d.doc_id AS VARCHAR) AS document_id, 0 AS chunk_index, e.vec_id IS NULL AS vector_missing,
  CASE WHEN e.vec_id IS NOT NULL THEN
    array_to_string([CAST(CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT) AS VARCHAR) FOR x IN e.embedding], ',') END AS vector
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""


def extracted_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of 64 vectors each, as an embedding service returns them."""
    rows = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 64).alias("batch"), F.struct("vec_id", "embedding").alias("item")
    )
    batches = rows.groupBy("batch").agg(F.array_sort(F.collect_list("item")).alias("items"))
    data = F.transform("items", lambda i: F.struct(i["embedding"].alias("embedding")))
    responses = batches.select("batch", F.to_json(F.struct(data.alias("data"))).alias("payload"))
    return embedding_rows(responses).select("batch", "position", micro_text(F.col("embedding")).alias("vector"))


EXTRACT_EMBEDDINGS_SQL = """SELECT vec_id // 64 AS batch,
  CAST(row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) - 1 AS INTEGER) AS position,
  array_to_string([CAST(CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT) AS VARCHAR) FOR x IN embedding], ',') AS vector
FROM embeddings"""


# Runs -----------------------------------------------------------------------


def registered_rows(spark: SparkSession, sf: str) -> DataFrame:
    return st.registry(spark, sf).withColumn("active_run_id", F.lit(None).cast("string"))


def parsed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Document texts as parser output; documents of bad quality could not be read."""
    bad = st.registry(spark, sf).select("document_id", F.col("error_message").alias("error"))
    texts = st.document_texts(spark, sf).join(bad, "document_id")
    return texts.select("document_id", F.when(F.col("error").isNull(), F.col("markdown")).alias("markdown"), "error")


def run_summary(tables: Tables) -> DataFrame:
    chunks = tables.visible_chunks(CFG).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum("token_count").alias("tokens"),
        F.count_if(F.size("embedding") == CFG.embedding_dim).alias("n_vectors"),
    )
    docs = tables.documents().select("document_id", "status", "error_message")
    return docs.join(chunks, "document_id", "left")


INGEST_SQL = with_ctes(
    st.REGISTRY,
    DOC_CHUNKS,
    select="""SELECT r.document_id, CASE WHEN r.error_message IS NULL THEN 'completed' ELSE 'failed' END AS status,
  r.error_message, c.n_chunks, c.tokens, c.n_chunks AS n_vectors
FROM registry r LEFT JOIN (
  SELECT document_id, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS tokens FROM chunks GROUP BY document_id
) c ON c.document_id = r.document_id AND r.error_message IS NULL""",
)


def ingest_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    tables = Tables(spark, new_run_dir(spark, "ingest")).create_if_missing()
    run_ingest(tables, registered_rows(spark, sf), parsed_texts(spark, sf), CFG, "r1")
    return run_summary(tables)


def streamed_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The same documents through the file stream; the result equals the batch run."""
    root = new_run_dir(spark, "stream-ingest")
    tables = Tables(spark, root).create_if_missing()
    schema = table(spark, sf, "documents").schema
    # one file or a folder of files: a filter by file name finds nothing in a folder, and a plain path must be a folder
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/documents[.]parquet")
    known = registered_rows(spark, sf)
    unreadable = known.select("document_id", F.col("error_message").alias("error"))

    def split(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        texts = batch.select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("markdown"))
        registered = known.join(texts.select("document_id"), "document_id", "left_semi")
        joined = texts.join(unreadable, "document_id")
        markdown = F.when(F.col("error").isNull(), F.col("markdown")).alias("markdown")
        return registered, joined.select("document_id", markdown, "error")

    query = stream_ingest(arriving, split, tables, CFG, f"{root}/checkpoint")
    query.awaitTermination()
    return run_summary(tables)


class ShortTextsOnly(HashedWords):
    """A model that refuses long inputs, to see failures stay with their document."""

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if any(len(self.word.findall(t)) > 400 for t in texts):
            raise ValueError("input longer than 400 words")
        return super().__call__(texts)


def ingest_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Parser errors, blank texts and model errors, each on its own document."""
    tables = Tables(spark, new_run_dir(spark, "failures")).create_if_missing()
    files = page_files(spark, sf)
    started = F.lit(RUN_TS).cast("timestamp")
    registered = files.select(
        "document_id", F.concat(F.lit("page_"), F.col("document_id")).alias("original_filename"),
        F.lit("text/html").alias("file_type"), F.lit("stored").alias("storage_path"),
        F.lit(None).cast("string").alias("markdown_storage_path"), F.lit("uploaded").alias("status"),
        F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("string").alias("user_id"),
        F.lit(None).cast("string").alias("collection"), F.lit("{}").alias("metadata"),
        F.lit(None).cast("string").alias("active_run_id"), started.alias("created_at"), started.alias("updated_at"),
    )

    def make_parser():
        refuse = paragraph_parser()

        def parse(content: bytes) -> list[str]:
            pages = refuse(content)
            return [" \n "] if 'lang="es"' in pages[0] else pages

        return parse

    markdown = document_markdown(parse_files(files, make_parser))
    run_ingest(tables, registered, markdown, CFG, "r1", lambda: ShortTextsOnly(CFG.embedding_dim))
    return tables.documents().select("document_id", "status", "error_message")


INGEST_FAILURES_SQL = with_ctes(
    f"""paras AS (
  SELECT CAST(page_id AS VARCHAR) AS document_id, html, string_split(html, '</p>') AS parts FROM pages),
texts AS (
  SELECT document_id, 'page_' || document_id AS original_filename, html,
         CASE WHEN len(parts) = 1 THEN html ELSE array_to_string(
           [('<!-- page: ' || i || ' -->' || chr(10) || chr(10) || {strip_sql('parts[i]')}) FOR i IN range(1, len(parts) + 1)],
           chr(10) || chr(10)) END AS markdown
  FROM paras WHERE NOT contains(html, 'lang="de"') AND NOT contains(parts[1], 'lang="es"'))""",
    st.sections_ctes("texts", "sec"),
    st.chunks_ctes("sec", "chunks", CFG),
    select=f"""SELECT CAST(p.page_id AS VARCHAR) AS document_id,
  CASE WHEN e.message IS NULL THEN 'completed' ELSE 'failed' END AS status, e.message AS error_message
FROM pages p JOIN (
  SELECT page_id, CASE WHEN contains(html, 'lang="de"') THEN 'unsupported language: de'
    WHEN contains(string_split(html, '</p>')[1], 'lang="es"') THEN 'no text could be read from the file'
    WHEN EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = CAST(page_id AS VARCHAR)
                 AND len(regexp_extract_all({st.INPUT_SQL}, '[^{WS}]+')) > 400) THEN 'input longer than 400 words'
    END AS message FROM pages) e ON e.page_id = p.page_id""",
)


def replaced_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A second run with small windows replaces the chunks of French and German documents.

    The German ones of bad quality fail: their old chunks stay but are hidden.
    """
    tables = Tables(spark, new_run_dir(spark, "replace")).create_if_missing()
    run_ingest(tables, registered_rows(spark, sf), st.document_texts(spark, sf).withColumn("error", F.lit(None).cast("string")).drop("original_filename"), CFG, "r1")
    again = tables.documents().filter(F.col("user_id").isin("fr", "de"))
    texts = parsed_texts(spark, sf).join(again.select("document_id"), "document_id", "left_semi")
    run_ingest(tables, again, texts, SMALL, "r2")
    rows = tables.visible_chunks(CFG).groupBy("document_id", "run_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("tokens")
    )
    return rows


REPLACE_SQL = with_ctes(
    st.REGISTRY,
    DOC_CHUNKS,
    st.chunks_ctes("sec", "small", SMALL),
    select="""SELECT r.document_id, 'r1' AS run_id, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS tokens
FROM chunks c JOIN registry r USING (document_id) WHERE r.user_id NOT IN ('fr', 'de') GROUP BY ALL
UNION ALL
SELECT r.document_id, 'r2', count(*), CAST(sum(token_count) AS BIGINT)
FROM small c JOIN registry r USING (document_id)
WHERE r.user_id IN ('fr', 'de') AND r.error_message IS NULL GROUP BY ALL""",
)


QUERIES = {
    "file_intake": file_intake,
    "stream_file_intake": streamed_intake,
    "register_documents": register_documents,
    "storage_path": storage_path,
    "validate_uploads": validate_uploads,
    "validate_questions": validate_questions,
    "parse_files": parse_hook,
    "html_to_markdown": markdown_of_html,
    "assemble_pages": assembled_pages,
    "split_sections": split_sections,
    "page_markers": page_markers,
    "token_counts": token_counts,
    "chunk_documents": chunk_texts,
    "chunk_markdown": chunk_markdown,
    "chunk_subwords": chunk_subwords,
    "page_carry": page_carry,
    "embedding_input": embedding_inputs,
    "embed_chunks": embedded_texts,
    "attach_embeddings": attached_vectors,
    "extract_embeddings": extracted_embeddings,
    "ingest_end_to_end": ingest_end_to_end,
    "stream_ingest": streamed_ingest,
    "ingest_failures": ingest_failures,
    "replace_chunks": replaced_chunks,
}

ORACLE = {
    "register_documents": REGISTER_SQL,
    "storage_path": STORAGE_PATH_SQL,
    "validate_uploads": VALIDATE_UPLOADS_SQL,
    "validate_questions": VALIDATE_QUESTIONS_SQL,
    "parse_files": PARSE_HOOK_SQL,
    "html_to_markdown": with_ctes(WEB_TEXTS, select="SELECT document_id, markdown FROM web_texts"),
    "assemble_pages": ASSEMBLED_SQL,
    "split_sections": SPLIT_SECTIONS_SQL,
    "page_markers": PAGE_MARKERS_SQL,
    "token_counts": TOKEN_COUNTS_SQL,
    "chunk_documents": CHUNK_TEXTS_SQL,
    "chunk_markdown": CHUNK_MARKDOWN_SQL,
    "page_carry": PAGE_CARRY_SQL,
    "embedding_input": EMBEDDING_INPUT_SQL,
    "embed_chunks": EMBED_SQL,
    "attach_embeddings": ATTACH_SQL,
    "extract_embeddings": EXTRACT_EMBEDDINGS_SQL,
    "ingest_end_to_end": INGEST_SQL,
    "stream_ingest": INGEST_SQL,
    "ingest_failures": INGEST_FAILURES_SQL,
    "replace_chunks": REPLACE_SQL,
}
