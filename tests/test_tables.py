"""Runs, retries, failures, deletes, checks, and the shape of plans."""

import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from passagemill.config import EngineConfig
from passagemill.functions.vectors import HashedWords
from passagemill.operators import lifecycle as life
from passagemill.operators import registry as reg
from passagemill.operators.validate import check_list_limit, check_questions, check_uploads
from passagemill.plans.ingest import ingest_files, run_ingest
from passagemill.plans.upkeep import compact, delete_documents, purge, reprocess
from passagemill.sources.files import register
from passagemill.sources.tables import Tables

CFG = EngineConfig(embedding_dim=16)
TS = datetime(2024, 1, 1, tzinfo=timezone.utc)


def registered(spark, names):
    rows = [(n, f"{n}.pdf", "application/pdf", "", "c") for n in names]
    files = spark.createDataFrame(rows, "key string, filename string, mime string, user_id string, collection string")
    return register(files, CFG, F.col("key"), F.lit(TS).cast("timestamp"))


def markdown(spark, docs, texts):
    rows = [(f"{n}.pdf", t, e) for n, (t, e) in texts.items()]
    known = spark.createDataFrame(rows, "original_filename string, markdown string, error string")
    return docs.join(known, "original_filename").select("document_id", "markdown", "error")


def seen(tables):
    docs = {r["document_id"]: r["original_filename"] for r in tables.documents().collect()}
    return sorted((docs[r["document_id"]], r["run_id"], r["content"]) for r in tables.visible_chunks(CFG).collect())


def test_runs_replace_and_fail_alone(spark, tmp_path):
    tables = Tables(spark, str(tmp_path)).create_if_missing().create_if_missing()
    docs = registered(spark, ["a", "b", "x", "blank"])
    texts = {"a": ("one", None), "b": ("two", None), "x": (None, "e" * 2000), "blank": (" \n", None)}
    run_ingest(tables, docs, markdown(spark, docs, texts), CFG, "r1")
    assert seen(tables) == [("a.pdf", "r1", "one"), ("b.pdf", "r1", "two")]
    state = {r["original_filename"]: r for r in tables.documents().collect()}
    assert state["x.pdf"]["status"] == "failed" and state["x.pdf"]["error_message"] == "e" * 1000
    assert state["blank.pdf"]["error_message"] == "no text could be read from the file"
    assert state["a.pdf"]["markdown_storage_path"].startswith(str(tmp_path / "markdown" / "attempt=")) and state["x.pdf"]["markdown_storage_path"] is None

    # The same run again is another attempt, which takes the place of the first.
    first = seen(tables)
    run_ingest(tables, docs, markdown(spark, docs, texts), CFG, "r1")
    assert tables.read("chunks").count() == 4 and seen(tables) == first

    # A new run replaces a, fails b (old chunks hidden, not lost) and repairs x.
    again = tables.documents()
    texts = {"a": ("new", None), "b": (None, "gone"), "x": ("late", None)}
    again = again.filter(F.col("original_filename") != "blank.pdf")
    run_ingest(tables, again, markdown(spark, again, texts), CFG, "r2")
    assert seen(tables) == [("a.pdf", "r2", "new"), ("x.pdf", "r2", "late")]
    # The old chunks of b are hidden, not lost; those of replaced attempts are stale.
    stale = life.stale_rows(tables.read("chunks"), tables.documents()).collect()
    assert sorted(r["content"] for r in stale) == ["one", "one", "two"]

    # An attempt that died after its chunks: its documents are at work, nothing of it is seen.
    died = tables.begin()
    tables.write("chunks", died, "r2", tables.read("chunks").withColumn("content", F.lit("half")))
    assert [r[2] for r in seen(tables)] == ["new", "late"]
    only_a = tables.documents().filter("original_filename = 'a.pdf'")
    tables.write("documents", died, "r2", only_a.withColumn("status", F.lit("processing")).withColumn("step", F.lit(1)))
    assert [r[2] for r in seen(tables)] == ["late"]
    run_ingest(tables, again, markdown(spark, again, texts), CFG, "r2")
    assert [r[2] for r in seen(tables)] == ["new", "late"]

    jobs = life.job_log(tables.read("jobs"))
    assert {r["status"]: r["count"] for r in jobs.groupBy("status").count().collect()} == {"completed": 8, "failed": 6}
    assert jobs.filter("completed_at > started_at").count() == jobs.count()

    # Deleted documents go at once, their bytes with compacting and purging; the rest stays as it was.
    before = seen(tables)
    delete_documents(tables, only_a.unionByName(only_a), "d1")
    assert seen(tables) == [r for r in before if r[0] != "a.pdf"]
    left = sorted(map(tuple, tables.documents().select("document_id", "status", "created_at", "updated_at").collect()))
    attempt = compact(tables, CFG, "c1")
    purge(tables)
    assert seen(tables) == [r for r in before if r[0] != "a.pdf"]
    assert sorted(map(tuple, tables.documents().select("document_id", "status", "created_at", "updated_at").collect())) == left
    assert tables.attempts("chunks") == [attempt] and tables.attempts("markdown") == [attempt]
    assert sorted(r["content"] for r in tables.read("chunks").collect()) == ["late", "two"]
    assert tables.read("documents").filter("original_filename = 'a.pdf' and not deleted").count() == 0


def test_model_failure_stays_with_its_document(spark, tmp_path):
    class Picky(HashedWords):
        def __call__(self, texts):
            if any("poison" in t for t in texts):
                raise ValueError("bad input")
            return super().__call__(texts)

    tables = Tables(spark, str(tmp_path)).create_if_missing()
    docs = registered(spark, ["good", "bad"])
    texts = {"good": ("fine " * 3000, None), "bad": ("fine " * 600 + "poison " + "fine " * 600, None)}
    run_ingest(tables, docs, markdown(spark, docs, texts), CFG, "r1", lambda: Picky(16))
    state = {r["original_filename"]: (r["status"], r["error_message"]) for r in tables.documents().collect()}
    assert state == {"good.pdf": ("completed", None), "bad.pdf": ("failed", "bad input")}
    vectors = tables.visible_chunks(CFG).select("embedding").collect()
    assert len(vectors) == 7 and all(len(r["embedding"]) == 16 for r in vectors)


def test_ingest_files_from_a_folder(spark, tmp_path):
    box = tmp_path / "box" / "deep"
    box.mkdir(parents=True)
    (box / "a.pdf").write_text("first page\fsecond page")
    (box / "b.PNG").write_text("only page")
    (box / "c.txt").write_text("not allowed")
    (box / "d.pdf").write_text("x" * (1024 * 1024 + 1))
    (box / "e.pdf").write_text("boom")

    def make_parser():
        def parse(content):
            text = bytes(content).decode()
            if text == "boom":
                raise RuntimeError("cannot read")
            return text.split("\f")

        return parse

    cfg = EngineConfig(embedding_dim=16, max_upload_mb=1)
    tables = Tables(spark, str(tmp_path / "t")).create_if_missing()
    rejected = ingest_files(tables, str(tmp_path / "box"), cfg, make_parser, "r1")
    assert {(r["filename"], r["reject_code"]) for r in rejected.collect()} == {("c.txt", 415), ("d.pdf", 413)}
    state = {r["original_filename"]: r["status"] for r in tables.documents().collect()}
    assert state == {"a.pdf": "completed", "b.PNG": "completed", "e.pdf": "failed"}
    assert [(r[0], r[2]) for r in seen(tables)] == [
        ("a.pdf", "<!-- page: 1 -->\n\nfirst page\n\n<!-- page: 2 -->\n\nsecond page"), ("b.PNG", "only page"),
    ]


def test_folder_again_and_reprocessing(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    (box / "a.pdf").write_text("good")
    (box / "b.pdf").write_text("other")
    working = lambda: lambda content: [bytes(content).decode()]

    def broken():
        def parse(content):
            raise RuntimeError("no service")

        return parse

    tables = Tables(spark, str(tmp_path / "t")).create_if_missing()
    ingest_files(tables, str(box), CFG, working, "r1", clock=lambda: TS)
    first = {r["document_id"]: r for r in tables.documents().collect()}
    ingest_files(tables, str(box), CFG, broken, "r2")
    for r in tables.documents().collect():
        old = first[r["document_id"]]
        assert r["status"] == "failed" and (r["created_at"], r["active_attempt"]) == (old["created_at"], old["active_attempt"])
    assert seen(tables) == []
    (box / "a.pdf").write_text("changed on disk only")
    one = tables.documents().filter("original_filename = 'a.pdf'")
    reprocess(tables, CFG, working, "r3", one)
    assert seen(tables) == [("a.pdf", "r3", "good")]
    reprocess(tables, CFG, working, "r4")
    assert seen(tables) == [("a.pdf", "r4", "good"), ("b.pdf", "r4", "other")]


def test_upload_rules(spark):
    mb50 = 50 * 1024 * 1024
    rows = [("Application/PDF", 1, None), (None, 1, 415), ("text/plain", mb50 + 1, 415), ("application/pdf", mb50, None), ("application/pdf", mb50 + 1, 413)]
    df = spark.createDataFrame(rows, "mime string, length long, want int")
    assert all(r["reject_code"] == r["want"] for r in check_uploads(df, EngineConfig()).collect())
    assert EngineConfig(allowed_mime_types=" A/b, ,a/B,c/d ").allowed_mimes == ["a/b", "c/d"]


def test_question_and_limit_rules(spark):
    rows = [("", None, False), ("x" * 2000, 1, True), ("x" * 2001, 1, False), ("x", 0, False), ("x", 50, True), ("x", 51, False), (None, 1, False), ("å" * 2000, None, True)]
    df = spark.createDataFrame(rows, "question string, top_k int, ok boolean")
    assert all((r["reason"] is None) == r["ok"] for r in check_questions(df).collect())
    assert check_list_limit() == 200
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            check_list_limit(bad)


def test_delete_and_reports(spark):
    docs = registered(spark, ["a", "b"])
    one = docs.filter("original_filename = 'a.pdf'")
    (kept,) = life.delete_cascade(one, CFG, docs)
    assert [r["original_filename"] for r in kept.collect()] == ["b.pdf"]
    (kept,) = life.delete_cascade(one, EngineConfig(broadcast_bytes=0), docs)
    assert [r["original_filename"] for r in kept.collect()] == ["b.pdf"]
    paths = {r["path"] for r in life.purge_paths(one, docs, CFG).collect()}
    assert len(paths) == 2 and any(p.endswith("__a.pdf") for p in paths) and any(p.endswith(".md") for p in paths)
    cleared = life.reprocess_candidates(docs.withColumn("error_message", F.lit("old")), one).collect()
    assert [(r["status"], r["error_message"]) for r in cleared] == [("processing", None)]
    chunks = docs.select("document_id", F.lit(0).alias("chunk_index"), F.lit("t").alias("content"), F.array(F.lit(1.0)).alias("embedding"))
    jobs = docs.select(F.lit("nobody").alias("document_id"), F.lit("lost").alias("status"))
    broken = reg.constraint_report(docs.withColumn("status", F.lit("odd")), chunks.unionByName(chunks), jobs, 2, ["running"])
    assert {(r["rule"], r["table_name"]): r["violations"] for r in broken.collect()} == {
        ("not null", "documents"): 0, ("not null", "chunks"): 0, ("primary key", "documents"): 0,
        ("status value", "documents"): 2, ("status value", "jobs"): 2, ("unique", "chunks"): 2,
        ("foreign key", "chunks"): 0, ("foreign key", "jobs"): 2, ("vector dimension", "chunks"): 4,
    }


# Plans ------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"
NATIVE = [
    "chunk_documents", "chunk_markdown", "split_sections", "page_markers", "token_counts", "sentences", "list_documents",
    "latest_status", "job_log", "assemble_pages", "ordered_release", "sse_deltas", "parse_event_lines", "html_to_markdown",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapIn|FlatMap|NestedLoop|Cartesian", plan)


@pytest.mark.parametrize("name", ["knn_join", "knn_topk", "retrieve", "rerank", "build_prompts", "score_gate"])
def test_search_plans_have_no_cross_join(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    if name == "knn_topk":
        assert "TakeOrderedAndProject" in plan
    elif name in ("knn_join", "score_gate"):  # the others read the hits as a stored table
        assert "WindowGroupLimit" in plan


def test_list_reads_few_columns(spark):
    plan = plan_of(entry.queries()["list_documents"](spark, SF))
    assert "TakeOrderedAndProject" in plan
    assert all("text" not in schema for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert "EqualTo(lang,en)" in plan


def test_constraints_read_each_table_once(spark):
    plan = plan_of(entry.queries()["constraint_report"](spark, SF))
    read = re.findall(r"Location: [^\[]*\[[^\]]*/(\w+)\.parquet", plan)
    assert read and sorted(read) == sorted(set(read))
