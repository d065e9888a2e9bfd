"""Hand-written cases of the text rules, and random texts against a plain restatement."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagemill.config import EngineConfig
from passagemill.functions import text as txt
from passagemill.functions import wording
from passagemill.functions.sentences import spoken_sentences
from passagemill.operators.chunk import chunk_documents, chunk_documents_encoded
from passagemill.operators.parse import assemble_pages

TINY = EngineConfig(chunk_size=4, chunk_overlap=1)

CHUNK_CASES = [
    (
        "# A\none two three four five <!--page:7--> six\n## B\ntail",
        [
            (0, "one two three four", "A", 7, 4),
            (1, " four five <!--page:7--> six", "A", 7, 4),
            (2, "tail", "B", 7, 1),
        ],
    ),
    ("a b c d e f g", [(0, "a b c d", None, None, 4), (1, " d e f g", None, None, 4)]),
    ("# only\n## heads", [(0, "# only\n## heads", None, None, 4)]),
    ("", []),
    (" \n\t ", []),
    ("##\nSpan\nbody", [(0, "body", "Span", None, 1)]),
    ("x\n#### y", [(0, "x\n#### y", None, None, 3)]),
    ("<!-- page: 2 -->\n# H\nbody", [(0, "<!-- page: 2 -->", None, 2, 4), (1, "body", "H", 2, 1)]),
    ("<!-- PAGE:3 -->x\n# H\n<!-- page: 99999999999 -->y", [(0, "<!-- PAGE:3 -->x", None, 3, 3), (1, "<!-- page: 99999999999 -->y", "H", 3, 4)]),
]


def chunked(spark, texts, cfg=TINY):
    rows = [(str(i), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "document_id string, markdown string")
    out = {}
    for r in chunk_documents(df, cfg).collect():
        out.setdefault(int(r["document_id"]), []).append(
            (r["chunk_index"], r["content"], r["heading"], r["page_number"], r["token_count"])
        )
    return {k: sorted(v) for k, v in out.items()}


def test_chunk_cases(spark):
    got = chunked(spark, [c[0] for c in CHUNK_CASES])
    for i, (_, want) in enumerate(CHUNK_CASES):
        assert got.get(i, []) == want, CHUNK_CASES[i][0]


@pytest.mark.parametrize(
    "n,want", [(512, [512]), (513, [512, 65]), (960, [512, 512]), (961, [512, 512, 65]), (1409, [512, 512, 512, 65])]
)
def test_default_windows(spark, n, want):
    got = chunked(spark, [" ".join(["w"] * n)], EngineConfig())
    assert [c[4] for c in got[0]] == want


def plain_chunks(markdown, size, overlap):
    """The chunk rules said once more, one character class at a time."""
    heads = list(re.finditer(r"(?m)^#{1,3}\s+(.+?)\s*$", markdown))
    cuts = [0] + [h.end() for h in heads]
    ends = [h.start() for h in heads] + [len(markdown)]
    names = [None] + [h.group(1).strip() for h in heads]
    parts = [(name, markdown[a:b].strip()) for name, a, b in zip(names, cuts, ends)]
    parts = [p for p in parts if p[1]]
    if not parts and markdown.strip():
        parts = [(None, markdown.strip())]
    marker = re.compile(r"(?i)<!--\s*page:\s*(\d+)\s*-->")
    out, page = [], None
    for name, body in parts:
        marks = marker.findall(body)
        page = int(marks[-1]) if marks else page
        tokens = re.findall(r"\s*\S+", body)
        count = 1 if len(tokens) <= size else 1 - (-(len(tokens) - size) // (size - overlap))
        for w in range(count):
            piece = tokens[w * (size - overlap) :][:size]
            text = "".join(piece)
            own = marker.findall(text)
            out.append((len(out), text, name, int(own[-1]) if own else page, len(piece)))
    return out


PIECES = ["# ", "## ", "#### ", "#", "\n", "\n\n", " ", "\t", " ", " ", "\r\n", "word", "é", "x y z", "a b c d e f",
          "<!-- page: 4 -->", "<!--page:12-->", "<!-- Page: 7", "```", "\x85", "\x1c"]


def test_random_markdown(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    for size, overlap in ((4, 1), (3, 0), (7, 6)):
        got = chunked(spark, texts, EngineConfig(chunk_size=size, chunk_overlap=overlap))
        for i, text in enumerate(texts):
            assert got.get(i, []) == plain_chunks(text, size, overlap), repr(text)


@settings(max_examples=200, deadline=None)
@given(n=st.integers(1, 3000), size=st.integers(1, 600), share=st.floats(0, 0.99))
def test_window_arithmetic(n, size, share):
    """Windows cover every token, advance by the stride and end at the last token."""
    overlap = int(size * share)
    stride = size - overlap
    count = 1 if n <= size else 1 - (-(n - size) // stride)
    spans = [(w * stride, min(w * stride + size, n)) for w in range(count)]
    assert spans[0][0] == 0 and spans[-1][1] == n
    assert all(b[0] - a[0] == stride and b[0] <= a[1] for a, b in zip(spans, spans[1:]))
    assert all(end < n for _, end in spans[:-1])


def test_overlap_must_advance():
    with pytest.raises(ValueError):
        EngineConfig(chunk_size=8, chunk_overlap=8)


def test_encoded_windows_match_word_windows(spark):
    """A user encoder with the word tokens of the default gives the same chunks."""
    vocabulary: dict[str, int] = {}

    def encode(body):
        return [vocabulary.setdefault(t, len(vocabulary)) for t in re.findall(r"\s*\S+", body)]

    def decode(ids):
        words = {i: t for t, i in vocabulary.items()}
        return "".join(words[i] for i in ids)

    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document_id string, markdown string")
    windows = txt.encoder_windows(encode, decode, TINY)
    columns = ["document_id", "chunk_index", "page_number", "heading", "content", "token_count"]
    got = chunk_documents_encoded(df, windows).select(*columns).collect()
    want = chunk_documents(df, TINY).select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_byte_encoder(spark):
    """A byte-pair encoder built without any download cuts by its own tokens."""
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {bytes([i]): i for i in range(256)}
    encoding = tiktoken.Encoding("bytes", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    windows = txt.encoder_windows(encoding.encode_ordinary, encoding.decode, EngineConfig(chunk_size=10, chunk_overlap=2))
    df = spark.createDataFrame([("a", "abcdefghijklmnopqrstuvwxyz")], "document_id string, markdown string")
    got = [r["content"] for r in chunk_documents_encoded(df, windows).orderBy("chunk_index").collect()]
    assert got == ["abcdefghij", "ijklmnopqr", "qrstuvwxyz"]


def test_subword_chunks(spark):
    """Windows over the ids of a byte-pair vocabulary: every row of the query against the rules said once more."""
    pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    from workload.ingesting import chunk_subwords, subword_path

    model = Tokenizer.from_file(subword_path())
    model.no_truncation()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in rows:
        body = (r["text"] or "").strip()
        ids = model.encode(body, add_special_tokens=False).ids
        cfg = EngineConfig()
        at = 0
        for n in range(0, 1 << 30):
            piece = ids[at : at + cfg.chunk_size]
            if body:
                text = body if len(ids) <= cfg.chunk_size else model.decode(piece, skip_special_tokens=False)
                want.append((str(r["doc_id"]), n, text, len(piece)))
            if at + cfg.chunk_size >= len(ids):
                break
            at += cfg.stride
    assert not any(re.search(r"(?m)^#{1,3}\s", r["text"] or "") for r in rows)  # these texts have no headings
    got = [(r["document_id"], r["chunk_index"], r["content"], r["token_count"]) for r in chunk_subwords(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want) and len({w[0] for w in want}) < len(want)


def test_subword_codec_travels_as_a_path():
    import pickle

    codec = txt.SubwordCodec("/nowhere/vocabulary.json")
    codec._model = object()
    assert vars(pickle.loads(pickle.dumps(codec))) == {"path": "/nowhere/vocabulary.json", "_model": None}


SENTENCE_CASES = [
    ("Yes. This is a long enough sentence. Tail", ["This is a long enough sentence.", "Tail"]),
    ("A long enough sentence here. Ok. ", ["A long enough sentence here.", "Ok."]),
    ("Pi is 3.14 for everyone today. Bye", ["14 for everyone today.", "Bye"]),
    ("Title\nThis line is long enough here. ", ["This line is long enough here."]),
    ("No terminator at all", ["No terminator at all"]),
    ("  ", []),
    ("Twelve 😀😀😀😀 signs. x", ["Twelve 😀😀😀😀 signs.", "x"]),
    ("Twelve 😀 signs r. x", ["Twelve 😀 signs r. x"]),
]


def plain_sentences(text):
    spaces = "\t\n\x0b\f\r       　﻿" + "".join(map(chr, range(0x2000, 0x200B)))
    out, cut = [], 0
    for m in re.finditer(rf"([^.!?\n]+[.!?])[{spaces}]+", text):
        said = m.group(1).strip(spaces)
        if len(said.encode("utf-16-le")) >= 40:
            out.append(said)
            cut = m.end()
    rest = text[cut:].strip(spaces)
    return out + [rest] if rest else out


def test_sentences(spark):
    rng = random.Random(5)
    parts = ["a few words here ", "No", "Yes.", " ", "\n", "3.14", "?! ", "long enough for one sentence", ". ", "! ", "😀", "﻿", "\x85", "..."]
    texts = [c[0] for c in SENTENCE_CASES] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", spoken_sentences(F.col("t")).alias("s")).collect()}
    for i, (_, want) in enumerate(SENTENCE_CASES):
        assert got[i] == want
    for i, text in enumerate(texts):
        assert got[i] == plain_sentences(text), repr(text)


def test_byte_sizes(spark):
    cases = {0: "0 B", -5: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 10240: "10 KB", 5 * 1024**2: "5.0 MB", 3 * 1024**4: "3072 GB"}
    df = spark.createDataFrame([(k,) for k in cases], "n long")
    got = {r["n"]: r["s"] for r in df.select("n", wording.format_bytes(F.col("n")).alias("s")).collect()}
    assert got == cases
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "n double")
    assert {r["s"] for r in bad.select(wording.format_bytes(F.col("n")).alias("s")).collect()} == {"0 B"}


def test_strip_drops_all_white_space(spark):
    df = spark.createDataFrame([("\n\t 　x y\x85\x1f ",)], "t string")
    assert df.select(txt.strip(F.col("t"))).first()[0] == "x y"


def test_pages(spark):
    rows = [("one", 1, " x "), ("two", 1, " a "), ("two", 2, None)]
    rows += [("many", i, f" p{i}\n") for i in range(1, 3001)]
    df = spark.createDataFrame(rows, "document_id string, page_no int, text string")
    got = {r["document_id"]: r["markdown"] for r in assemble_pages(df).collect()}
    assert got["one"] == " x "
    assert got["two"] == "<!-- page: 1 -->\n\na\n\n<!-- page: 2 -->\n\n"
    assert got["many"] == "\n\n".join(f"<!-- page: {i} -->\n\np{i}" for i in range(1, 3001))


def test_source_labels(spark):
    df = spark.createDataFrame(
        [("f", 3, "H"), ("f", 0, ""), ("f", None, None)], "name string, page int, heading string"
    )
    label = wording.source_label(F.col("name"), F.col("page"), F.col("heading"))
    assert [r[0] for r in df.select(label).collect()] == ["f, p.3 — H", "f", "f"]
    shown = wording.citation_label(F.lit(1), F.col("name"), F.col("page"), F.col("heading"), F.lit(0.831))
    assert [r[0] for r in df.select(shown).collect()] == [
        "[1] f - p.3 - H (score 0.83)", "[1] f (score 0.83)", "[1] f (score 0.83)",
    ]


def test_texts_reach_python_in_small_batches(spark):
    """40 MB of one task's texts: no batch above 4 MB and a row, after the embedder or the encoder was asked for."""
    import pandas as pd

    from passagemill.operators.embed import embed_questions

    @F.pandas_udf("long")
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    rows = spark.range(0, 2000, 1, 1).select(F.col("id").cast("string").alias("question_id"), F.repeat(F.lit("x"), 20_000).alias("question"))
    embed_questions(rows, EngineConfig())
    assert rows.select(together("question").alias("n")).agg(F.max("n")).first()[0] <= 4 * 1024 * 1024 + 20_000


def test_pages_of_small_files_leave_together():
    """One frame for each file cost most of the time of parsing; large texts still leave in bounded frames."""
    import pandas as pd
    from passagemill.operators.parse import parse_files
    from passagemill.session import BATCH_BYTES

    class Files:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            return run

    def parse(content):
        if content == b"bad":
            raise ValueError("no")
        return [] if content == b"none" else [t.decode() for t in content.split(b"|")]

    pages = parse_files(Files(), lambda: parse)
    contents = [b"a|b", b"bad", b"none"] * 100
    batch = pd.DataFrame({"document_id": [str(i) for i in range(300)], "content": contents})
    frames = list(pages(iter([batch, batch])))
    assert len(frames) == 1
    assert [tuple(r) for r in frames[0].head(4).itertuples(index=False)] == [("0", 1, "a", None), ("0", 2, "b", None), ("1", 0, None, "no"), ("2", 0, None, None)]
    assert len(frames[0]) == 800
    large = pd.DataFrame({"document_id": list("abc"), "content": [b"x" * BATCH_BYTES] * 3})
    assert [len(f) for f in pages(iter([large]))] == [1, 1, 1]


def test_known_words_cost_no_call():
    import numpy as np
    from passagemill.functions.vectors import HashedWords

    class Counting(HashedWords):
        calls = 0

        def slot(self, word):
            self.calls += 1
            return super().slot(word)

    every = "".join(f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    model = Counting(64)
    assert every.lower().split() == model.word.findall(every.lower())
    first = model(["one two three"] * 50)
    assert model.calls == 3 and all(np.array_equal(v, first[0]) for v in first)
    assert not model([" \x1c "])[0].any()
