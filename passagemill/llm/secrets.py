"""Secrets in texts, by column expressions only.

Three kinds are found by pattern (assignments, access keys, hex strings). A fourth comes from
entropy: over each long run of key characters a window slides, and the counts of the
character that enters and of the one that leaves update the Shannon sum; the window's
entropy is held against the threshold of the run's character class. Windows that touch a piece of a run
(between ``/`` and ``=``) that an allow-list names are suppressed; it never touches what the patterns found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.shared import id_text

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"  # the runs of [0-9a-f]+ with 16 or more characters
_FIRST, _SIGNS = ord("+"), ord("z") - ord("+") + 1  # codes of key characters


@dataclass(frozen=True)
class EntropyRule:
    """Windows of ``window`` characters; bits above which a window of a class is a secret."""

    window: int = 20
    hex_bits: float = 3.0
    mixed_bits: float = 3.7
    #: Pieces of runs that hold one of these are no secrets.
    allowed: str = (
        r"(?i)example|sample|dummy|placeholder|changeme|0123456789|abcdefghij|x{8}|(.)\1{7}"
        r"|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    )


def _placed(text: Column, pattern: str, found: Column) -> Column:
    """(start, end) in characters of each of ``found``, all matches of the pattern in the text."""
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + pair["size"]
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(between, F.transform(found, lambda m: F.length(m)), lambda g, s: F.struct(g.alias("gap"), s.alias("size")))
    return F.aggregate(F.slice(pairs, 1, F.size(found)), zero, add, lambda s: s["spans"])


def _spans(text: Column, pattern: str, found: Column, keep: Column | None, kind: str) -> Column:
    """Spans of one kind as (start, kind number, end); ``keep`` says which matches count."""
    placed = _placed(text, pattern, found)
    number = F.lit(KINDS.index(kind))
    if keep is not None:
        both = F.zip_with(placed, keep, lambda p, k: F.struct(p["start"].alias("start"), p["end"].alias("end"), k.alias("k")))
        placed = F.filter(both, lambda p: p["k"])
    spans = F.transform(placed, lambda p: F.struct(p["start"].alias("start"), number.alias("kind"), p["end"].alias("end")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def _gain(count: Column) -> Column:
    """How the sum of c * log2(c) grows when a count grows by one."""
    c = count.cast("double")
    return (c + 1) * F.log2(c + 1) - F.when(c > 0, c * F.log2(c)).otherwise(0.0)


def _steps(run: Column, rule: EntropyRule) -> Column:
    """Per character of a run: the one that enters, the one that leaves the window (null at first), and whether the allow-list has its piece."""
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c) - _FIRST)
    before = F.concat(F.array_repeat(F.lit(None).cast("int"), rule.window), codes)
    pieces = F.split(run, "(?<=[/=])")
    named = F.flatten(F.transform(pieces, lambda p: F.array_repeat(F.rtrim(p, F.lit("/=")).rlike(rule.allowed), F.length(p))))
    moves = F.zip_with(codes, F.slice(before, 1, F.length(run)), lambda e, x: F.struct(e.alias("enters"), x.alias("leaves")))
    return F.zip_with(moves, named, lambda m, k: F.struct(m["enters"].alias("enters"), m["leaves"].alias("leaves"), k.alias("named")))


def _hot_spans(run: Column, rule: EntropyRule) -> Column:
    """(start, end) of the unions of overlapping windows of ``run`` above its class's threshold.

    The state holds how often each character is in the window and the sum of c * log2(c); a step changes two
    counts. Windows that touch a piece of the allow-list are none.
    """
    w = rule.window
    bits = F.when(run.rlike("^([0-9a-f]+|[0-9A-F]+)$"), rule.hex_bits).otherwise(rule.mixed_bits)
    no = F.lit(None).cast("int")
    zero = F.struct(
        ((F.log2(F.lit(float(w))) - bits) * w + 1e-9).alias("most"),  # entropy is log2(w) - sum / w
        F.lit(0.0).alias("sum"), F.array_repeat(F.lit(0), _SIGNS).alias("counts"), F.lit(0).alias("at"), F.lit(0).alias("clear"),
        no.alias("first"), no.alias("last"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
    )

    def closed(state: Column) -> Column:
        span = F.struct(state["first"].alias("start"), state["last"].alias("end"))
        return F.when(state["first"].isNull(), state["spans"]).otherwise(F.array_append(state["spans"], span))

    def counted(state: Column, s: Column) -> Column:
        enters, leaves = s["enters"], s["leaves"]
        same = enters.eqNullSafe(leaves)
        out = F.when(leaves.isNull(), 0.0).otherwise(_gain(state["counts"][F.coalesce(leaves, F.lit(0))] - 1))
        # the leaving character is another one, so the entering one's count is as it was
        total = F.when(same, state["sum"]).otherwise(state["sum"] - out + _gain(state["counts"][enters]))
        moved = F.transform(
            state["counts"],
            lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k.eqNullSafe(leaves), 1).otherwise(0),
        )
        return F.struct(
            state["most"], total.alias("sum"), F.when(same, state["counts"]).otherwise(moved).alias("counts"), (state["at"] + 1).alias("at"),
            F.when(s["named"], 0).otherwise(state["clear"] + 1).alias("clear"), state["first"], state["last"], state["spans"],
        )

    def placed(state: Column) -> Column:
        hot = (state["clear"] >= w) & (state["sum"] <= state["most"])
        apart = hot & (state["last"].isNull() | (state["at"] - w > state["last"]))
        return F.struct(
            state["most"], state["sum"], state["counts"], state["at"], state["clear"],
            F.when(apart, state["at"] - w).otherwise(state["first"]).alias("first"), F.when(hot, state["at"]).otherwise(state["last"]).alias("last"),
            F.when(apart, closed(state)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(_steps(run, rule), zero, lambda state, s: _once(counted(state, s), placed), closed)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, as the only element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _entropy_spans(text: Column, runs: Column, pattern: str, rule: EntropyRule) -> Column:
    placed = _placed(text, pattern, runs)
    both = F.zip_with(placed, runs, lambda p, r: F.struct(p["start"].alias("start"), r.alias("run")))
    # letters alone are prose, digits alone are numbers
    both = F.filter(both, lambda b: b["run"].rlike("[0-9]") & b["run"].rlike("[A-Za-z]"))

    def spans_of(b: Column) -> Column:
        return F.transform(
            _hot_spans(b["run"], rule),
            lambda s: F.struct(
                (b["start"] + s["start"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (b["start"] + s["end"]).alias("end"),
            ),
        )

    spans = F.flatten(F.transform(both, spans_of))
    return F.when(F.size(runs) > 0, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def find_secrets(
    docs: DataFrame, rule: EntropyRule = EntropyRule(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, ``base`` and ``found``, arrays of (start, kind, end) ordered by start, then kind.

    ``base`` holds the pattern kinds, ``found`` those and the entropy spans; ends are exclusive, places
    count characters. A null or empty text has empty arrays. Whole texts of any length are searched;
    repeated rows give repeated rows; an empty table gives an empty one; other columns are not read.
    """
    runs_of = f"[A-Za-z0-9+/_=-]{{{rule.window},}}"
    text = F.coalesce(F.col("text"), F.lit(""))
    found = id_text(docs, id_col, text_col).select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(0)).alias("a"),
        F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)).alias("a2"),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)).alias("k"),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)).alias("h"),
        F.regexp_extract_all("text", F.lit(runs_of), F.lit(0)).alias("r"),
    )
    t = F.col("text")
    spans = found.select(
        "doc_id",
        _spans(t, ASSIGN, F.col("a"), F.transform("a2", lambda v: F.length(v) >= 12), "assign").alias("a"),
        _spans(t, ACCESS, F.col("k"), F.transform("k", lambda v: F.length(v) >= 18), "access").alias("k"),
        _spans(t, HEX, F.col("h"), None, "hex").alias("h"),
        _entropy_spans(t, F.col("r"), runs_of, rule).alias("e"),
    )
    return spans.select(
        "doc_id",
        F.array_sort(F.concat("a", "k", "h")).alias("base"),
        F.array_sort(F.concat("a", "k", "h", "e")).alias("found"),
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the pattern kinds, the hash of their list, and all spans as text."""
    found = find_secrets(docs)

    def n_of(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    n = [n_of(k) for k in range(3)]
    return found.select("doc_id", *n, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
