"""Merkle manifest of a table: leaf digests, subroots, one root, and a proof for every row.

A node of a tree covers an interval [lo, hi) of leaf ranks. Eight consecutive nodes of a level
share a bucket, ``lo`` over the width of their parent, so the parent that contains an interval
is found by an equality on the bucket and a comparison of bounds. Paths grow from the root down:
what a run has above it is its parent's siblings (the parent's interval less its own) and what the
parent has above. A bucket never holds more than eight nodes, whatever the size of a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.shared import drop_stored, stored
from passagemill.session import broadcast_if_bounded

FANOUT = 8
OFFSET_BYTES = 8 << 20
_ROW_BITS = 33  # low bits of monotonically_increasing_id count the rows of a partition


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column) -> Column:
    names = ("doc_id", "source", "lang", "n_chars")
    return F.sha2(F.concat(*[field(F.col(n)) for n in names], field(text)), 256)


def ranked(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0, by ``order``) and ``size`` inside each value of ``tree``; null is a value.

    Rows are sorted by ranges of (tree, order), so one tree may hold any share of them; only row counts per
    range and tree meet. Equal rows are told apart by where they are read, which splits them over ranges.
    """
    spread = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order, "__tie")]
    placed = spread.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(placed.withColumn("__at", F.monotonically_increasing_id()).drop("__tie"), "ranked")
    placed = placed.withColumn("__part", F.shiftright("__at", _ROW_BITS))
    counts = placed.groupBy("__part", tree).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    # a few rows per range and tree: numbers, no data
    before = F.expr(f"sum(__n) over (partition by {tree} order by __part rows between unbounded preceding and 1 preceding)")
    whole = F.expr(f"sum(__n) over (partition by {tree})")
    offsets = counts.select(
        F.col("__part").alias("__p"), F.col(tree).alias("__t"), F.col("__first"),
        F.coalesce(before, F.lit(0)).alias("__before"), whole.alias("size"),
    )
    offsets = broadcast_if_bounded(stored(offsets, "offsets"), OFFSET_BYTES)
    met = placed.join(offsets, (F.col("__part") == F.col("__p")) & F.col(tree).eqNullSafe(F.col("__t")))
    rank = F.col("__before") + F.col("__at") - F.col("__first")
    return met.select(*rows.columns, rank.alias("rank"), F.col("size").cast("long").alias("size"))


def _joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["digest"]), "")


def _grouped(nodes: DataFrame, width: int, kid: Column) -> DataFrame:
    """Runs of up to eight nodes below a parent of ``width`` leaves: tree, size, bucket, lo, hi, kids, digest."""
    runs = nodes.groupBy("tree", "size", F.expr(f"lo div {width}").alias("bucket")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
    digest = F.when(F.col("size") == 1, F.col("kids")[0]["digest"]).otherwise(F.sha2(_joined(F.col("kids")), 256))
    return runs.select(
        "tree", "size", "bucket", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), "kids", digest.alias("digest"),
    )


def grown(leaves: DataFrame) -> list[DataFrame]:
    """Levels of runs over ``leaves`` (tree, size, rank, digest, body), lowest first, each a written table.

    The lone leaf of a tree stays as it is: its run has its digest.
    """
    first = leaves.withColumn("lo", F.col("rank"))
    kid = F.struct(F.col("lo"), (F.col("lo") + 1).alias("hi"), F.col("digest"), F.col("body"))
    levels = [stored(_grouped(first, FANOUT, kid), "runs")]
    most = levels[0].agg(F.max("size").alias("n")).first()["n"] or 0
    width = FANOUT
    while width < most:
        below = levels[-1].where(F.col("size") > width).select("tree", "size", "lo", "hi", "digest")
        width *= FANOUT
        levels.append(stored(_grouped(below, width, F.struct("lo", "hi", "digest")), "runs"))
    return levels


def is_top() -> Column:
    return (F.col("lo") == 0) & (F.col("hi") == F.col("size"))


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of each tree's root."""
    found = [runs.where(is_top()).select("tree", "digest") for runs in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def step_of(kids: Column, lo: Column, hi: Column) -> Column:
    """The siblings of [lo, hi) among ``kids``: digests left and right of the interval, joined."""
    left = _joined(F.filter(kids, lambda k: k["hi"] <= lo))
    right = _joined(F.filter(kids, lambda k: k["lo"] >= hi))
    return F.struct(left.alias("left"), right.alias("right"))


def attached(levels: list[DataFrame], above_tops: DataFrame) -> DataFrame:
    """The lowest runs with ``subroot`` and ``above``, the siblings on their way up, nearest first.

    ``above_tops`` (tree, subroot, above) says what stands above the root of each tree.
    """
    width = FANOUT ** (len(levels) + 1)
    paths = None
    for runs in reversed(levels):
        over = above_tops.withColumnRenamed("tree", "__tree")
        out = runs.where(is_top()).join(over, F.col("tree").eqNullSafe(F.col("__tree"))).drop("__tree")
        if paths is not None:
            parent = paths.select(
                F.col("tree").alias("p_tree"), F.col("bucket").alias("p_bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
                F.col("kids").alias("p_kids"), "subroot", F.col("above").alias("p_above"),
            )
            inside = (
                F.col("tree").eqNullSafe(F.col("p_tree"))
                & (F.expr(f"lo div {width}") == F.col("p_bucket"))
                & (F.col("p_lo") <= F.col("lo"))
                & (F.col("hi") <= F.col("p_hi"))
            )
            above = F.concat(F.array(step_of(F.col("p_kids"), F.col("lo"), F.col("hi"))), F.col("p_above"))
            below = runs.where(~is_top()).join(parent, inside).select(*runs.columns, "subroot", above.alias("above"))
            out = out.unionByName(below)
        paths = out
        width //= FANOUT
    return paths


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf digest and the siblings on its path give."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def proof_of(path: Column) -> Column:
    """The digest of all siblings on a path, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, altered_leaf, subroot, root and path (left and right siblings per level).

    A leaf is the digest of doc_id, source, lang, n_chars and text, nulls included. Trees are values of
    lang, null first among their subroots; leaves stand by doc_id (null first), equal ids by leaf digest. Repeated rows are
    leaves of their own, with the same digest. ``altered`` replaces the text in
    altered_leaf, which is null without it. Texts are read once, whole; other columns are
    not read. An empty table has no root and gives an empty manifest.
    """
    other = F.lit(None).cast("string") if altered is None else leaf_of(altered)
    rows = docs.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(F.col("text")).alias("digest"), other.alias("other"))
    leaves = ranked(rows, "tree", "doc_id", "digest")
    levels = grown(leaves.select("tree", "size", "rank", "digest", F.struct("doc_id", "other").alias("body")))
    roots = tops(levels).select(F.lit(0).alias("tree"), F.col("tree").alias("lang"), "digest")
    upper = ranked(roots, "tree", "lang")
    upper_levels = grown(upper.select("tree", "size", "rank", "digest", F.struct("lang").alias("body")))
    found = tops(upper_levels).first()
    root = found["digest"] if found else None
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    start = docs.sparkSession.range(1).select(F.lit(0).alias("tree"), F.lit(None).cast("string").alias("subroot"), nothing.alias("above"))
    over = _leaves(attached(upper_levels, start)).select(F.col("body.lang").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("above"))
    over = stored(over, "over")
    out = _leaves(attached(levels, over))
    for done in upper_levels:
        drop_stored(done)
    return out.select(
        "body.doc_id", F.col("digest").alias("leaf"), F.col("body.other").alias("altered_leaf"), "subroot", F.lit(root).cast("string").alias("root"), "path",
    )


def _leaves(runs: DataFrame) -> DataFrame:
    """One row per leaf of the lowest runs, its whole path included."""
    kids = runs.select("size", "kids", "subroot", "above", F.explode("kids").alias("kid"))
    own = F.when(F.col("size") == 1, F.slice(F.array(step_of(F.col("kids"), F.col("kid.lo"), F.col("kid.hi"))), 1, 0)).otherwise(
        F.array(step_of(F.col("kids"), F.col("kid.lo"), F.col("kid.hi")))
    )
    return kids.select("kid.digest", "kid.body", "subroot", F.concat(own, F.col("above")).alias("path"))


def verified(docs: DataFrame, tampered: Column, altered: Column) -> DataFrame:
    """The manifest's digests per row, and what its proof says of a copy whose text is ``altered`` where ``tampered`` holds.

    A null ``tampered`` leaves the row as it is.
    """
    rows = manifest(docs, F.when(tampered, altered).otherwise(F.col("text")))
    found = rows.select("doc_id", "leaf", "subroot", "root", proof_of(F.col("path")).alias("proof_sha256"), fold(F.col("altered_leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
