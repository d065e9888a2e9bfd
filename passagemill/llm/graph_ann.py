"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard.

Equal vectors are one entry of the index, with their smallest ids. Entries are spread over shards
of bounded size by a hash. A shard's graph is built from random links: greedy searches from
its medoid propose neighbours for each entry, and relaxed distance pruning keeps those that no
kept neighbour is much nearer to, so long edges stay; the edges also run back. Queries go in
blocks to every shard, where a beam search follows the graph. Inner products become
distances by one more coordinate that lifts all vectors to the same length. Scores are exact
inner products of the original vectors in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from passagemill.llm.shared import drop_stored, stored


@dataclass(frozen=True)
class GraphRule:
    shard_rows: int = 8192
    degree: int = 32
    build_beam: int = 48
    beam: int = 96
    #: An entry stays unless a kept neighbour is this many times nearer to it (squared distances).
    slack: float = 1.44
    query_block: int = 512
    batch: int = 256
    seed: int = 11


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _beam(x: np.ndarray, links: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest entries found for each query, nearest first, and their distances (infinite where none).

    All queries step together: each opens its nearest unopened entries until none is left in its beam.
    """
    n, rows = len(x), len(q)
    norm = np.einsum("ij,ij->i", x, x)
    seen = np.zeros((rows, n + 1), bool)
    seen[:, n] = True
    ids = np.full((rows, beam), n)
    dist = np.full((rows, beam), np.inf, np.float32)
    opened = np.ones((rows, beam), bool)
    ids[:, 0], opened[:, 0] = start, False
    dist[:, 0] = norm[start] - 2 * q @ x[start]
    seen[:, start] = True
    live = np.arange(rows)
    while len(live):
        d = np.where(opened[live], np.inf, dist[live])
        best = d.argmin(axis=1)
        go = np.isfinite(d[np.arange(len(live)), best])
        live, best = live[go], best[go]
        if not len(live):
            break
        opened[live, best] = True
        near = np.sort(links[ids[live, best]], axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = ~seen[live[:, None], near]
        near = np.where(fresh, near, n)
        seen[live[:, None], near] = True
        safe = np.minimum(near, n - 1)
        away = norm[safe] - 2 * np.einsum("bd,bkd->bk", q[live], x[safe])
        away = np.where(near < n, away, np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], away], axis=1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        at = np.arange(len(live))[:, None]
        ids[live] = np.concatenate([ids[live], near], axis=1)[at, keep]
        opened[live] = np.concatenate([opened[live], near == n], axis=1)[at, keep]
        dist[live] = all_d[at, keep]
    order = np.argsort(dist, axis=1, kind="stable")
    at = np.arange(rows)[:, None]
    return ids[at, order], dist[at, order]


def _pruned(x: np.ndarray, of: np.ndarray, found: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Robust pruning of candidate lists (rows of ids, len(x) for none): at most ``degree`` diverse neighbours each."""
    n = len(x)
    found = np.sort(found, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = n
    found[found == of[:, None]] = n
    c = x[np.minimum(found, n - 1)]
    d = ((c - x[of][:, None]) ** 2).sum(axis=2)
    norm = np.einsum("bkd,bkd->bk", c, c)
    between = norm[:, :, None] + norm[:, None, :] - 2 * (c @ c.transpose(0, 2, 1))
    alive = found < n
    out = np.full((len(of), degree), n)
    rows = np.arange(len(of))
    for k in range(degree):
        best = np.where(alive, d, np.inf).argmin(axis=1)
        ok = alive[rows, best]
        if not ok.any():
            break
        out[ok, k] = found[rows, best][ok]
        alive &= ~((slack * between[rows, best] <= d) & ok[:, None])
        alive[rows, best] = False
    return out


def build(x: np.ndarray, rule: GraphRule) -> tuple[np.ndarray, int]:
    """Links (len(x) where a row has fewer) and the entry point."""
    n = len(x)
    rng = np.random.default_rng(rule.seed)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    if n <= rule.degree + 1:
        return np.array([[j for j in range(n) if j != i] + [n] * (rule.degree - n + 1) for i in range(n)]), start
    links = rng.integers(0, n, (n, rule.degree))
    for slack in (1.0, rule.slack):
        for part in np.array_split(rng.permutation(n), -(-n // rule.batch)):
            found, _ = _beam(x, links, start, x[part], rule.build_beam)
            links[part] = _pruned(x, part, np.concatenate([found, links[part]], axis=1), rule.degree, slack)
            _run_back(x, links, part, rule.degree, slack)
    return links, start


def _run_back(x: np.ndarray, links: np.ndarray, part: np.ndarray, degree: int, slack: float) -> None:
    """Add the edges from each new neighbour back; full lists are pruned again."""
    n = len(x)
    to, back = links[part].ravel(), np.repeat(part, degree)
    to, back = to[to < n], back[to < n]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    target, first, count = np.unique(to, return_index=True, return_counts=True)
    # in steps, so a hub's many new edges never widen the lists of all others
    for turn in range(0, int(count.max(initial=0)), degree):
        here = np.flatnonzero(count > turn)
        width = np.minimum(count[here] - turn, degree)
        more = np.full((len(here), degree), n)
        row = np.repeat(np.arange(len(here)), width)
        col = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        more[row, col] = back[first[here][row] + turn + col]
        t = target[here]
        for k in range(0, len(t), 1024):
            own = slice(k, k + 1024)
            lists = np.sort(np.concatenate([links[t[own]], more[own]], axis=1), axis=1)
            lists[:, 1:][lists[:, 1:] == lists[:, :-1]] = n
            used = (lists < n).sum(axis=1)
            packed = np.sort(lists, axis=1)[:, :degree]
            full = used > degree
            if full.any():
                packed[full] = _pruned(x, t[own][full], lists[full], degree, slack)
            links[t[own]] = packed


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    v = vectors / longest
    rest = np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1)))
    return np.concatenate([v, rest[:, None]], axis=1).astype(np.float32)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _plain(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    # -0.0 and 0.0 are one value
    return v.select("vec_id", F.transform("v", lambda x: x + 0.0).alias("v"))


def index(vectors: DataFrame, k: int, rule: GraphRule = GraphRule(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Graphs of all usable vectors: one row per width and shard, (width, shard, ids, vectors, links, start, longest), stored.

    ``ids`` has the ``k`` + 1 smallest ids of each distinct vector: no answer of ``k`` rows needs more.
    """
    plain = _plain(vectors, id_col, vector_col).withColumn("key", F.xxhash64("v"))
    nth = F.row_number().over(Wd.partitionBy("v").orderBy("vec_id"))
    entries = (
        plain.dropDuplicates(["vec_id", "v"]).withColumn("nth", nth).where(F.col("nth") <= k + 1)
        .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    entries = stored(entries.withColumn("width", F.size("v")), "entries")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    widths = entries.groupBy("width").agg(F.count("*").alias("n"), F.sqrt(F.max(length)).alias("longest"))
    widths = widths.withColumn("shards", F.ceil(F.col("n") / rule.shard_rows).cast("int"))
    # one row per vector width
    placed = entries.join(F.broadcast(widths), "width").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def make(key: tuple, part: pa.Table) -> pa.Table:
        width = key[0].as_py()
        v = _matrix(part["v"], width)
        first = np.array([i[0] for i in part["ids"].to_pylist()])
        order = np.argsort(first, kind="stable")
        v = v[order]
        longest = part["longest"][0].as_py()
        links, start = build(_lifted(v, longest), rule)
        return pa.table({
            "width": pa.array([width], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
            "ids": pa.array([part["ids"].take(pa.array(order)).to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "vectors": pa.array([v.tobytes()], pa.binary()), "links": pa.array([links.astype(np.int32).tobytes()], pa.binary()),
            "start": pa.array([start], pa.int32()), "longest": pa.array([longest]), "shards": pa.array([part["shards"][0].as_py()], pa.int32()),
        })

    shape = "width int, shard int, ids array<array<long>>, vectors binary, links binary, start int, longest double, shards int"
    made = stored(placed.select("width", "shard", "shards", "v", "ids", "longest").groupBy("width", "shard").applyInArrow(make, shape), "graphs")
    drop_stored(entries)
    return made


def search(
    graphs: DataFrame, queries: DataFrame, k: int, rule: GraphRule = GraphRule(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest found entries of each query but itself: query_id, rank, vec_id, score.

    ``queries`` go in blocks of ``rule.query_block`` to every shard of their width.
    """
    q = _plain(queries, id_col, vector_col).select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("width"))
    shards = graphs.select("width", "shard", "shards")
    n = q.count()
    groups = max(1, -(-n // (rule.query_block * 16)))
    # one row per shard meets each group of queries; the small table of shards is counted by the entries / shard_rows
    per_width = F.broadcast(shards.select("width", "shards").distinct())
    asked = q.join(per_width, "width").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).select("width", "shard", "part", "query_id", "v")
    held = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(key: tuple, asked_: pa.Table, graph: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        if asked_.num_rows and graph.num_rows:
            width = key[0].as_py()
            row = graph.slice(0, 1).to_pylist()[0]
            v = np.frombuffer(row["vectors"], np.float64).reshape(-1, width)
            links = np.frombuffer(row["links"], np.int32).reshape(len(v), -1).astype(np.int64)
            x, ids = _lifted(v, row["longest"]), row["ids"]
            own, qv = asked_["query_id"].to_numpy(), _matrix(asked_["v"], width)
            for a in range(0, len(own), rule.query_block):
                some = qv[a : a + rule.query_block]
                # the query's length does not matter for the order; its last coordinate is 0
                unit = some / np.sqrt((some * some).sum(axis=1, keepdims=True))
                flat = np.concatenate([unit, np.zeros((len(some), 1))], axis=1).astype(np.float32)
                found, _ = _beam(x, links, row["start"], flat, max(rule.beam, k + 1))
                for i, near in enumerate(found):
                    near = near[near < len(v)]
                    score = v[near] @ some[i]
                    pairs = [(s, j) for s, e in zip(score.tolist(), near.tolist()) for j in ids[e] if j != own[a + i]]
                    pairs.sort(key=lambda p: (-p[0], p[1]))
                    out.append(np.array([(own[a + i], j, s) for s, j in pairs[:k]], dtype=[("q", "i8"), ("j", "i8"), ("s", "f8")]))
        rows = np.concatenate(out) if out else np.zeros(0, dtype=[("q", "i8"), ("j", "i8"), ("s", "f8")])
        return pa.table([pa.array(rows["q"]), pa.array(rows["j"]), pa.array(rows["s"])], names=["query_id", "vec_id", "score"])

    found = asked.groupBy("width", "shard", "part").cogroup(held.groupBy("width", "shard", "part")).applyInArrow(
        run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Wd.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, rule: GraphRule = GraphRule(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """For each row of ``vectors`` for which ``is_query`` holds, its ``k`` nearest other rows as found.

    Columns query_id, rank (from 1), vec_id, score (inner product, double); ties go to the smaller vec_id, fewer rows where there
    are fewer candidates. Vectors null, empty, zero or with null or non-finite components, and rows without an id, take no part;
    vectors meet those of their own length only. Equal vectors under different ids are all candidates; a row
    repeated whole counts once, as a query and as a candidate. An empty table gives an empty one; other columns are not read.
    """
    graphs = index(vectors, k, rule, id_col, vector_col)
    queries = vectors.where(is_query).select(id_col, vector_col)
    return search(graphs, queries.dropDuplicates([id_col, vector_col]), k, rule, id_col, vector_col)
