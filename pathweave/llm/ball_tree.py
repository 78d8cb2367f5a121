"""Exact top-k by inner product: a ball tree per shard, branch and bound.

Vectors become integers, floor(scale * x) with x as double. They are dealt by a
hash of their id into shards of about ``shard_rows`` vectors of one dimension;
every shard builds a ball tree (split at the median of the widest direction,
centre and radius per node). A query orders nodes by the upper bound
<q, centre> + |q| * radius and stops when the best bound left is below its kth
score. The kth score is shared: a query is answered in its home shard first, and
that score is where all other shards begin. Queries travel in blocks of
``query_rows``, so a task holds one shard and one block whatever the table size.

Ties go to the smaller id, and a bound equal to the kth score is still opened,
so the result equals brute force. Vectors that are null, empty, or hold null or
non-finite components take no part. Vectors of different dimensions do not meet.
Rows that repeat an id are candidates each: a query's own row alone is left out, not
others of its id. Equal rows (id and vector) travel once with their number, and take
as many ranks. Every row that is a query has its own answer; answers of one query_id are
told apart by query_hash (xxhash64 of the vector), and those of equal rows are equal.
Null ids can be found (after all others in ties), and queried under a null query_id.
Scores use float64 matrix products where these are exact (below 2**53), else
Python integers; scores beyond 64 bits are cut to the largest long.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

LEAF = 128
EXACT = float(2**53)


def to_integers(rows: pd.Series, scale: float) -> np.ndarray:
    """floor(scale * x): float64 if every product sum stays exact, else Python integers."""
    x = np.floor(scale * np.stack([np.asarray(v, dtype=np.float64) for v in rows]))
    top = np.abs(x).max(initial=0.0)
    if top * top * x.shape[1] < EXACT:
        return x
    return np.array([[int(v) for v in row] for row in x], dtype=object)


class BallTree:
    """Nodes over integer rows; ``ids`` (of equal rank in ties: smaller first) ascending within every leaf."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF, copies: np.ndarray | None = None):
        self.x, self.ids = x, ids
        self.copies = np.ones(len(x), np.int64) if copies is None else copies
        f = x.astype(np.float64)
        self.nodes: list[tuple[np.ndarray, int, int]] = []  # (rows, left, right), left < 0: a leaf
        centres, radii = [], []
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                r, a, b = self.nodes[parent]
                self.nodes[parent] = (r, me, b) if side == 0 else (r, a, me)
            c = f[rows].mean(axis=0)
            centres.append(c)
            radii.append(np.sqrt(((f[rows] - c) ** 2).sum(axis=1).max()))
            if len(rows) <= leaf or radii[-1] == 0:
                self.nodes.append((rows[np.argsort(ids[rows], kind="stable")], -1, -1))
                continue
            self.nodes.append((rows, -2, -2))
            far = f[rows[np.argmax(((f[rows] - c) ** 2).sum(axis=1))]] - c
            order = rows[np.argsort(f[rows] @ far, kind="stable")]
            half = len(order) // 2
            todo += [(order[half:], me, 1), (order[:half], me, 0)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, q: np.ndarray, bounds: np.ndarray, own: int, k: int, floor) -> list[tuple]:
        """Best k (score, -id) with score >= floor, best first; a copy of row ``own`` (-1: none) is left out."""
        best: list[tuple] = []  # heap of (score, -id)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            kth = best[0][0] if len(best) == k else floor
            if kth is not None and -bound < kth:
                break
            rows, a, b = self.nodes[node]
            if a >= 0:
                heapq.heappush(heap, (max(bound, -bounds[a]), a))
                heapq.heappush(heap, (max(bound, -bounds[b]), b))
                continue
            scores = self.x[rows] @ q
            if kth is not None:
                ok = np.flatnonzero(scores >= kth)
                scores, rows = scores[ok], rows[ok]
            for s, i, m, r in zip(scores.tolist(), self.ids[rows].tolist(), self.copies[rows].tolist(), rows.tolist(), strict=True):
                for _ in range(min(k, m - (r == own))):
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                    else:
                        break
        return sorted(best, reverse=True)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of <q_i, x> over each node, a little above any rounding."""
        f = q.astype(np.float64)
        reach = np.sqrt((f * f).sum(axis=1))
        b = f @ self.centres.T + reach[:, None] * self.radii[None, :]
        slack = 1e-9 * (np.abs(b) + reach[:, None] * (np.sqrt((self.centres**2).sum(axis=1)) + self.radii)[None, :]) + 1e-6
        return b + slack


NULL = 2**63  # stands for a null id within a task: after every long


def _ids(f: pd.DataFrame) -> list[int]:
    return [NULL if none else i for i, none in zip(f["id"].tolist(), f["none"].tolist(), strict=True)]


def _searcher(scale: float, k: int):
    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(vectors) and len(queries):
            both = to_integers(pd.concat([vectors["v"], queries["v"]]), scale)
            x, q = both[: len(vectors)], both[len(vectors) :]
            names = _ids(vectors)
            ids = np.array(names, object if NULL in names else np.int64)
            tree = BallTree(x, ids, copies=vectors["m"].to_numpy(np.int64))
            bounds = tree.bounds(q)
            key = lambda i, v: (i, (np.asarray(v, np.float64) + 0.0).tobytes())
            at = {key(i, v): r for r, (i, v) in enumerate(zip(names, vectors["v"], strict=True))}
            for i, (me, v, h, floor) in enumerate(zip(_ids(queries), queries["v"], queries["h"].tolist(), queries["kth"].tolist(), strict=True)):
                floor = None if floor is None or floor != floor else int(floor)
                for s, neg in tree.search(q[i], bounds[i], at.get(key(me, v), -1), k, floor):
                    rows.append((None if me == NULL else me, h, None if -neg == NULL else -neg, max(-(2**63), min(2**63 - 1, int(s)))))
        f = pd.DataFrame(rows, columns=["query_id", "query_hash", "vec_id", "score"], dtype=object)
        return f.astype({"query_id": "Int64", "query_hash": "int64", "vec_id": "Int64", "score": "int64"})

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score, query_hash: the k highest inner products of every query row
    (``queries`` has the same two columns) with the rows of ``vectors`` but its own."""
    good = F.expr("v is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))")

    def clean(df: DataFrame) -> DataFrame:
        got = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(good)
        got = got.withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))  # -0.0 is 0.0
        got = got.groupBy("id", "v").agg(F.count("*").alias("m")).withColumns({"dim": F.size("v"), "h": F.xxhash64("v"), "none": F.col("id").isNull()})
        return got.withColumn("id", F.coalesce("id", F.lit(0)))

    data, asked = stage(clean(vectors), "topk-vectors"), stage(clean(queries), "topk-queries")
    counts = {r["dim"]: r["n"] for r in data.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per dimension
    blocks = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    parts = {d: max(1, -(-n // shard_rows)) for d, n in counts.items()}
    blks = {d: max(1, -(-blocks.get(d, 0) // query_rows)) for d in counts}
    if not counts:
        parts, blks = {0: 1}, {0: 1}
    pick = lambda m: F.coalesce(F.create_map(*[F.lit(int(x)) for p in m.items() for x in p])[F.col("dim")], F.lit(1))
    data = data.withColumn("shard", F.pmod(F.xxhash64("id", "h"), pick(parts)))
    asked = asked.withColumn("home", F.pmod(F.xxhash64("id", "h"), pick(parts))).withColumn("block", F.pmod(F.xxhash64("id", "h", F.lit(7)), pick(blks)))
    out = "query_id long, query_hash long, vec_id long, score long"
    spread = data.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (pick(blks) - 1).cast("long"))))
    keys = ["dim", "shard", "block"]

    def run(q: DataFrame) -> DataFrame:
        return spread.select(*keys, "id", "none", "v", "m").groupBy(*keys).cogroup(q.select(*keys, "id", "none", "v", "h", "kth").groupBy(*keys)).applyInPandas(_searcher(scale, k), out)

    first = stage(run(asked.withColumn("shard", F.col("home")).withColumn("kth", F.lit(None).cast("long"))), "topk-home")
    kth = first.groupBy("query_id", "query_hash").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    kth = kth.select("query_id", "query_hash", F.when(F.col("n") >= k, F.col("low")).alias("kth"))
    named = asked.withColumn("query_id", F.when(~F.col("none"), F.col("id")))
    same = F.expr("a.query_id <=> b.query_id and a.h = b.query_hash")
    others = named.alias("a").join(kth.alias("b"), same, "left").select("a.*", "kth")
    others = others.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), (pick(parts) - 1).cast("long")))).where("shard <> home")
    found = first.unionByName(run(others))
    w = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    times = named.where("m > 1").select("query_id", "h", "m")
    best = best.alias("a").join(times.alias("b"), F.expr("a.query_id <=> b.query_id and a.query_hash = b.h"), "left")
    best = best.select("a.*", F.explode(F.expr("sequence(1L, coalesce(m, 1L))")).alias("__copy"))
    return best.select("query_id", "rank", "vec_id", "score", "query_hash")
