"""Block products of two row tables, for matrices that no task should hold whole.

Both sides are dealt into blocks (``lb`` x ``rb``), each row is sent to the blocks it
meets, and a cogroup by block pair hands numpy two bounded matrices. What a pair yields is a
mergeable state, so results over all blocks come from a tree of aggregates. Nothing
is read past Spark and nothing goes through the driver.

``score_targets`` (C9, E6, D12, I7): state = k best (score, index), maximum, scaled sum of
exponentials and own score; merging the states of all target blocks gives the exact top k
(ties: the lower index), log-sum-exp and own score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20  # of a block's numbers
FAN_IN = 16  # states merged at once


def blocks(rows: int, dim: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Number of blocks of at most ``block_bytes`` for a matrix of at most so many rows."""
    return max(1, -(-rows * dim * 8 // block_bytes))


def block_pairs(left: DataFrame, left_key: str, lb: int, right: DataFrame, right_key: str, rb: int):
    """Both sides grouped by block pair (lb_, rb_), ready for applyInArrow."""

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    a = dealt(left, left_key, "lb_", lb, "rb_", rb).groupBy("lb_", "rb_")
    return a.cogroup(dealt(right, right_key, "rb_", rb, "lb_", lb).groupBy("lb_", "rb_"))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list<double> column, all of one length."""
    col = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if len(col) == 0:
        return np.zeros((0, 0))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(col), -1)


def _merge(state, other, k: int):
    m = F.greatest(state["m"], other["m"])

    def scaled(s):
        return F.when(s["z"] == 0, F.lit(0.0)).otherwise(s["z"] * F.exp(s["m"] - m))

    return F.struct(F.slice(F.array_sort(F.concat(state["best"], other["best"])), 1, k).alias("best"), m.alias("m"),
                    (scaled(state) + scaled(other)).alias("z"), F.coalesce(state["own"], other["own"]).alias("own"))


def score_states(codes: DataFrame, targets: DataFrame, k: int, target_rows: int, code_blocks: int | None = None,
                 block_bytes: int = BLOCK_BYTES, dim: int | None = None) -> DataFrame:
    """codes(ex, target_idx, code), targets(idx, vec) -> (ex, best, m, z, own), a row per ex.

    ``target_rows`` is a proven bound (the vocabulary's cap); ``code_blocks`` defaults to
    the session's shuffle partitions.
    """
    spark = codes.sparkSession
    cb = code_blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tb = blocks(target_rows, dim or 384, block_bytes)

    def run(left, right):
        import pyarrow as pa

        from ..functions.kernels import blocked_topk

        kind = pa.schema([("ex", pa.int64()), ("tb", pa.int32()),
                          ("best", pa.list_(pa.struct([("neg", pa.float64()), ("idx", pa.int32())]))),
                          ("m", pa.float64()), ("z", pa.float64()), ("own", pa.float64())])
        n = left.num_rows
        if n == 0:
            return kind.empty_table()
        block = left.column("rb_").combine_chunks().cast(pa.int32())
        if right.num_rows == 0:
            return pa.table([left.column("ex"), block, pa.array([[]] * n, kind.field("best").type),
                             pa.array([-np.inf] * n), pa.array([0.0] * n), pa.nulls(n, pa.float64())], schema=kind)
        idx = right.column("idx").to_numpy()
        order = np.argsort(idx, kind="stable")
        idx, M, C = idx[order].astype(np.int64), matrix(right.column("vec"))[order], matrix(left.column("code"))
        want = left.column("target_idx").to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(idx, want), len(idx) - 1)
        here = idx[at] == want
        s, i, lse, own = blocked_topk(C, M, k, true_idx=np.where(here, at, -1))
        best = pa.StructArray.from_arrays([pa.array(-s.ravel()), pa.array(idx[i.ravel()].astype(np.int32))], fields=list(kind.field("best").type.value_type))
        ends = pa.array(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32))
        # the log-sum-exp is its own maximum with a scaled sum of 1
        return pa.table([left.column("ex"), block, pa.ListArray.from_arrays(ends, best), pa.array(lse),
                         pa.array(np.ones(n)), pa.array(own, mask=~here)], schema=kind)

    pairs = block_pairs(codes.select("ex", "target_idx", "code"), "ex", cb, targets.select("idx", "vec"), "idx", tb)
    states = pairs.applyInArrow(run, "ex long, tb int, best array<struct<neg:double,idx:int>>, m double, z double, own double")
    if tb > 1:
        states = states.repartition("ex")  # every step of the tree groups within this partitioning
        while tb > 1:
            tb = -(-tb // FAN_IN)
            g = states.groupBy("ex", F.floor(F.col("tb") / FAN_IN).cast("int").alias("tb")).agg(
                F.collect_list(F.struct("best", "m", "z", "own")).alias("s"))  # FAN_IN states at most
            one = F.aggregate(F.slice("s", 2, FAN_IN), F.get("s", 0), lambda a, b: _merge(a, b, k))
            states = g.select("ex", "tb", one.alias("s")).select("ex", "tb", "s.*")
    return states.drop("tb")


def score_targets(codes: DataFrame, targets: DataFrame, k: int, target_rows: int, code_blocks: int | None = None,
                  block_bytes: int = BLOCK_BYTES, dim: int | None = None) -> DataFrame:
    """(ex, rank, idx, score, lse, own): the k best targets of every code vector, the log-sum-exp
    over all targets and the true target's score (null if that is no target)."""
    s = score_states(codes, targets, k, target_rows, code_blocks, block_bytes, dim)
    lse = F.col("m") + F.log("z")
    return s.select("ex", F.posexplode("best").alias("r", "b"), lse.alias("lse"), "own").select(
        "ex", (F.col("r") + 1).cast("int").alias("rank"), F.col("b.idx").alias("idx"), (-F.col("b.neg")).alias("score"), "lse", "own")
