"""Ordering helpers that stay distributed.

``global_index`` numbers rows in a total order without a single-partition
window: the rows are range-sorted, each row gets a partition-local id, the
sorted rows are checkpointed (so the ids are stable if a task is re-run),
and a per-partition count table -- one row per partition, a proven size
bound -- turns local ids into global positions.

``top_per_group`` is ``row_number() <= k``; Spark plans it with a partial
WindowGroupLimit before the shuffle, so a hot group never ships more than
``k`` rows per map task.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder as compressed columns and read back: a
    fraction of a checkpoint's size, and readers take only the columns they need. The order of
    rows and partitions is not kept. The files are small for their rows, so a hint keeps Spark
    from broadcasting them by their size; it holds through selections and aggregates, and joins
    with a result of joins name their kind.
    """
    out = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out).hint("merge")


def global_index(df: DataFrame, order: list[Column | str], name: str = "gidx") -> DataFrame:
    """Add a 0-based position of each row in the total order ``order``.

    The order must be total (ties broken by the caller), otherwise positions
    of tied rows are arbitrary.
    """
    tagged = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    tagged = reliable_checkpoint(tagged)
    pid = F.shiftright("_mid", _LOCAL_BITS)
    sizes = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the running sum over it is small by construction
    offsets = sizes.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), pid == offsets._pid)
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), _LOCAL_BITS)
    return out.withColumn(name, (F.col("_off") + local).cast("long")).drop("_mid", "_pid", "_off")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column | str], k: int,
                  rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows of every group by ``order`` (1-based ``rank_col``)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def number_within(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rn") -> DataFrame:
    """1-based row number inside each group (groups are bounded bags here)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w))


def maybe_broadcast(df: DataFrame, max_rows: int, row_bytes: int, limit_bytes: int) -> DataFrame:
    """Broadcast ``df`` only when its proven row bound fits the limit.

    Above the limit the join is left to the planner (sort-merge, AQE may
    still switch to broadcast when the runtime size turns out small).
    """
    return F.broadcast(df) if max_rows * row_bytes <= limit_bytes else df


def number_within_skew_safe(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rn") -> DataFrame:
    """1-based row number inside each group without putting a group in one task.

    Rows are range-sorted by (keys, order) and numbered within their group partition by
    partition; a group that goes on over partitions takes up the count of those before, which
    is told from the first and the last row of each partition. One shuffle, no join back.
    Rows with a null key are left out.
    """
    known = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys]))
    tagged = known.orderBy(*keys, *order).withColumn("_mid", F.monotonically_increasing_id())

    def number(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def finish(batch, n, head, edge):
            for c, v in (("_n", n), ("_head", head), ("_edge", edge)):
                batch = batch.append_column(c, pa.array(v))
            return batch

        held, before, groups, count = None, None, 0, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows, new = np.arange(batch.num_rows), np.zeros(batch.num_rows, bool)
            for c in keys:
                v = batch.column(c)
                if before is None:
                    new[0] = True
                elif not _same(before[c], v[0].as_py()):
                    new[0] = True
                differ = pc.not_equal(v[1:], v[:-1])
                if pa.types.is_floating(v.type):  # NaN is one group
                    differ = pc.and_not(differ, pc.and_(pc.is_nan(v[1:]), pc.is_nan(v[:-1])))
                new[1:] |= differ.to_numpy(zero_copy_only=False)
            start = np.maximum.accumulate(np.where(new, rows, -count))
            n, nth = rows - start + 1, groups + np.cumsum(new)
            edge = np.zeros(len(rows), bool)
            edge[0] = before is None
            if held is not None:
                yield finish(*held)
            held, groups, count = (batch, n, nth == 1, edge), int(nth[-1]), int(n[-1])
            before = {c: batch.column(c)[batch.num_rows - 1].as_py() for c in keys}
        if held is not None:
            held[3][-1] = True
            yield finish(*held)

    schema = tagged.withColumns({"_n": F.lit(0).cast("long"), "_head": F.lit(True), "_edge": F.lit(True)}).schema
    t = stored(tagged.mapInArrow(number, schema)).withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
    carry, last, count = [], None, 0
    # at most two rows per partition
    edges = t.filter("_edge").select("_pid", "_mid", "_n", "_head", *keys).collect()
    for r in sorted(edges, key=lambda r: r["_mid"]):
        key = [r[c] for c in keys]
        if r["_mid"] == r["_pid"] << _LOCAL_BITS:  # the first row of its partition
            on = count if last is not None and all(map(_same, last, key)) else 0
            if on:
                carry.append((r["_pid"], on))
        last, count = key, r["_n"] + (on if r["_head"] else 0)
    number_ = F.col("_n")
    if carry:
        more = df.sparkSession.createDataFrame(carry, "_pid long, _c long")
        t = t.join(F.broadcast(more), "_pid", "left")
        number_ = number_ + F.when(F.col("_head"), F.coalesce("_c", F.lit(0))).otherwise(0)
    return t.select(*keys, *[c for c in df.columns if c not in keys], number_.alias(name))


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def affine_scan(df: DataFrame, order: list[Column | str], a: Column, b: Column, name: str) -> DataFrame:
    """Running value v of v <- a * v + b (from 0) over the rows in a total order.

    Maps v -> a v + b compose, so each range partition yields one map, the few maps of the
    partitions give each partition's first value, and a second pass applies the maps
    within it. a = 1 is a running sum; a = 0 starts anew (the first row of a group), so one
    scan serves all groups and a hot group is no task of its own.
    """
    tagged = df.withColumns({"_a": a.cast("double"), "_b": b.cast("double")}).orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    tagged = reliable_checkpoint(tagged).withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))

    def scan(batches, value=None):
        """Composes the maps of a partition's rows in order; with ``value`` also applies them."""
        import numpy as np
        import pyarrow as pa

        total, pid = (1.0, 0.0), None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            pid = batch.column("_pid")[0].as_py()
            A, B = (np.array(batch.column(c), dtype=float) for c in ("_a", "_b"))
            step = 1
            while step < len(A):  # prefix composition by doubling
                A2, B2 = A.copy(), B.copy()
                B2[step:] = A[step:] * B[:-step] + B[step:]
                A2[step:] = A[step:] * A[:-step]
                A, B, step = A2, B2, 2 * step
            if value is not None:
                start = total[0] * value[pid] + total[1]
                yield batch.append_column(name, pa.array(A * start + B))
            total = (A[-1] * total[0], A[-1] * total[1] + B[-1])
        if value is None and pid is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pid]), pa.array([total[0]]), pa.array([total[1]])], names=["_pid", "_a", "_b"])

    maps = tagged.select("_pid", "_a", "_b").mapInArrow(scan, "_pid long, _a double, _b double")
    first, v = {}, 0.0
    for r in sorted(maps.collect()):  # a row per partition
        first[r["_pid"]] = v
        v = r["_a"] * v + r["_b"]
    out = tagged.mapInArrow(lambda batches: scan(batches, first), tagged.withColumn(name, F.lit(0.0)).schema)
    return out.drop("_a", "_b", "_mid", "_pid")
