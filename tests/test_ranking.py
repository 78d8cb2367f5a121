"""Distributed numbering helpers against plain windows, with one hot key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathweave.operators.ranking import global_index, number_within_skew_safe, top_per_group
from pathweave.operators.vocab import count_at


def _skewed(spark):
    # a third of the rows under one key
    return spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("k"),
                                    (F.col("id") * 7919 % 3001).alias("v"), "id").repartition(6)


def test_global_index_is_a_total_order(spark):
    df = _skewed(spark)
    got = {r["id"]: r["g"] for r in global_index(df, [F.col("v"), F.col("id")], name="g").collect()}
    want = {r["id"]: r["g"] for r in df.select("id", (F.row_number().over(Window.orderBy("v", "id")) - 1).alias("g"))
            .collect()}
    assert got == want


def test_number_within_hot_key(spark):
    df = _skewed(spark)
    got = {r["id"]: r["rn"] for r in number_within_skew_safe(df, ["k"], [F.col("v"), F.col("id")]).collect()}
    w = Window.partitionBy("k").orderBy("v", "id")
    want = {r["id"]: r["rn"] for r in df.select("id", F.row_number().over(w).alias("rn")).collect()}
    assert got == want


def test_top_per_group_and_count_at(spark):
    df = _skewed(spark)
    top = top_per_group(df, ["k"], [F.col("v").desc(), F.col("id")], 3)
    assert top.filter(F.col("k") == 0).count() == 3
    hist = spark.createDataFrame([("a", 9), ("b", 7), ("c", 7), ("d", 2)], "word string, cnt long")
    vals = hist.select(count_at(hist, 0).alias("p0"), count_at(hist, 2).alias("p2"), count_at(hist, 4).alias("p4"))
    assert tuple(vals.collect()[0]) == (9, 7, None)


def test_numbers_go_on_over_partitions_without_a_join_back(spark):
    import random

    from pathweave.operators import ranking

    # one group far larger than a partition, groups of one, null and repeated keys
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    keys = ["hot"] * 5000 + [f"k{i % 90:02d}" for i in range(900)] + [None] * 5 + [f"z{i}" for i in range(20)]
    rows = [(k, i, i % 3 == 0) for i, k in enumerate(keys)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, b boolean").repartition(7)
    for cols in (["k"], ["k", "b"]):
        seen = {}
        want = {}
        for k, i, b in sorted(((r for r in rows if r[0] is not None)), key=lambda r: r[1]):
            g = (k, b) if len(cols) == 2 else k
            want[i] = seen[g] = seen.get(g, 0) + 1
        out = ranking.number_within_skew_safe(df, cols, [F.col("i")])
        assert out.columns == [*cols, *[c for c in ("k", "i", "b") if c not in cols], "rn"]
        assert {r.i: r.rn for r in out.collect()} == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert ranking.number_within_skew_safe(df.limit(0), ["k"], [F.col("i")]).count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    nan = float("nan")
    d = spark.createDataFrame([(nan, 1), (nan, 2), (1.0, 3)], "x double, i long")
    assert {r.i: r.rn for r in ranking.number_within_skew_safe(d, ["x"], [F.col("i")]).collect()} == {1: 1, 2: 2, 3: 1}
