"""Prefix scans, interval labels and sampled name pairs on awkward shapes."""

import random

import numpy as np
from pyspark.sql import functions as F

from pathweave.operators import ranking as R
from pathweave.operators import trees as T


def test_affine_scan_equals_a_loop(spark):
    rng = random.Random(0)
    rows = [(i, f"u{0 if rng.random() < 0.6 else rng.randrange(9)}", rng.random()) for i in range(3000)]  # one hot user
    df = spark.createDataFrame(rows, "i long, u string, x double").repartition(7)
    first = df.groupBy("u").agg(F.min("i").alias("i0"))
    df = df.join(first, "u")
    new = F.col("i") == F.col("i0")
    got = R.affine_scan(df, ["u", "i"], F.when(new, 0.0).otherwise(0.5), F.when(new, F.col("x")).otherwise(F.col("x") / 2), "v").collect()
    want, last = {}, {}
    for i, u, x in rows:
        last[u] = x if u not in last else 0.5 * last[u] + 0.5 * x
        want[i] = last[u]
    assert len(got) == 3000 and all(np.isclose(r.v, want[r.i]) for r in got)
    assert R.affine_scan(df.limit(0), ["u", "i"], F.lit(1.0), F.col("x"), "v").count() == 0


def test_intervals_equal_recursion(spark):
    rng = random.Random(1)
    rows, kids = [], {}
    for t in range(3):
        ids = ["r"]
        rows.append((t, "r", None, "K", None))
        for _ in range(150 if t else 1):
            p = ids[-1] if t == 1 else rng.choice(ids)  # tree 1 is one deep chain
            k = kids[t, p] = kids.get((t, p), -1) + 1
            ids.append(f"{p}/{k:03d}")
            rows.append((t, ids[-1], p, "K", rng.choice(["tok", None])))
    df = spark.createDataFrame(rows, "tree_id long, node_id string, parent_id string, kind string, token string").withColumn("child_idx", F.lit(0))
    got = {(r.tree_id, r.node_id): (r.n_desc, r.n_leaves) for r in T.subtree_closure(df).collect()}
    parents = {(t, p) for t, _, p, _, _ in rows if p is not None}
    leaf = {(t, n) for t, n, _, _, tok in rows if tok and (t, n) not in parents}
    for t, n in parents:
        below = [m for u, m, *_ in rows if u == t and m.startswith(n + "/")]
        assert got.pop((t, n)) == (len(below), sum((t, m) in leaf for m in below))
    assert not got


def test_sampled_pairs_are_distinct_and_few_from_a_large_unit(spark):
    big = spark.range(50_000).select(F.lit(1).cast("long").alias("tree_id"), F.format_string("v%06d", "id").alias("var"), F.col("id").cast("int").alias("first_ord"))
    small = spark.range(4).select(F.lit(2).cast("long").alias("tree_id"), F.format_string("v%d", "id").alias("var"), (F.col("id") * 3).cast("int").alias("first_ord"))
    got = T.variable_pairs(big.unionByName(small), 3000).collect()
    one = {(r.v1, r.v2) for r in got if r.tree_id == 1}
    assert len(one) == 3000 == sum(r.tree_id == 1 for r in got) and all(a <= b for a, b in one)
    assert len({r.v1 for r in got if r.tree_id == 1}) > 2500  # spread over the names
    two = {(r.v1, r.v2) for r in got if r.tree_id == 2}
    assert two == {(f"v{i}", f"v{j}") for j in range(4) for i in range(j + 1)}  # a permutation of all ten
