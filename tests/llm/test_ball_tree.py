import math
import random

import numpy as np
from pyspark.sql import types as T

from pathweave.llm import ball_tree as B

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("id", T.StringType()), T.StructField("v", T.StringType())])


def brute(rows, asked, k):
    """Row by row: each row that is asked for against every other row."""
    data = {}
    for at, (i, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v):
            data[at] = (i, [math.floor(1024 * float(np.float32(x))) for x in v])
    cut = lambda n: max(-(2**63), min(2**63 - 1, n))
    out = []
    for at in asked:
        if at in data:
            q, x = data[at]
            s = sorted((-cut(sum(a * b for a, b in zip(x, v))), i is None, i or 0) for other, (i, v) in data.items() if other != at and len(v) == len(x))
            out += [(q, r + 1, None if none else i, -n) for r, (n, none, i) in enumerate(s[:k])]
    return sorted(map(str, out))


def check(spark, rows, k=10, **kw):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    got = B.top_k(df, df.where("vec_id % 10 = 0"), k, **kw).collect()
    assert sorted(str((r.query_id, r["rank"], r.vec_id, r.score)) for r in got) == brute(rows, [at for at, r in enumerate(rows) if r[0] is not None and r[0] % 10 == 0], k)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(700)]
    rows += [(i, [0.5] * 8) for i in range(700, 900)]  # ties
    rows += [(900, None), (910, []), (920, [float("nan")] * 8), (930, [None] + [0.1] * 7), (940, [float("inf")] * 8), (None, [0.1] * 8), (950, [0.2] * 5), (951, [0.3] * 5)]
    rows += [(0, [0.9] * 8), (5, rows[5][1]), (0, [0.9] * 8), (5, [9.0] * 8)]  # repeated ids, equal and not
    rows += [(20, [0.7] * 8)] * 30 + [(None, [0.8] * 8)] * 3 + [(30, [0.0, -0.0] * 4), (30, [-0.0, 0.0] * 4)]
    check(spark, rows, shard_rows=100, query_rows=20)


def test_huge_components_and_few_rows(spark):
    check(spark, [(0, [1e9, 2e5]), (1, [3e4, 1e9]), (10, [-1e9, 5.0]), (11, [0.0, 0.0])])
    check(spark, [(0, [1.0]), (1, [2.0])])


def test_empty(spark):
    check(spark, [])


def test_bound_prunes():
    x = np.floor(np.random.default_rng(0).normal(size=(4000, 4)) * 1024)
    t = B.BallTree(x, np.arange(4000))
    q = x[:1]
    assert len(t.nodes) > 30
    assert t.bounds(q)[0][0] >= (x @ q[0]).max()


def test_null_id_as_query(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], "x", "y"), (None, [1.0, 0.0], "x", "y"), (3, [2.0, 0.0], "x", "y")], SCHEMA)
    got = sorted(str((r.query_id, r["rank"], r.vec_id, r.score)) for r in B.top_k(df, df.where("vec_id is null")).collect())
    assert got == sorted(map(str, [(None, 1, 3, 2 * 1024**2), (None, 2, None, 1024**2)] * 2))
