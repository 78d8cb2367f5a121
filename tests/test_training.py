"""Sharded training equals dense single-device Adam, whatever the shards and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathweave.functions import backprop as B
from pathweave.operators import scoring as SC
from pathweave.operators import train as TR


def setup(spark, tokens=40, paths=20, targets=13, n=60, seed=1):
    rng = np.random.default_rng(seed)
    vocab = lambda k: spark.range(k).withColumnRenamed("id", "idx")
    init = TR.init_params(spark, vocab(tokens), vocab(paths), vocab(targets), 3, 2, 7).persist()
    rows = []
    for ex in range(n):
        k = int(rng.integers(1, 5))
        rows.append((ex * 7 - 50, int(rng.integers(1, targets)), *(rng.integers(0, 25 if c != "p" else 15, k).tolist() for c in "spd")))
    bags = spark.createDataFrame(rows, "ex long, target_idx int, s array<int>, p array<int>, d array<int>")
    return init, bags, rows


def dense(init, rows, bags, epochs, batch, lr, keep, seed):
    """Mini-batch Adam on dense arrays, batches in the operator's order."""
    P = {}
    for name in ("token", "path", "target", "transform", "attention"):
        P[name] = np.array([r.vec for r in sorted((r for r in init if r.name == name), key=lambda r: r.row)])
    P["attention"] = P["attention"][0]
    M, V = ({k: np.zeros_like(x) for k, x in P.items()} for _ in range(2))
    by_ex, t, log = {r[0]: r for r in rows}, 0, []
    for e in range(epochs):
        order = [r.ex for r in bags.orderBy(F.xxhash64(F.lit(seed), F.lit(e), F.col("ex")), "ex").select("ex").collect()]
        total = 0.0
        for i in range(0, len(order), batch):
            part = [by_ex[x] for x in order[i : i + batch]]
            masks = [B.dropout_mask(r[0], len(r[2]), P["transform"].shape[0], keep, (seed, e)) for r in part]

            class Fixed:  # hands the masks to the dense code as random numbers
                def random(self, shape):
                    return np.where(np.vstack(masks) > 0, 0.0, 1.0)

            loss, g, _ = B.forward_backward([(r[1], *(np.array(x) for x in r[2:])) for r in part], P, keep, Fixed())
            t += 1
            B.adam_step(P, M, V, g, t, lr)
            total += loss
        log.append(total / len(order))
    return P, log


@pytest.mark.parametrize("shards,block_bytes,cores", [(1, 1 << 20, 2), (5, 400, 4)])
def test_equals_dense_adam(spark, tmp_path, shards, block_bytes, cores):
    init, bags, rows = setup(spark)
    base = str(tmp_path / "p")
    log = TR.fit(spark, bags.repartition(cores), init, base, 2, shards, batch_size=25, lr=0.01, seed=3, target_rows=13, block_bytes=block_bytes)
    P, want = dense(init.collect(), rows, bags, 2, 25, 0.01, 0.75, 3)
    assert np.allclose([x for _, x in log], want, rtol=0, atol=1e-9)
    got = spark.read.parquet(TR.epoch_path(base, 2)).collect()
    assert len(got) == init.count()
    for r in got:
        w = P["attention"] if r.name == "attention" else P[r.name][r.row]
        assert np.allclose(r.vec, w, rtol=0, atol=1e-9), (r.name, r.row)


def test_resuming_equals_going_on(spark, tmp_path):
    init, bags, _ = setup(spark, n=30)
    kw = dict(shards=3, batch_size=16, lr=0.01, seed=5, target_rows=13)
    a = TR.fit(spark, bags, init, str(tmp_path / "a"), 2, **kw)
    b = TR.fit(spark, bags, init, str(tmp_path / "b"), 1, **kw)
    seen = []
    b += TR.fit(spark, bags, None, str(tmp_path / "b"), 1, start_epoch=1, eval_every=2, on_step=lambda t, p: seen.append((t, spark.read.parquet(p).count())), **kw)
    assert np.allclose([x for _, x in a], [x for _, x in b], rtol=0, atol=1e-12)
    assert seen == [(4, init.count())]


def test_no_task_gets_more_than_its_rows(spark):
    """A vocabulary 100 times what a shard touches: shards are joined with their rows only."""
    _, bags, rows = setup(spark, n=40)
    sharded = bags.withColumn("shard", F.pmod(F.xxhash64("ex"), F.lit(4)).cast("int"))
    used = TR._used(sharded)
    table = spark.range(5000).select(F.explode(F.array(F.lit("token"), F.lit("path"))).alias("name"), F.col("id").cast("int").alias("row"), F.array(F.lit(1.0)).alias("vec"))
    most = used.join(table, ["name", "row"]).groupBy("shard").count().agg(F.max("count")).first()[0]
    assert most <= 50
    assert used.count() == used.distinct().count()


def test_empty_bags(spark, tmp_path):
    init, bags, _ = setup(spark)
    base = str(tmp_path / "e")
    assert TR.fit(spark, bags.limit(0), init, base, 1, 2, target_rows=13) == [(1, None)]
    assert spark.read.parquet(TR.epoch_path(base, 1)).count() == init.count()


@pytest.mark.parametrize("block_bytes", [64, 640, 1 << 20])
def test_partitioned_scores_equal_full_sort(spark, block_bytes):
    rng = np.random.default_rng(8)
    C, T = rng.integers(-2, 3, size=(30, 2)).astype(float), rng.integers(-2, 3, size=(90, 2)).astype(float)
    codes = spark.createDataFrame([(i, i if i % 3 else 1000, C[i].tolist()) for i in range(30)], "ex long, target_idx int, code array<double>")
    targets = spark.createDataFrame([(j, T[j].tolist()) for j in range(90)], "idx int, vec array<double>").repartition(3)
    got = SC.score_targets(codes, targets, 6, 90, 4, block_bytes, dim=2).collect()
    full = C @ T.T
    assert len(got) == 180
    for i in range(30):
        mine = sorted((r for r in got if r.ex == i), key=lambda r: r.rank)
        assert [r.idx for r in mine] == sorted(range(90), key=lambda j: (-full[i, j], j))[:6]
        assert np.isclose(mine[0].lse, np.log(np.exp(full[i]).sum()))
        assert (mine[0].own is None) == (i % 3 == 0) and (i % 3 == 0 or mine[0].own == full[i, i])


@pytest.mark.parametrize("shards,block_bytes", [(5, 400)])
def test_equals_dense_adam_over_shards_of_a_large_model(spark, tmp_path, shards, block_bytes):
    """The way of models that no task holds, which small ones no longer take."""
    init, bags, rows = setup(spark, n=40)
    log = TR.fit(spark, bags, init, str(tmp_path / "p"), 1, shards, batch_size=25, lr=0.01, seed=3, target_rows=13, block_bytes=block_bytes, here=0)
    _, want = dense(init.collect(), rows, bags, 1, 25, 0.01, 0.75, 3)
    assert np.allclose([x for _, x in log], want, rtol=0, atol=1e-9)


def test_small_models_take_one_job_an_epoch(spark, tmp_path, monkeypatch):
    """a step was a dozen jobs; slices of any size give dense Adam."""
    init, bags, rows = setup(spark)
    monkeypatch.setattr(TR, "run_step", None)  # no step is a job of its own
    monkeypatch.setattr(TR, "SLICE", 40)
    base = str(tmp_path / "p")
    log = TR.fit(spark, bags.repartition(3), init, base, 2, 4, batch_size=7, lr=0.01, seed=3)
    P, want = dense(init.collect(), rows, bags, 2, 7, 0.01, 0.75, 3)
    assert np.allclose([x for _, x in log], want, rtol=0, atol=1e-9)
    for r in spark.read.parquet(TR.epoch_path(base, 2)).collect():
        w = P["attention"] if r.name == "attention" else P[r.name][r.row]
        assert np.allclose(r.vec, w, rtol=0, atol=1e-9), (r.name, r.row)
