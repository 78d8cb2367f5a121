"""Training queries (rows-only checks: iterative, seeded, not SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FIXTURE
from ..operators import metrics as M
from ..operators import model as MD
from ..operators import train as TR
from ..operators.pipeline import Build
from ..sources.lines import scratch_path
from .oracle_fixtures import with_fx
from .registry import register

DT, DP = 4, 4
EPOCHS = 2


def _setup(spark, sf_dir):
    b = Build(spark, sf_dir)
    init = TR.init_params(spark, b.token_vocab, b.path_vocab, b.target_vocab, DT, DP, FIXTURE.seed)
    bags = TR.train_bags(b.encoded.filter(F.col("role") == "train"))
    return b, init, bags


SHARDS = 8  # of a mini-batch; the trained model does not depend on it


def _tasks(spark):
    return SHARDS


def _evaluator(spark, b, encoded, role, out):
    """Evaluate the saved epoch on one role and append the metrics row."""

    def on_epoch(epoch, path):
        mp = TR.as_model_params(spark.read.parquet(path), DT, DP)
        enc = encoded.filter(F.col("role") == role)
        codes = MD.code_vectors(MD.context_vectors(enc, mp, FIXTURE), mp)
        preds = MD.predict(codes, MD.score_targets(codes, mp, 10, FIXTURE), b.target_vocab, FIXTURE)
        ev = M.evaluate_predictions(preds, 10)
        ev.select(F.lit(epoch).alias("epoch"), F.get("topk_acc", 0).alias("top1"), "precision", "recall", "f1", "n") \
            .write.mode("append").parquet(out)

    return on_epoch


@register("init_params")
def q_init_params(spark, sf_dir):
    """Initial parameter table (variance scaling, seeded per row)."""
    _, init, _ = _setup(spark, sf_dir)
    return init.select("name", "row", F.size("vec").alias("dim"), F.array_min("vec").alias("lo"),
                       F.array_max("vec").alias("hi"))


@register("param_count", with_fx("""
SELECT name, cast(n AS bigint) AS n_params FROM (
  SELECT 'token' AS name, count(*) * 4 AS n FROM tok_vocab UNION ALL SELECT 'path', count(*) * 4 FROM path_vocab
  UNION ALL SELECT 'target', count(*) * 12 FROM tgt_vocab UNION ALL SELECT 'transform', 144
  UNION ALL SELECT 'attention', 12)
UNION ALL SELECT 'total', cast((SELECT count(*) FROM tok_vocab) * 4 + (SELECT count(*) FROM path_vocab) * 4
  + (SELECT count(*) FROM tgt_vocab) * 12 + 156 AS bigint)
""", "tok_vocab", "path_vocab", "tgt_vocab"))
def q_param_count(spark, sf_dir):
    """Parameters per matrix and in total."""
    _, init, _ = _setup(spark, sf_dir)
    return TR.param_count(init)


@register("dropout")
def q_dropout(spark, sf_dir):
    """Seeded keep-0.75 mask, kept values scaled by 1/0.75 (training only)."""
    b, init, _ = _setup(spark, sf_dir)
    mp = MD.formula_params(b.token_vocab, b.path_vocab, b.target_vocab)
    ctx = MD.context_vectors(b.encoded.filter(F.col("role") == "train"), mp, FIXTURE)
    keep = FIXTURE.dropout_keep
    x = ctx.select("ex", "pos", F.posexplode("x").alias("r", "x"))
    u = TR._uniform(FIXTURE.seed, "dropout", F.col("ex"), F.col("pos"), F.col("r"))
    return x.select("ex", "pos", "r", F.when(u < keep, F.col("x") / keep).otherwise(F.lit(0.0)).alias("x"))


@register("fit")
def q_fit(spark, sf_dir):
    """Two epochs of synchronous mini-batch Adam over sharded parameters; the loss log."""
    _, init, bags = _setup(spark, sf_dir)
    base = scratch_path(spark, "params")
    log = TR.fit(spark, bags, init, base, EPOCHS, _tasks(spark), seed=FIXTURE.seed)
    return spark.createDataFrame(log, "epoch int, loss double")


@register("resume_fit")
def q_resume_fit(spark, sf_dir):
    """One epoch, then resume from the newest saved epoch for one more."""
    _, init, bags = _setup(spark, sf_dir)
    base = scratch_path(spark, "params")
    first = TR.fit(spark, bags, init, base, 1, _tasks(spark), seed=FIXTURE.seed)
    last = TR.latest_epoch(spark, base)
    TR.assert_trainable(spark.read.parquet(TR.epoch_path(base, last)))
    more = TR.fit(spark, bags, None, base, 1, _tasks(spark), start_epoch=last, seed=FIXTURE.seed)
    return spark.createDataFrame(first + more, "epoch int, loss double")


@register("evaluate_every")
def q_evaluate_every(spark, sf_dir):
    """Evaluation on the validation role after every epoch."""
    b, init, _ = _setup(spark, sf_dir)
    base, out, kept = scratch_path(spark, "params"), scratch_path(spark, "evals"), scratch_path(spark, "encoded")
    b.encoded.write.parquet(kept)  # read by the training and by every evaluation
    encoded = spark.read.schema(b.encoded.schema).parquet(kept)
    bags = TR.train_bags(encoded.filter(F.col("role") == "train"))
    TR.fit(spark, bags, init, base, EPOCHS, _tasks(spark), seed=FIXTURE.seed, on_epoch=_evaluator(spark, b, encoded, "val", out))
    return spark.read.parquet(out)


@register("best_epoch")
def q_best_epoch(spark, sf_dir):
    """The saved epoch with the highest validation F1."""
    ev = q_evaluate_every(spark, sf_dir)
    return ev.agg(F.max_by("epoch", "f1").alias("best_epoch"), F.max("f1").alias("best_f1"))


@register("params_versions", f"SELECT cast(e AS int) AS epoch, cast(r AS int) AS newest_rank FROM (VALUES ({EPOCHS}, 1), ({EPOCHS - 1}, 2)) t(e, r)")
def q_params_versions(spark, sf_dir):
    """Every epoch saved as a partition; the newest two kept, the others deleted."""
    _, init, bags = _setup(spark, sf_dir)
    base = scratch_path(spark, "params")
    TR.fit(spark, bags, init, base, EPOCHS, _tasks(spark), seed=FIXTURE.seed)
    TR.prune_epochs(spark, base, keep=2)
    return TR.retained_epochs(spark, base, keep=EPOCHS + 1).select("epoch", F.col("k").cast("int").alias("newest_rank"))


@register("release_params")
def q_release_params(spark, sf_dir):
    """Weights without optimizer state; resuming from it is refused."""
    _, init, _ = _setup(spark, sf_dir)
    rel = TR.release(init)
    try:
        TR.assert_trainable(rel)
        refused = False
    except ValueError:
        refused = True
    return rel.groupBy("name").agg(F.count(F.lit(1)).alias("rows")).withColumn("resume_refused", F.lit(refused))
