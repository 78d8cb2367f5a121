"""Streaming queries (J1-J4); each equals its batch counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FIXTURE
from ..functions.names import java_string_hash
from ..operators import metrics as M
from ..operators import model as MD
from ..operators import vocab as V
from ..sources import fixtures as fx
from ..sources import lines as L
from ..sources.tables import table
from ..streaming import streams as ST
from .oracle_fixtures import with_fx
from .q_metrics import PRF_SQL
from .q_model import Forward
from .q_sources import JSON_SQL
from .registry import register


@register("stream_json_maps", JSON_SQL)
def q_stream_json_maps(spark, sf_dir):
    """Events as a stream, JSON maps flattened to (element, scope) pairs."""
    ev = ST.table_stream(spark, sf_dir, "events", "event_id", "props")
    pairs = ev.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("element", "scope"))
    return spark.read.parquet(ST.run_to_parquet(pairs, "json-maps"))


@register("stream_histograms", with_fx("SELECT word, cast(cnt AS bigint) AS cnt FROM tok_hist", "tok_hist"))
def q_stream_histograms(spark, sf_dir):
    """Train token histogram maintained by a streaming aggregation
    (line items stream; part, orders and customers are static join sides)."""
    li = ST.table_stream(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part", "p_partkey", "p_name")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    j = li.join(part, li.l_partkey == part.p_partkey).join(orders, li.l_orderkey == orders.o_orderkey)
    grp = F.concat(F.lit("cust"), F.col("o_custkey").cast("string"))
    train = j.filter(fx.role_of_group(grp) == "train")
    words = train.select(F.explode(F.array(F.split_part("p_name", F.lit(" "), F.lit(1)),
                                           F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    return spark.read.parquet(ST.run_foreach_batch(counts, "hist", ST.overwrite_sink, mode="complete"))


@register("stream_metrics", with_fx(PRF_SQL, "conf"))
def q_stream_metrics(spark, sf_dir):
    """TP / FP / FN accumulated over micro-batches (one row per batch in the
    sink, reset = a new sink), then P / R / F1 -- equal to the batch D7."""
    parts = ST.table_stream(spark, sf_dir, "part", "p_partkey", "p_name")

    def per_batch(batch, epoch, out):
        conf = M.subtoken_confusion(M.first_legal(fx.fx_preds(spark, sf_dir, p=batch)))
        sums = conf.agg(F.count(F.lit(1)).alias("n"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
        ST.batch_sink(sums, epoch, out)

    acc = spark.read.parquet(ST.run_foreach_batch(parts, "metrics", per_batch))
    totals = acc.agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    # reuse the batch formula on the accumulated counts
    rows = totals.select(F.lit(1).alias("ex"), "tp", "fp", "fn", "n")
    out = M.subtoken_prf(rows.drop("n")).drop("n")
    return out.select(totals.select("n").scalar().cast("long").alias("n"), "tp", "fp", "fn", "precision", "recall", "f1")


PREDS_SQL = "SELECT ex, original, rank, word, round(score, 6) AS score FROM mpreds"


@register("stream_predict", with_fx(PREDS_SQL, "mpreds"))
def q_stream_predict(spark, sf_dir):
    """Example lines arriving in an inbox folder are parsed, encoded against
    the static vocabularies (paths by their hash), scored and decoded in each
    micro-batch; the result equals the batch prediction."""
    f = Forward(spark, sf_dir)
    b = f.b
    inbox = L.scratch_path(spark, "inbox")
    L.emit_example_lines(b.sampled.filter(F.col("role") == "test")).write.mode("overwrite").parquet(inbox)
    hashed_paths = b.path_vocab.select(
        F.when(F.col("idx") < FIXTURE.path_specials.n, F.col("word"))
        .otherwise(java_string_hash("word").cast("string")).alias("word"), "idx")
    lines = spark.readStream.schema("ex long, line string").parquet(inbox)

    def per_batch(batch, epoch, out):
        enc = MD.encode_lines(batch, b.token_vocab, hashed_paths, b.target_vocab, FIXTURE)
        codes = MD.code_vectors(MD.context_vectors(enc, f.params, FIXTURE), f.params)
        scored = MD.score_targets(codes, f.params, 10, FIXTURE)
        ST.batch_sink(MD.predict(codes, scored, b.target_vocab, FIXTURE), epoch, out)

    res = spark.read.parquet(ST.run_foreach_batch(lines, "predict", per_batch))
    return res.select("ex", "original", "rank", "word", F.round("score", 6).alias("score"))
