"""Model queries: forward pass, scoring, predictions, attention, evaluation,
exports (I1-I9, I13, C8-C11, D11, D12, E6, E7, B16, A13, H27)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import FIXTURE
from ..functions.names import java_string_hash
from ..operators import metrics as M
from ..operators import model as MD
from ..operators.pipeline import Build
from ..sources import fixtures as fx
from ..sources.tables import table
from . import sqlfn as S
from .oracle_fixtures import with_fx
from .registry import register

R = MD.ROUND
K = 10


class Forward:
    """The evaluation path over the test role, shared by the model queries."""

    def __init__(self, spark, sf_dir):
        self.spark, self.b = spark, Build(spark, sf_dir)
        self.params = MD.formula_params(self.b.token_vocab, self.b.path_vocab, self.b.target_vocab)
        self.enc = self.b.encoded.filter(F.col("role") == "test")
        self.ctx = MD.context_vectors(self.enc, self.params, FIXTURE)
        self._codes = None

    @property
    def codes(self):
        if self._codes is None:
            # the code-vector table feeds scoring, decoding and attention: materialise it once
            from ..operators.ranking import reliable_checkpoint

            self._codes = reliable_checkpoint(MD.code_vectors(self.ctx, self.params))
        return self._codes

    def scored(self, k=K):
        return MD.score_targets(self.codes, self.params, k, FIXTURE)

    def preds(self, normalize=False):
        return MD.predict(self.codes, self.scored(), self.b.target_vocab, FIXTURE, normalize)

    def attention(self):
        strings = self.enc.select("ex", "pos", "src", "path", "dst")
        return MD.attention_rows(self.codes, strings)


def mq(sql, *names, extra=None):
    return with_fx(sql, *names, extra=extra)


@register("embedding_lookup", mq(f"""
SELECT e.ex, e.pos, 'src' AS part, cast(t.d AS int) AS d, round(t.v, {R}) AS v FROM enc_test e JOIN tokE t ON e.src_idx = t.idx
UNION ALL SELECT e.ex, e.pos, 'path', cast(p.d AS int), round(p.v, {R}) FROM enc_test e JOIN pathE p ON e.path_idx = p.idx
UNION ALL SELECT e.ex, e.pos, 'dst', cast(t.d AS int), round(t.v, {R}) FROM enc_test e JOIN tokE t ON e.dst_idx = t.idx
""", "enc_test", "tokE", "pathE"))
def q_embedding_lookup(spark, sf_dir):
    """The three vectors of every valid test context (src and dst share the token table)."""
    f = Forward(spark, sf_dir)
    dims = 4
    x = f.ctx.select("ex", "pos", F.posexplode("x").alias("r", "v"))
    part = F.when(F.col("r") < dims, "src").when(F.col("r") < 2 * dims, "path").otherwise("dst")
    return x.select("ex", "pos", part.alias("part"), (F.col("r") % dims).cast("int").alias("d"),
                    F.round("v", R).alias("v"))


@register("concat_embeddings", mq(f"SELECT ex, pos, cast(r AS int) AS r, round(x, {R}) AS x FROM xs", "xs"))
def q_concat_embeddings(spark, sf_dir):
    """[src | path | dst] per context."""
    x = Forward(spark, sf_dir).ctx.select("ex", "pos", F.posexplode("x").alias("r", "x"))
    return x.select("ex", "pos", F.col("r").cast("int"), F.round("x", R).alias("x"))


@register("transform_tanh", mq(f"SELECT ex, pos, cast(c AS int) AS c, round(h, {R}) AS h FROM hs", "hs"))
def q_transform_tanh(spark, sf_dir):
    """tanh(x . W) per context (row-local numpy in mapInPandas)."""
    f = Forward(spark, sf_dir)
    W = f.params.transform

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            if len(pdf) == 0:
                continue
            H = np.tanh(np.vstack(list(pdf["x"])) @ W)
            n = H.shape[1]
            yield pd.DataFrame({"ex": np.repeat(pdf["ex"].to_numpy(), n), "pos": np.repeat(pdf["pos"].to_numpy(), n),
                                "c": np.tile(np.arange(n, dtype=np.int32), len(pdf)), "h": np.round(H.ravel(), R)})

    out = f.ctx.select("ex", "pos", "x").mapInPandas(run, "ex long, pos int, c int, h double")
    return out.select("ex", "pos", "c", F.round("h", R).alias("h"))


@register("attention_scores", mq(f"SELECT ex, pos, round(w, {R}) AS weight FROM ws", "ws"))
def q_attention_scores(spark, sf_dir):
    """I4: softmax of v . a over the valid contexts of each bag."""
    c = Forward(spark, sf_dir).codes
    a = c.select("ex", F.explode(F.arrays_zip("attn_pos", "attn_w")).alias("z"))
    return a.select("ex", F.col("z.attn_pos").alias("pos"), F.round("z.attn_w", R).alias("weight"))


@register("code_vectors", mq(f"SELECT ex, cast(c AS int) AS c, round(v, {R}) AS v FROM code", "code"))
def q_code_vectors(spark, sf_dir):
    """Encoded bag -> code vector (numpy kernel in mapInPandas)."""
    c = Forward(spark, sf_dir).codes
    return c.select("ex", F.posexplode("code").alias("c", "v")).select(
        "ex", F.col("c").cast("int"), F.round("v", R).alias("v"))


@register("attention_pool", mq(f"SELECT ex, cast(c AS int) AS c, round(v, {R}) AS v FROM code", "code"))
def q_attention_pool(spark, sf_dir):
    """D11 in its relational form: long rows, joins on the dimension, a stable
    softmax by window, and a grouped weighted sum -- must equal I5."""
    f = Forward(spark, sf_dir)
    spark_ = spark
    n = f.params.code_dim
    W = spark_.createDataFrame([(int(r), int(c), float(f.params.transform[r, c])) for r in range(n) for c in range(n)],
                               "r int, c int, w double")
    A = spark_.createDataFrame([(int(c), float(f.params.attention[c])) for c in range(n)], "c int, a double")
    x = f.ctx.select("ex", "pos", F.posexplode("x").alias("r", "x"))
    h = x.join(F.broadcast(W), "r").groupBy("ex", "pos", "c").agg(F.tanh(F.sum(F.col("x") * F.col("w"))).alias("h"))
    s = h.join(F.broadcast(A), "c").groupBy("ex", "pos").agg(F.sum(F.col("h") * F.col("a")).alias("s"))
    w = Window.partitionBy("ex")
    e = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    wt = e.withColumn("wt", F.col("e") / F.sum("e").over(w)).select("ex", "pos", "wt")
    code = h.join(wt, ["ex", "pos"]).groupBy("ex", "c").agg(F.sum(F.col("wt") * F.col("h")).alias("v"))
    return code.select("ex", F.col("c").cast("int"), F.round("v", R).alias("v"))


@register("score_all_targets", mq(f"SELECT ex, cast(idx AS int) AS idx, round(score, {R}) AS score FROM scores",
                                  "scores"))
def q_score_all_targets(spark, sf_dir):
    """Every code vector against every target (block products)."""
    s = Forward(spark, sf_dir).scored(k=FIXTURE.target_vocab_size + 1)
    return s.select("ex", "idx", F.round("score", R).alias("score"))


@register("per_example_topk", mq(f"SELECT ex, rank, cast(idx AS int) AS idx, round(score, {R}) AS score FROM topk",
                                 "topk"))
def q_per_example_topk(spark, sf_dir):
    """k = min(10, target vocabulary) best targets per example."""
    s = Forward(spark, sf_dir).scored()
    return s.select("ex", "rank", "idx", F.round("score", R).alias("score"))


@register("predict_names", mq(f"SELECT ex, original, rank, word, round(score, {R}) AS score FROM mpreds", "mpreds"))
def q_predict_names(spark, sf_dir):
    """Decoded top-k suggestions with scores."""
    p = Forward(spark, sf_dir).preds()
    return p.select("ex", "original", "rank", "word", F.round("score", R).alias("score"))


@register("normalize_topk_scores", mq(f"""
SELECT ex, rank, round(e / sum(e) OVER (PARTITION BY ex), {R}) AS score
FROM (SELECT ex, rank, exp(score - max(score) OVER (PARTITION BY ex)) AS e FROM topk)
""", "topk"))
def q_normalize_topk_scores(spark, sf_dir):
    """Softmax over the k scores (predict path)."""
    p = Forward(spark, sf_dir).preds(normalize=True)
    return p.select("ex", "rank", F.round("score", R).alias("score"))


@register("normalize_full_softmax", mq(f"""
SELECT t.ex, t.rank, round(exp(t.score - z.m) / z.z, {R}) AS score FROM topk t
JOIN (SELECT ex, any_value(m) AS m, sum(exp(score - m)) AS z
      FROM (SELECT *, max(score) OVER (PARTITION BY ex) AS m FROM scores) GROUP BY ex) z ON t.ex = z.ex
""", "topk", "scores"))
def q_normalize_full_softmax(spark, sf_dir):
    """I7, second form: softmax over the whole target vocabulary, from the merged block states."""
    p = Forward(spark, sf_dir).preds(normalize="full")
    return p.select("ex", "rank", F.round("score", R).alias("score"))


@register("cross_entropy_loss", mq(f"""
SELECT cast(count(*) AS bigint) AS n, round(avg(lse - own), {R}) AS loss
FROM (SELECT s.ex, max(s.m) + ln(sum(exp(s.score - s.m))) AS lse,
             max(CASE WHEN s.idx = e.target_idx THEN s.score END) AS own
      FROM (SELECT *, max(score) OVER (PARTITION BY ex) AS m FROM scores) s
      JOIN (SELECT DISTINCT ex, target_idx FROM enc_test) e ON s.ex = e.ex GROUP BY s.ex)
""", "scores", "enc_test"))
def q_cross_entropy_loss(spark, sf_dir):
    """Mean softmax cross-entropy of the true target over all targets."""
    s = Forward(spark, sf_dir).scored().filter(F.col("rank") == 1)
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("lse") - F.col("own")), R).alias("loss"))


ATT_SQL = """
SELECT w.ex, w.pos, w.w AS weight, e.src, e.path, e.dst FROM ws w JOIN enc_test e ON w.ex = e.ex AND w.pos = e.pos
"""
PER_CTX_SQL = f"SELECT ex, src, path, dst, max_by(weight, pos) AS weight FROM ({ATT_SQL}) GROUP BY ex, src, path, dst"
TOPATT_SQL = f"""
SELECT *, cast(row_number() OVER (PARTITION BY ex ORDER BY round(weight, 6) DESC, src, path, dst) AS int) AS arank
FROM ({PER_CTX_SQL}) QUALIFY arank <= 5
"""


@register("attention_per_context", mq(f"SELECT ex, src, path, dst, round(weight, {R}) AS weight FROM ({PER_CTX_SQL})",
                                      "ws", "enc_test"))
def q_attention_per_context(spark, sf_dir):
    """I8: triple -> weight, last equal triple wins."""
    per = MD.attention_per_context(Forward(spark, sf_dir).attention())
    return per.select("ex", "src", "path", "dst", F.round("weight", R).alias("weight"))


@register("attention_topk", mq(f"SELECT ex, arank, src, path, dst, round(weight, {R}) AS weight FROM ({TOPATT_SQL})",
                               "ws", "enc_test"))
def q_attention_topk(spark, sf_dir):
    """Five heaviest contexts per example."""
    t = MD.attention_topk(MD.attention_per_context(Forward(spark, sf_dir).attention()), 5)
    return t.select("ex", F.col("arank").cast("int"), "src", "path", "dst", F.round("weight", R).alias("weight"))


UNHASH_SQL = f"SELECT DISTINCT {S.h8('path')} AS h, path FROM fx_ctxr WHERE role = 'train'"


def _unhash(spark, sf_dir):
    """C10 side table: hash -> readable path, from the train contexts."""
    c = fx.fx_ctx_roles(spark, sf_dir).filter(F.col("role") == "train").select("path").distinct()
    return c.select(java_string_hash("path").alias("h"), "path")


@register("unhash_join", mq(f"""
SELECT DISTINCT e.ex, e.pos, u.h, u.path FROM encoded e JOIN ({UNHASH_SQL}) u ON {S.h8('e.path')} = u.h
WHERE e.role = 'test'
""", "encoded", "fx_ctxr"))
def q_unhash_join(spark, sf_dir):
    """Hashed path of each test context back to its readable form."""
    f = Forward(spark, sf_dir)
    hashed = f.enc.select("ex", "pos", java_string_hash("path").alias("h"))
    return hashed.join(_unhash(spark, sf_dir), "h").select("ex", "pos", "h", "path").distinct()


KNOWN_SQL = f"""
SELECT t.ex, t.arank, t.src AS token1, u.path, t.dst AS token2, round(t.weight, {R}) AS score
FROM ({TOPATT_SQL}) t JOIN ({UNHASH_SQL}) u ON {S.h8('t.path')} = u.h
"""


def _known(spark, sf_dir, f):
    t = MD.attention_topk(MD.attention_per_context(f.attention()), 5)
    t = t.withColumn("h", java_string_hash("path")).drop("path")
    return t.join(_unhash(spark, sf_dir), "h").select(
        "ex", F.col("arank").cast("int"), F.col("src").alias("token1"), "path", F.col("dst").alias("token2"),
        F.round("weight", R).alias("score"))


@register("known_paths_only", mq(KNOWN_SQL, "ws", "enc_test", "fx_ctxr"))
def q_known_paths_only(spark, sf_dir):
    """Top attention rows shown only when the hash is in the unhash table (taken after the top-k)."""
    return _known(spark, sf_dir, Forward(spark, sf_dir))


PRESENT_SQL = f"""
SELECT ex, 'name' AS kind, rank, word AS text, round(score, {R}) AS value FROM mpreds WHERE word <> '<PAD_OR_OOV>'
UNION ALL SELECT ex, 'path', arank, token1 || ',' || path || ',' || token2, score FROM ({KNOWN_SQL})
"""


def _present(spark, sf_dir, f):
    names = f.preds().filter(F.col("word") != FIXTURE.target_specials.oov).select(
        "ex", F.lit("name").alias("kind"), "rank", F.col("word").alias("text"), F.round("score", R).alias("value"))
    paths = _known(spark, sf_dir, f).select(
        "ex", F.lit("path").alias("kind"), F.col("arank").alias("rank"),
        F.concat_ws(",", "token1", "path", "token2").alias("text"), F.col("score").alias("value"))
    return names.unionByName(paths)


@register("present_predictions", mq(PRESENT_SQL, "mpreds", "ws", "fx_ctxr"))
def q_present_predictions(spark, sf_dir):
    """Suggestions as subtoken names with probability, and readable top attention paths."""
    return _present(spark, sf_dir, Forward(spark, sf_dir))


@register("raw_with_presentable", mq(f"""
SELECT p.ex, p.original, p.word AS top_word, cast(count(x.ex) FILTER (WHERE x.kind = 'name') AS bigint) AS n_names,
       cast(count(x.ex) FILTER (WHERE x.kind = 'path') AS bigint) AS n_paths
FROM (SELECT * FROM mpreds WHERE rank = 1) p LEFT JOIN ({PRESENT_SQL}) x ON p.ex = x.ex GROUP BY p.ex, p.original, p.word
""", "mpreds", "ws", "fx_ctxr"))
def q_raw_with_presentable(spark, sf_dir):
    """C11: raw and presentable results lined up by example id (not by position)."""
    f = Forward(spark, sf_dir)
    raw = f.preds().filter(F.col("rank") == 1).select("ex", "original", F.col("word").alias("top_word"))
    pres = _present(spark, sf_dir, f).groupBy("ex").agg(
        F.sum((F.col("kind") == "name").cast("long")).alias("n_names"),
        F.sum((F.col("kind") == "path").cast("long")).alias("n_paths"))
    j = raw.join(pres, "ex", "left")
    return j.select("ex", "original", "top_word", F.coalesce("n_names", F.lit(0)).cast("long").alias("n_names"),
                    F.coalesce("n_paths", F.lit(0)).cast("long").alias("n_paths"))


def _fmt_vec(col):
    return F.array_join(F.transform(col, lambda v: F.format_string("%.6f", v)), " ")


@register("export_code_vectors", mq("""
SELECT ex, string_agg(printf('%.6f', v), ' ' ORDER BY c) AS vector FROM code GROUP BY ex
""", "code"))
def q_export_code_vectors(spark, sf_dir):
    """One text vector per evaluated example, keyed by example id."""
    c = Forward(spark, sf_dir).codes
    return c.select("ex", _fmt_vec(F.col("code")).alias("vector"))


@register("format_vector", """
SELECT vec_id, array_to_string(list_transform(embedding, lambda v: printf('%.6f', v::double)), ' ') AS text
FROM embeddings
""")
def q_format_vector(spark, sf_dir):
    """A vector as blank-joined text (6 decimals)."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", _fmt_vec(F.transform("embedding", lambda v: v.cast("double"))).alias("text"))


EVAL_MATCH_SQL = f"""
SELECT ex, min(legal_rank) AS match_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY ex ORDER BY rank) - 1 AS legal_rank FROM mpreds
  WHERE word <> '<PAD_OR_OOV>' AND regexp_full_match(word, '^[a-zA-Z|]+$'))
WHERE {S.h6('word')} = {S.h6('original')} GROUP BY ex
"""
EVAL_CONF_SQL = """
SELECT cast(len(list_filter(p, lambda x: list_contains(o, x))) AS bigint) AS tp,
  cast(len(list_filter(p, lambda x: NOT list_contains(o, x))) AS bigint) AS fp,
  cast(len(list_filter(o, lambda x: NOT list_contains(p, x))) AS bigint) AS fn
FROM (SELECT string_split(e.original, '|') AS o,
        CASE WHEN f.word IS NULL THEN []::varchar[] ELSE string_split(f.word, '|') END AS p
      FROM (SELECT DISTINCT ex, original FROM mpreds) e LEFT JOIN (
        SELECT ex, min_by(word, rank) AS word FROM mpreds
        WHERE word <> '<PAD_OR_OOV>' AND regexp_full_match(word, '^[a-zA-Z|]+$') GROUP BY ex) f ON e.ex = f.ex)
"""


@register("evaluate", mq(f"""
SELECT round(cast(count(m.match_rank) FILTER (WHERE m.match_rank < 1) AS double) / max(c.n), {R}) AS top1,
       round(cast(count(m.match_rank) FILTER (WHERE m.match_rank < 5) AS double) / max(c.n), {R}) AS top5,
       round(cast(count(m.match_rank) FILTER (WHERE m.match_rank < 10) AS double) / max(c.n), {R}) AS top10,
       max(p.precision) AS precision, max(p.recall) AS recall, max(p.f1) AS f1, max(c.n) AS n
FROM (SELECT cast(count(DISTINCT ex) AS bigint) AS n FROM mpreds) c
LEFT JOIN ({EVAL_MATCH_SQL}) m ON TRUE
CROSS JOIN (SELECT round(precision, {R}) AS precision, round(recall, {R}) AS recall,
  round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, {R}) AS f1
  FROM (SELECT sum(tp) / nullif(cast(sum(tp) + sum(fp) AS double), 0) AS precision,
               sum(tp) / nullif(cast(sum(tp) + sum(fn) AS double), 0) AS recall FROM ({EVAL_CONF_SQL}))) p
""", "mpreds"))
def q_evaluate(spark, sf_dir):
    """I13 (flagship): evaluation filter -> forward pass -> top-k -> top-k accuracy and subtoken P/R/F1."""
    preds = Forward(spark, sf_dir).preds()
    ev = M.evaluate_predictions(preds, K)
    return ev.select(*[F.round(F.get("topk_acc", i - 1), R).alias(f"top{i}") for i in (1, 5, 10)],
                     *[F.round(c, R).alias(c) for c in ("precision", "recall", "f1")], "n")
