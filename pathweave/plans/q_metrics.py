"""Metric queries over ranked suggestions (fx_preds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import fixtures as fx
from . import sqlfn as S
from .oracle_fixtures import with_fx
from .registry import register

K = 10

MATCHES_SQL = f"""
SELECT e.ex, e.original, m.match_rank, m.match_word
FROM (SELECT DISTINCT ex, original FROM fx_preds) e JOIN (
  SELECT ex, min(legal_rank) AS match_rank, min_by(word, legal_rank) AS match_word
  FROM legal WHERE {S.h6('word')} = {S.h6('original')} GROUP BY ex) m ON e.ex = m.ex
"""

PRF_SQL = """
SELECT n, tp, fp, fn, precision, recall,
  CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
FROM (SELECT n, tp, fp, fn, tp / nullif(cast(tp + fp AS double), 0) AS precision,
             tp / nullif(cast(tp + fn AS double), 0) AS recall
      FROM (SELECT count(*) AS n, cast(sum(tp) AS bigint) AS tp, cast(sum(fp) AS bigint) AS fp,
                   cast(sum(fn) AS bigint) AS fn FROM conf))
"""

PRF_NONAN_SQL = """
SELECT n, tp, fp, fn, precision, recall,
  coalesce(2 * precision * recall / nullif(precision + recall + 1e-7, 0), 0.0) AS f1
FROM (SELECT n, tp, fp, fn, coalesce(tp / nullif(cast(tp + fp AS double), 0), 0.0) AS precision,
             coalesce(tp / nullif(cast(tp + fn AS double), 0), 0.0) AS recall
      FROM (SELECT count(*) AS n, cast(sum(tp) AS bigint) AS tp, cast(sum(fp) AS bigint) AS fp,
                   cast(sum(fn) AS bigint) AS fn FROM conf_nonan))
"""


def _preds(spark, sf_dir):
    return fx.fx_preds(spark, sf_dir)


@register("legal_names", with_fx("SELECT ex, rank, word, legal_rank FROM legal", "legal"))
def q_legal_names(spark, sf_dir):
    """B14."""
    return M.legal_names(_preds(spark, sf_dir)).select("ex", "rank", "word", "legal_rank")


@register("skip_oov_predictions", with_fx("""
SELECT ex, rank, word, cast(len(string_split(word, '|')) AS int) AS n_subtokens
FROM fx_preds WHERE word <> '<PAD_OR_OOV>'
""", "fx_preds"))
def q_skip_oov(spark, sf_dir):
    """OOV suggestions left out; the rest as subtoken lists."""
    p = _preds(spark, sf_dir).filter(F.col("word") != "<PAD_OR_OOV>")
    return p.select("ex", "rank", "word", F.size(F.split("word", r"\|", -1)).alias("n_subtokens"))


@register("prediction_filter_udf", with_fx("""
SELECT ex, rank, word FROM fx_preds
WHERE word <> '<PAD_OR_OOV>' AND regexp_full_match(word, '^[a-zA-Z|]+$') AND word <> original
""", "fx_preds"))
def q_prediction_filter(spark, sf_dir):
    """K2: user predicates (here: not the original name itself) AND-ed with the default ones."""
    filters = M.default_filters() + [lambda w: w != F.col("original")]
    return _preds(spark, sf_dir).filter(M.legal_mask(F.col("word"), filters)).select("ex", "rank", "word")


@register("first_true", with_fx("""
SELECT ex, rank, (sum(CASE WHEN l THEN 1 ELSE 0 END) OVER (PARTITION BY ex ORDER BY rank
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AND l) AS first_true
FROM (SELECT ex, rank, word <> '<PAD_OR_OOV>' AND regexp_full_match(word, '^[a-zA-Z|]+$') AS l FROM fx_preds)
""", "fx_preds"))
def q_first_true(spark, sf_dir):
    """E4."""
    return M.first_true(_preds(spark, sf_dir))


@register("first_match_rank", with_fx(MATCHES_SQL, "legal"))
def q_first_match_rank(spark, sf_dir):
    """E5."""
    return M.first_match_rank(_preds(spark, sf_dir))


@register("subtoken_confusion", with_fx("SELECT * FROM conf", "conf"))
def q_subtoken_confusion(spark, sf_dir):
    """D6 (strict)."""
    return M.subtoken_confusion(M.first_legal(_preds(spark, sf_dir)))


@register("subtoken_prf", with_fx(PRF_SQL, "conf"))
def q_subtoken_prf(spark, sf_dir):
    """D7."""
    return M.subtoken_prf(M.subtoken_confusion(M.first_legal(_preds(spark, sf_dir))))


@register("subtoken_prf_nonan", with_fx(PRF_NONAN_SQL, "conf_nonan"))
def q_subtoken_prf_nonan(spark, sf_dir):
    """D8."""
    conf = M.subtoken_confusion(M.first_legal(_preds(spark, sf_dir)), strict=False)
    return M.subtoken_prf(conf, strict=False)


@register("subtoken_multiset_ops", with_fx("""
SELECT ex, array_to_string(list_filter(p, lambda x: list_contains(o, x)), '|') AS common,
       array_to_string(list_filter(p, lambda x: NOT list_contains(o, x)), '|') AS pred_only,
       array_to_string(list_filter(o, lambda x: NOT list_contains(p, x)), '|') AS orig_only
FROM (SELECT ex, string_split(original, '|') AS o,
        CASE WHEN prediction IS NULL THEN []::varchar[] ELSE string_split(prediction, '|') END AS p FROM first)
""", "first"))
def q_multiset_ops(spark, sf_dir):
    """G3."""
    return M.multiset_ops(M.first_legal(_preds(spark, sf_dir)))


TOPK_SQL = f"""
SELECT cast(t.k AS int) AS k, cast(count(m.match_rank) FILTER (WHERE m.match_rank < t.k) AS double) / max(c.n) AS acc
FROM range(1, {K + 1}) t(k) CROSS JOIN matches m
CROSS JOIN (SELECT count(DISTINCT ex) AS n FROM fx_preds) c GROUP BY t.k
"""


@register("topk_accuracy", with_fx(TOPK_SQL, "legal", extra=[("matches", MATCHES_SQL)]))
def q_topk_accuracy(spark, sf_dir):
    """D9."""
    preds = _preds(spark, sf_dir)
    return M.topk_accuracy(M.first_match_rank(preds), preds, K)


@register("topk_accuracy_by_index", with_fx(f"""
SELECT cast(t.k AS int) AS k, cast(count(p.r) FILTER (WHERE p.r <= t.k) AS double) / max(c.n) AS acc
FROM range(1, {K + 1}) t(k) CROSS JOIN per p CROSS JOIN (SELECT count(*) AS n FROM per) c GROUP BY t.k
""", "fx_preds", extra=[("per", "SELECT ex, min(CASE WHEN word = original THEN rank END) AS r FROM fx_preds GROUP BY ex")]))
def q_topk_accuracy_by_index(spark, sf_dir):
    """D10."""
    return M.topk_accuracy_by_index(_preds(spark, sf_dir), K)


@register("prediction_log", with_fx("""
SELECT e.ex, CASE WHEN match_rank = 0 THEN 'Original: ' || e.original || ', predicted 1st: ' || match_word
  WHEN match_rank IS NOT NULL THEN chr(9) || chr(9) || ' predicted correctly at rank: ' || cast(match_rank + 1 AS varchar)
  ELSE 'No results for predicting: ' || e.original END AS line
FROM (SELECT DISTINCT ex, original FROM fx_preds) e LEFT JOIN matches m ON e.ex = m.ex
""", "legal", extra=[("matches", MATCHES_SQL)]))
def q_prediction_log(spark, sf_dir):
    """A14."""
    return M.prediction_log(_preds(spark, sf_dir))


@register("eval_summary", with_fx(f"""
SELECT a.top1, a.top5, a.top10, p.precision, p.recall, p.f1, p.n
FROM (SELECT max(CASE WHEN k = 1 THEN acc END) AS top1, max(CASE WHEN k = 5 THEN acc END) AS top5,
             max(CASE WHEN k = 10 THEN acc END) AS top10 FROM ({TOPK_SQL})) a
CROSS JOIN ({PRF_SQL}) p
""", "conf", extra=[("matches", MATCHES_SQL)]))
def q_eval_summary(spark, sf_dir):
    """One record with the curve points and subtoken scores."""
    preds = _preds(spark, sf_dir)
    acc = M.topk_accuracy(M.first_match_rank(preds), preds, K)
    wide = acc.agg(*[F.max(F.when(F.col("k") == i, F.col("acc"))).alias(f"top{i}") for i in (1, 5, 10)])
    prf = M.subtoken_prf(M.subtoken_confusion(M.first_legal(preds)))
    # the subtoken scores are one-row aggregates: attach them as scalar subqueries
    one = prf.select(F.struct("precision", "recall", "f1", "n").alias("p")).scalar()
    return wide.select("*", *[one[c].alias(c) for c in ("precision", "recall", "f1", "n")])


@register("semantics_switch", with_fx(f"""
SELECT 'strict' AS semantics, precision, recall, f1 FROM ({PRF_SQL})
UNION ALL SELECT 'nonan', precision, recall, f1 FROM ({PRF_NONAN_SQL})
""", "conf", "conf_nonan"))
def q_semantics_switch(spark, sf_dir):
    """K5: both metric semantics side by side."""
    preds = _preds(spark, sf_dir)
    first = M.first_legal(preds)
    out = None
    for name, strict in (("strict", True), ("nonan", False)):
        r = M.subtoken_prf(M.subtoken_confusion(first, strict=strict), strict=strict).select(
            F.lit(name).alias("semantics"), "precision", "recall", "f1")
        out = r if out is None else out.unionByName(r)
    return out


@register("metric_udaf", with_fx("""
SELECT ex, avg(score) AS mean_legal_score, cast(count(*) AS bigint) AS n_legal FROM legal GROUP BY ex
""", "legal"))
def q_metric_udaf(spark, sf_dir):
    """K3: a user metric over the legal suggestions, as aggregate expressions."""
    legal = M.legal_names(_preds(spark, sf_dir))
    return legal.groupBy("ex").agg(F.avg("score").alias("mean_legal_score"), F.count(F.lit(1)).alias("n_legal"))
