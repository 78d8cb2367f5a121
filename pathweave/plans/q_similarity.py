"""Word-vector queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import similarity as SIM
from ..sources.lines import scratch_path
from ..sources.tables import table
from .registry import register

TOPN = 5


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("vec_id").alias("idx"),
                    F.transform("embedding", lambda v: v.cast("double")).alias("vec"))


def _firsts(spark, sf_dir, n):
    e = table(spark, sf_dir, "embeddings", "vec_id", "label")
    w = Window.partitionBy("label").orderBy("vec_id")
    return e.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).select(
        F.col("label").cast("long").alias("qid"), F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), "r")


def _sim_sql(spec: str) -> str:
    unit = "list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"
    return f"""
WITH v AS (SELECT 'w' || vec_id AS word, list_transform(embedding, lambda x: x::double) AS vec FROM embeddings),
spec AS ({spec}),
uw AS (SELECT s.qid, s.word, s.weight, {unit.format(v='v.vec')} AS u FROM spec s JOIN v ON s.word = v.word),
m AS (SELECT qid, i, avg(weight * u[i]) AS x FROM uw, range(1, len(u) + 1) r(i) GROUP BY qid, i),
q AS (SELECT qid, list(x ORDER BY i) AS mv FROM m GROUP BY qid),
q2 AS (SELECT qid, {unit.format(v='mv')} AS qv FROM q),
sims AS (SELECT q2.qid, v.word, list_dot_product(q2.qv, {unit.format(v='v.vec')}) AS s FROM q2 CROSS JOIN v
         WHERE NOT EXISTS (SELECT 1 FROM spec x WHERE x.qid = q2.qid AND x.word = v.word))
SELECT qid, cast(rank AS int) AS rank, word, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, word) AS rank FROM sims) WHERE rank <= {TOPN}
"""


MOST_SIMILAR_SPEC = """
SELECT cast(label AS bigint) AS qid, 'w' || cast(min(vec_id) AS varchar) AS word, 1.0 AS weight FROM embeddings GROUP BY label
"""
ANALOGY_SPEC = """
SELECT cast(label AS bigint) AS qid, 'w' || cast(vec_id AS varchar) AS word, CASE WHEN r = 3 THEN -1.0 ELSE 1.0 END AS weight
FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 3
"""


def _run(spark, sf_dir, spec):
    v = _vectors(spark, sf_dir)
    q = SIM.combine_queries(v, spec)
    out = SIM.nearest(spark, v, q, TOPN)
    return out.select("qid", F.col("rank").cast("int"), "word", F.round("similarity", 6).alias("similarity"))


@register("most_similar", _sim_sql(MOST_SIMILAR_SPEC))
def q_most_similar(spark, sf_dir):
    """For the first word of every label, the five nearest words by cosine."""
    spec = _firsts(spark, sf_dir, 1).select("qid", "word", F.lit(1.0).alias("weight"))
    return _run(spark, sf_dir, spec)


@register("analogy", _sim_sql(ANALOGY_SPEC))
def q_analogy(spark, sf_dir):
    """I16: positive = first two words of a label, negative = its third."""
    spec = _firsts(spark, sf_dir, 3).select("qid", "word", F.when(F.col("r") == 3, -1.0).otherwise(1.0).alias("weight"))
    return _run(spark, sf_dir, spec)


W2V_SQL = """
SELECT 0 AS line_no, cast(count(*) AS varchar) || ' 64' AS text FROM embeddings
UNION ALL SELECT row_number() OVER (ORDER BY vec_id), 'w' || cast(vec_id AS varchar) || ' ' ||
  array_to_string(list_transform(embedding, lambda v: printf('%.6f', v::double)), ' ') FROM embeddings
"""


@register("export_word2vec", W2V_SQL)
def q_export_word2vec(spark, sf_dir):
    """`V D` header, then one `word f1 ... fD` line per row in index order."""
    return SIM.word2vec_lines(_vectors(spark, sf_dir), 64).select(F.col("line_no").cast("bigint"), "text")


@register("import_word2vec", """
SELECT 'w' || cast(vec_id AS varchar) AS word, cast(i AS int) AS d, round(embedding[i + 1]::double, 6) AS v
FROM embeddings, range(64) r(i)
""")
def q_import_word2vec(spark, sf_dir):
    """The exported text read back into (word, vector)."""
    out = scratch_path(spark, "w2v")
    SIM.word2vec_lines(_vectors(spark, sf_dir), 64).select("text").write.mode("overwrite").text(out)
    back = SIM.read_word2vec(spark.read.text(out))
    return back.select("word", F.posexplode("vec").alias("d", "v")).select(
        "word", F.col("d").cast("int"), F.round("v", 6).alias("v"))
