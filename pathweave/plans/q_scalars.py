"""Scalar function queries (H1-H28) over identifiers and texts from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..sources import fixtures as fx
from ..sources.tables import table
from . import sqlfn as S
from .oracle_fixtures import with_fx
from .registry import register


@register("normalize_name", with_fx(f"SELECT x, {S.h1('x')} AS y FROM fx_idents", "fx_idents"))
def q_normalize_name(spark, sf_dir):
    """H1."""
    return fx.fx_idents(spark, sf_dir).select("x", N.normalize_name("x").alias("y"))


@register("split_subtokens", with_fx(
    f"SELECT x, array_to_string(a, '|') AS y, cast(len(a) AS int) AS n FROM (SELECT x, {S.h2('x')} AS a FROM fx_idents)",
    "fx_idents"))
def q_split_subtokens(spark, sf_dir):
    """H2."""
    d = fx.fx_idents(spark, sf_dir).select("x", N.split_subtokens("x").alias("a"))
    return d.select("x", F.array_join("a", "|").alias("y"), F.size("a").alias("n"))


@register("normalize_name_cs", with_fx(f"SELECT x, {S.h3('x')} AS y FROM fx_idents", "fx_idents"))
def q_normalize_name_cs(spark, sf_dir):
    """H3."""
    return fx.fx_idents(spark, sf_dir).select("x", N.normalize_name_cs("x").alias("y"))


@register("split_subtokens_cs", with_fx(
    f"SELECT x, array_to_string(a, '|') AS y, cast(len(a) AS int) AS n FROM (SELECT x, {S.h4('x')} AS a FROM fx_idents)",
    "fx_idents"))
def q_split_subtokens_cs(spark, sf_dir):
    """H4."""
    d = fx.fx_idents(spark, sf_dir).select("x", N.split_subtokens_cs("x").alias("a"))
    return d.select("x", F.array_join("a", "|").alias("y"), F.size("a").alias("n"))


@register("split_name_unless_empty", with_fx(f"SELECT x, {S.h5('x')} AS y FROM fx_idents", "fx_idents"))
def q_split_name_unless_empty(spark, sf_dir):
    """H5."""
    return fx.fx_idents(spark, sf_dir).select("x", N.split_name_unless_empty("x").alias("y"))


@register("normalize_word", with_fx(f"SELECT x, {S.h6('x')} AS y FROM fx_idents", "fx_idents"))
def q_normalize_word(spark, sf_dir):
    """H6."""
    return fx.fx_idents(spark, sf_dir).select("x", N.normalize_word("x").alias("y"))


@register("get_subtokens", with_fx("""
SELECT target, cast(len(string_split(target, '|')) AS int) AS n, string_split(target, '|')[1] AS first
FROM (SELECT DISTINCT target FROM fx_ctx)
""", "fx_ctx"))
def q_get_subtokens(spark, sf_dir):
    """H7 on the example targets."""
    t = fx.fx_ctx(spark, sf_dir).select("target").distinct().withColumn("a", N.get_subtokens("target"))
    return t.select("target", F.size("a").alias("n"), F.col("a")[0].alias("first"))


@register("java_string_hash", with_fx(f"SELECT path, {S.h8('path')} AS h FROM (SELECT DISTINCT path FROM fx_ctx)",
                                      "fx_ctx"))
def q_java_string_hash(spark, sf_dir):
    """H8 on the distinct paths."""
    return fx.fx_ctx(spark, sf_dir).select("path").distinct().select("path", N.java_string_hash("path").alias("h"))


@register("maybe_hash_path", with_fx(
    f"SELECT path, cast({S.h8('path')} AS varchar) AS hashed, path AS readable FROM (SELECT DISTINCT path FROM fx_ctx)",
    "fx_ctx"))
def q_maybe_hash_path(spark, sf_dir):
    """H9: hashed (default) and readable forms."""
    p = fx.fx_ctx(spark, sf_dir).select("path").distinct()
    return p.select("path", N.maybe_hash_path("path").alias("hashed"),
                    N.maybe_hash_path("path", no_hash=True).alias("readable"))


@register("saturate_child_id", with_fx("""
SELECT tree_id, node_id, child_idx, cast(least(child_idx, 3) AS int) AS cs_id, child_idx AS java_id FROM fx_nodes
""", "fx_nodes"))
def q_saturate_child_id(spark, sf_dir):
    """C# cap 3, Java unbounded by default."""
    n = fx.fx_nodes(spark, sf_dir)
    return n.select("tree_id", "node_id", "child_idx", N.saturate_child_id("child_idx", 3).cast("int").alias("cs_id"),
                    N.saturate_child_id("child_idx", None).alias("java_id"))


@register("fold_numeric", with_fx("""
SELECT x, CASE WHEN regexp_matches(x, '^[0-9]+$') AND x NOT IN ('0', '1', '32', '64') THEN '<NUM>' ELSE x END AS y
FROM fx_idents
""", "fx_idents"))
def q_fold_numeric(spark, sf_dir):
    """H13 (Java keep list)."""
    return fx.fx_idents(spark, sf_dir).select("x", N.fold_numeric("x").alias("y"))


@register("truncate_label", with_fx("SELECT x, substr(x, 1, 50) AS y FROM fx_idents", "fx_idents"))
def q_truncate_label(spark, sf_dir):
    """H14."""
    return fx.fx_idents(spark, sf_dir).select("x", N.truncate_label("x").alias("y"))


@register("code_length", f"SELECT doc_id, {S.h17('text')} AS n_lines FROM documents")
def q_code_length(spark, sf_dir):
    """H17 on document bodies."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", N.code_length("text").alias("n_lines"))


@register("node_type_label", with_fx("""
SELECT tree_id, node_id, CASE WHEN kind = 'Status' AND token IS NOT NULL AND length(token) > 0
  THEN kind || ':' || token ELSE kind END AS label FROM fx_nodes
""", "fx_nodes"))
def q_node_type_label(spark, sf_dir):
    """Status nodes carry their value as operator in the tree fixture."""
    n = fx.fx_nodes(spark, sf_dir)
    op = F.when(F.col("kind") == "Status", F.col("token"))
    return n.select("tree_id", "node_id", N.node_type_label("kind", op).alias("label"))


@register("url_encode_name", with_fx("""
SELECT x, replace(replace(replace(url_encode(x), '%20', '+'), '~', '%7E'), '%2A', '*') AS y FROM fx_idents
""", "fx_idents"))
def q_url_encode_name(spark, sf_dir):
    """H25 (Java URL encoding: blank -> '+', '~' encoded, '*' kept)."""
    return fx.fx_idents(spark, sf_dir).select("x", N.url_encode_name("x").alias("y"))


@register("decode_utf8", "SELECT doc_id, cast(length(text) AS int) AS n FROM documents")
def q_decode_utf8(spark, sf_dir):
    """Bytes -> string round trip keeps every character."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.length(F.decode(F.encode("text", "UTF-8"), "UTF-8")).alias("n"))


@register("timestamp_label", "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S: ') AS label FROM events")
def q_timestamp_label(spark, sf_dir):
    """H22 over event times."""
    e = table(spark, sf_dir, "events", "event_id", "ts")
    return e.select("event_id", F.concat(F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit(": ")).alias("label"))


HMS_SQL = """
SELECT user_id, secs, cast(secs // 3600 AS varchar) || 'H:' || cast((secs // 60) % 60 AS varchar) || 'M:'
       || cast(secs % 60 AS varchar) || 'S' AS hms
FROM (SELECT user_id, cast(floor(epoch(max(ts))) AS bigint) - cast(floor(epoch(min(ts))) AS bigint) AS secs FROM events GROUP BY user_id)
"""


@register("hms_format", HMS_SQL)
def q_hms_format(spark, sf_dir):
    """Elapsed seconds per user as H:M:S text."""
    e = table(spark, sf_dir, "events", "user_id", "ts")
    g = e.groupBy("user_id").agg(
        (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).cast("long").alias("secs"))
    s = F.col("secs")
    return g.select("user_id", "secs", F.format_string("%dH:%dM:%dS", F.floor(s / 3600), F.floor(s / 60) % 60,
                                                      s % 60).alias("hms"))


@register("divide_no_nan", """
SELECT event_type, coalesce(sum(value) / nullif(cast(sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS double), 0), 0)
       AS mean_positive FROM events GROUP BY event_type
""")
def q_divide_no_nan(spark, sf_dir):
    """0 on a zero denominator."""
    e = table(spark, sf_dir, "events", "event_type", "value")
    g = e.groupBy("event_type").agg(F.sum("value").alias("s"),
                                    F.sum((F.col("value") > 0).cast("int")).cast("double").alias("d"))
    return g.select("event_type", F.coalesce(F.try_divide("s", "d"), F.lit(0.0)).alias("mean_positive"))


@register("steps_per_epoch", with_fx("""
SELECT role, n, cast(ceil(n / 1024.0) AS bigint) AS steps FROM (SELECT role, count(*) AS n FROM fx_split GROUP BY role)
""", "fx_split"))
def q_steps_per_epoch(spark, sf_dir):
    """ceil(examples / batch) per role."""
    s = fx.fx_split(spark, sf_dir).groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    return s.select("role", "n", F.ceil(F.col("n") / F.lit(1024.0)).cast("long").alias("steps"))
