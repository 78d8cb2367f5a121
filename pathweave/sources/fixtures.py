"""Input fixtures derived from the given tables (see FIXTURES.md).

Every fixture is a plain DataFrame over the test tables, so its size grows
with the tables. The DuckDB form of each fixture lives in
``pathweave.plans.oracle_fixtures``.

Join order of ``fx_ctx`` is chosen for scale: lineitem meets part on the
part key and orders meet customer on the customer key, then both sides meet
on the order key; the numbering window that follows is clustered on the same
order key, so it reuses that shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table


def _split_part(c: Column, sep: str, n: int) -> Column:
    return F.split_part(c, F.lit(sep), F.lit(n))


def fx_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX1: one example per order, one context per line item."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
               "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax",
               "l_returnflag", "l_linestatus")
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    lp = li.join(part, li.l_partkey == part.p_partkey)
    oc = orders.join(cust, orders.o_custkey == cust.c_custkey)
    j = lp.join(oc, lp.l_orderkey == oc.o_orderkey)
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
        "l_quantity", "l_discount", "l_tax")
    return j.select(
        F.col("l_orderkey").alias("ex"),
        F.row_number().over(w).cast("int").alias("pos"),
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("grp"),
        F.concat(
            F.replace(F.lower(F.substr("o_orderpriority", F.lit(3))), F.lit(" "), F.lit("|")),
            F.lit("|"), F.lower("c_mktsegment")).alias("target"),
        _split_part(F.col("p_name"), " ", 1).alias("src"),
        F.concat("p_type", F.lit("^"), "l_returnflag", F.lit("_"), "l_linestatus").alias("path"),
        _split_part(F.col("p_name"), " ", 2).alias("dst"),
    )


def role_of_group(grp: Column, seed: int = 42) -> Column:
    """Whole groups go to one role, by the first hex digit of md5(seed|group)."""
    h = F.substr(F.md5(F.concat(F.lit(f"{seed}|"), grp)), F.lit(1), F.lit(1))
    return (F.when(h.isin("0", "1"), "val")
            .when(h.isin("2", "3"), "test")
            .otherwise("train"))


def fx_split(spark: SparkSession, sf_dir: str, ctx: DataFrame | None = None) -> DataFrame:
    """FX1S: role per example, decided by its group."""
    ctx = ctx if ctx is not None else fx_ctx(spark, sf_dir)
    d = ctx.select("ex", "grp").distinct()
    return d.select("ex", "grp", role_of_group(F.col("grp")).alias("role"))


def fx_ctx_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_ctx with its role attached (the role is a function of grp, no join needed)."""
    ctx = fx_ctx(spark, sf_dir)
    return ctx.withColumn("role", role_of_group(F.col("grp")))


def fx_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX2: words of documents, (doc_id, line_no, pos, w)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    words = lines.select(
        "doc_id", (F.col("n") + 1).cast("int").alias("line_no"),
        F.posexplode(F.split("line", " ", -1)).alias("p", "w"))
    return words.select(
        "doc_id", "line_no", (F.col("p") + 1).cast("int").alias("pos"),
        F.replace("w", F.lit(","), F.lit("")).alias("w"),
    ).filter(F.col("w") != "")


def fx_nodes(spark: SparkSession, sf_dir: str, ctx: DataFrame | None = None) -> DataFrame:
    """FX3: one tree per order as an adjacency table.

    (tree_id, node_id, parent_id, child_idx, kind, token); document order is
    the order of node_id.
    """
    ctx = ctx if ctx is not None else fx_ctx(spark, sf_dir)
    null_s = F.lit(None).cast("string")
    # the number of digits before the number: ids of any position sort in document order
    digits = F.col("pos").cast("string")
    line_id = F.concat(F.lit("r/"), F.lpad(F.length(digits).cast("string"), 2, "0"), digits)
    # one pass over fx_ctx: the first context of a tree also yields its root, the first of each
    # target a name (the window is dealt by ex, as fx_ctx is)
    w = Window.partitionBy("ex").orderBy("target", "pos")
    first = F.row_number().over(w) == 1
    named = first | ~F.lag("target").over(w).eqNullSafe(F.col("target"))

    def node(node_id, parent_id, child_idx, kind, token):
        return F.struct(node_id.alias("node_id"), parent_id.alias("parent_id"),
                        child_idx.cast("int").alias("child_idx"), F.lit(kind).alias("kind"),
                        token.cast("string").alias("token"))

    part_id = F.concat(line_id, F.lit("/2"))
    kids = F.array(
        F.when(F.col("_first"), node(F.lit("r"), null_s, F.lit(0), "Order", null_s)),
        F.when(F.col("_named"), node(F.lit("r/00"), F.lit("r"), F.lit(0), "NameExpr", F.col("target"))),
        node(line_id, F.lit("r"), F.col("pos"), "Line", null_s),
        node(F.concat(line_id, F.lit("/0")), line_id, F.lit(0), "Flag",
             _split_part(_split_part(F.col("path"), "^", 2), "_", 1)),
        node(F.concat(line_id, F.lit("/1")), line_id, F.lit(1), "Status", _split_part(F.col("path"), "_", 2)),
        node(part_id, line_id, F.lit(2), "Part", null_s),
        node(F.concat(part_id, F.lit("/0")), part_id, F.lit(0), "Word", F.col("src")),
        node(F.concat(part_id, F.lit("/1")), part_id, F.lit(1), "Word", F.col("dst")),
    )
    marked = ctx.withColumns({"_first": first, "_named": named})
    n = marked.select(F.col("ex").alias("tree_id"), F.explode(kids).alias("n")).filter(F.col("n").isNotNull())
    return n.select("tree_id", *[F.col(f"n.{c}").alias(c) for c in ("node_id", "parent_id", "child_idx", "kind", "token")])


def fx_preds(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    """FX4: ten ranked suggestions per part, without a model.

    Rank 3 is the OOV word, rank 5 an illegal name; the rest are names of
    other parts picked by a key formula (equi-join, no cross join). ``p``
    may be a slice of the part table (a micro-batch of a stream). The part
    table grows with the input, so its file size must not make it a broadcast
    that the driver builds: both sides are shuffled.
    """
    p = p if p is not None else table(spark, sf_dir, "part", "p_partkey", "p_name")
    q = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").select(
        F.col("p_partkey").alias("q_partkey"), F.col("p_name").alias("q_name"), F.col("p_brand").alias("q_brand"))
    n = table(spark, sf_dir, "part", "p_partkey").agg(F.count(F.lit(1))).scalar()
    ranked = p.select("p_partkey", "p_name", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("i"))
    ranked = ranked.withColumn("qk", (F.col("p_partkey") * F.col("i") * 7 + F.col("i") * 37) % n)
    j = ranked.join(q.hint("merge"), ranked.qk == q.q_partkey)
    return j.select(
        F.col("p_partkey").alias("ex"),
        F.replace("p_name", F.lit(" "), F.lit("|")).alias("original"),
        F.col("i").cast("int").alias("rank"),
        F.when(F.col("i") == 3, F.lit("<PAD_OR_OOV>"))
        .when(F.col("i") == 5, F.lower("q_brand"))
        .otherwise(F.replace("q_name", F.lit(" "), F.lit("|"))).alias("word"),
        (F.lit(1.0) / (F.col("i") + 1)).cast("double").alias("score"),
    )


def param_value(idx: Column, d: Column, salt: int) -> Column:
    """FX5 formula for a model parameter: ((idx*31 + d*17 + salt*13) % 97) / 97 - 0.5."""
    return (((idx * 31 + d * 17 + F.lit(salt * 13)) % 97).cast("double") / 97.0) - 0.5


def fx_idents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6: distinct identifier-like strings from the tables (names, codes, document words)."""
    parts = [
        table(spark, sf_dir, "part", "p_name").select(F.col("p_name").alias("x")),
        table(spark, sf_dir, "customer", "c_name").select(F.col("c_name").alias("x")),
        table(spark, sf_dir, "orders", "o_orderpriority").select(F.col("o_orderpriority").alias("x")),
        table(spark, sf_dir, "events", "event_type").select(F.col("event_type").alias("x")),
        fx_words(spark, sf_dir).select(F.col("w").alias("x")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
