"""Example bags: tiers, sampling, dropping, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from .vocab import membership


def seeded_hash(seed: int, *cols: str) -> Column:
    """Repeatable pseudo-random order key: md5('seed|c1|c2...'), same text in DuckDB."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def context_tiers(ctx: DataFrame, word_counts: DataFrame, path_counts: DataFrame, settings: Settings) -> DataFrame:
    """Full-found (tier 1), partial-found (tier 2), neither (tier 3)."""
    t = membership(ctx, "src", word_counts, "src_in", settings.word_vocab_size, settings)
    t = membership(t, "path", path_counts, "path_in", settings.path_vocab_size, settings)
    t = membership(t, "dst", word_counts, "dst_in", settings.word_vocab_size, settings)
    full = F.col("src_in") & F.col("path_in") & F.col("dst_in")
    partial = F.col("src_in") | F.col("path_in") | F.col("dst_in")
    return t.withColumn("full_found", full).withColumn("partial_found", partial & ~full).withColumn(
        "tier", F.when(full, 1).when(partial, 2).otherwise(3))


def bag_sizes(tiered: DataFrame, settings: Settings) -> DataFrame:
    """Per bag: contexts before sampling ``n``, known ones ``n12`` (tier 1 or 2),
    and kept after sampling ``k`` -- a grouped count with map-side combine,
    so a huge bag never sits in one task."""
    m = settings.max_contexts
    g = tiered.groupBy("role", "ex").agg(F.count(F.lit(1)).alias("n"),
                                         F.sum((F.col("tier") < 3).cast("long")).alias("n12"))
    return g.withColumn("k", F.when(F.col("n") <= m, F.col("n")).otherwise(F.least(F.lit(m), F.col("n12"))))


def sample_contexts(tiered: DataFrame, sizes: DataFrame, settings: Settings) -> DataFrame:
    """bags of at most ``max_contexts`` keep everything in order; larger
    bags keep full-found contexts first and top up with partial-found ones,
    each tier in a seeded random order (contexts with no known part go).

    The large-bag branch is ``row_number() <= max`` over (tier, seeded hash):
    planned as a partial WindowGroupLimit, each map task forwards at most
    ``max`` rows of a bag, so a hot bag is cut down before the shuffle."""
    m = settings.max_contexts
    s = sizes.select("ex", (F.col("n") <= m).alias("small"))
    t = tiered.join(s, "ex")
    small = t.filter("small").drop("small")
    big = t.filter(~F.col("small") & (F.col("tier") < 3)).drop("small")
    w = Window.partitionBy("ex").orderBy("tier", seeded_hash(settings.seed, "ex", "pos"))
    big = big.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= m)
    big = big.withColumn("pos", F.col("rn").cast("int")).drop("rn")
    return small.unionByName(big)


def dataset_stats(sizes: DataFrame) -> DataFrame:
    """Per role, kept and empty examples, context sums, means over kept rows, max bag.

    B5 (drop empty examples) is the ``k = 0`` case here.
    """
    kept = F.col("k") > 0
    s = sizes.groupBy("role").agg(
        F.sum(kept.cast("long")).alias("total"),
        F.sum((~kept).cast("long")).alias("empty"),
        F.sum("n").cast("long").alias("sum_total"),
        F.sum("k").cast("long").alias("sum_sampled"),
        F.max("n").cast("long").alias("max_unfiltered"),
    )
    return s.withColumns({
        "avg_total": F.try_divide(F.col("sum_total").cast("double"), F.col("total")),
        "avg_sampled": F.try_divide(F.col("sum_sampled").cast("double"), F.col("total")),
    })


def truncate_contexts(ctx: DataFrame, max_contexts: int) -> DataFrame:
    """first ``max_contexts`` contexts by position, no sampling (predict path)."""
    return ctx.filter(F.col("pos") <= max_contexts)


def max_contexts(ctx: DataFrame) -> DataFrame:
    """Largest bag, 0 when there is none."""
    per = ctx.groupBy("ex").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_contexts"))


def collect_example(ctx: DataFrame, ctx_col: Column) -> DataFrame:
    """Contexts of one bag, in position order, as one row.

    Bags are bounded by ``max_contexts`` after sampling; the array is sorted
    by position so the result does not depend on shuffle order.
    """
    g = ctx.groupBy("ex", "target").agg(F.array_sort(F.collect_list(F.struct("pos", ctx_col.alias("c")))).alias("cs"))
    return g.select("ex", "target", F.transform("cs", lambda x: x["c"]).alias("contexts"))
