"""Per-series operators on the events table (FX8): block means, half-weight
moving average, running progress (D14, D15, D20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ranking import affine_scan, number_within_skew_safe
from ..sources.tables import table
from .registry import register

BLOCK = 5
TIE = 1e-9  # halves of cents end in exact ties at the last digit shown: all go up
NUMBERED_SQL = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"


def _numbered(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    return number_within_skew_safe(e, ["user_id"], [F.col("ts"), F.col("event_id")], "rn")


@register("block_mean", f"""
SELECT user_id, cast((rn - 1) // {BLOCK} AS bigint) AS block, round(avg(value), 6) AS mean_value,
       cast(count(*) AS bigint) AS n FROM ({NUMBERED_SQL}) GROUP BY user_id, (rn - 1) // {BLOCK}
""")
def q_block_mean(spark, sf_dir):
    """Mean of the value per block of 5 consecutive events of a user."""
    n = _numbered(spark, sf_dir)
    return n.groupBy("user_id", F.floor((F.col("rn") - 1) / BLOCK).cast("long").alias("block")).agg(
        F.round(F.avg("value"), 6).alias("mean_value"), F.count(F.lit(1)).alias("n"))


@register("ema_half", f"""
SELECT user_id, round(sum(value * CASE WHEN rn = 1 THEN pow(0.5, n - 1) ELSE pow(0.5, n - rn + 1) END), 6) AS ema
FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ({NUMBERED_SQL})) GROUP BY user_id
""")
def q_ema_half(spark, sf_dir):
    """V <- 0.5 new + 0.5 old from the first value, in closed form
    (weight 0.5^(n-i+1), the first value 0.5^(n-1)) so it is a plain sum."""
    n = _numbered(spark, sf_dir)
    cnt = n.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    j = n.join(cnt, "user_id")
    w = F.when(F.col("rn") == 1, F.pow(F.lit(0.5), F.col("n") - 1)).otherwise(F.pow(F.lit(0.5), F.col("n") - F.col("rn") + 1))
    return j.groupBy("user_id").agg(F.round(F.sum(F.col("value") * w), 6).alias("ema"))


@register("running_progress", f"""
SELECT event_id, user_id, cast(rn AS bigint) AS n_so_far,
       round(rn / CASE WHEN el > 0 THEN el ELSE 1 END, 6) AS rate
FROM (SELECT *, epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id) AS el FROM ({NUMBERED_SQL}))
""")
def q_running_progress(spark, sf_dir):
    """Events seen so far per user and the rate since the user's first event."""
    n = _numbered(spark, sf_dir)
    first = n.groupBy("user_id").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t0"))
    j = n.join(first, "user_id")
    el = (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("t0")) / 1e6
    return j.select("event_id", "user_id", F.col("rn").alias("n_so_far"),
                    F.round(F.col("rn") / F.when(el > 0, el).otherwise(F.lit(1.0)), 6).alias("rate"))


@register("ema_running", f"""
SELECT event_id, user_id, round(ema + {TIE}, 6) AS ema, round(ema * (n - rn) + {TIE}, 6) AS remaining
FROM (SELECT event_id, user_id, rn, count(*) OVER (PARTITION BY user_id) AS n,
        list_reduce(list(cast(value AS double)) OVER (PARTITION BY user_id ORDER BY rn), lambda v, x: 0.5 * v + 0.5 * x) AS ema
      FROM ({NUMBERED_SQL}))
""")
def q_ema_running(spark, sf_dir):
    """The moving average after every event (one affine scan over all users, so a hot
    user is no task of its own) and what remains: average step times the user's events to come."""
    n = _numbered(spark, sf_dir)
    first = F.col("rn") == 1
    a, b = F.when(first, 0.0).otherwise(0.5), F.when(first, F.col("value")).otherwise(F.col("value") * 0.5)
    e = affine_scan(n.select("event_id", "user_id", "rn", "value"), ["user_id", "rn"], a, b, "ema")
    cnt = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return e.join(cnt, "user_id").select("event_id", "user_id", F.round(F.col("ema") + TIE, 6).alias("ema"),
                                         F.round(F.col("ema") * (F.col("n") - F.col("rn")) + TIE, 6).alias("remaining"))
