"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source has a target number of words (weights, water-filled under a cap of
``max_repeats`` times its size). The mix consists of blocks of ``block`` words.
Blocks go to sources by the highest quotients target / (2 s + 1), s the blocks a
source has; a source's blocks go to its shards by the same rule with the shard
sizes as votes. A shard is a set of documents in seeded order laid end to end on
a circle; its blocks are the run of quota * block words from a seeded start, so a
quota beyond the circle repeats it, at most ``max_repeats`` times.

The highest-quotient rule is computed in closed form: seats are the votes
divided by a common divisor and rounded to the nearest integer; the divisor is
found by bisection and the last seats go by quotient, so the number of blocks
does not matter. The only thing one task holds is a row per shard; shards per
source grow with the square root of its documents, so a hot source is cut into
many shards and no shard grows faster than that root either.

Null text has size 0; a null source is a source of its own (last); empty sources
have target 0; an empty table gives an empty mix. Equal rows are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import side, stage

WEIGHTS, SHARE, REPEATS, BLOCK, SEED = (3.0, 1.0, 2.0), 1.5, 2, 16, 20240607
SIZE = r"[^\x20\x09-\x0D]+"


def water_fill(weights: np.ndarray, sizes: np.ndarray, total: float, repeats: float) -> np.ndarray:
    """Targets in proportion to the weights, none above repeats * size; the excess is reshared."""
    target, active, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), float(total)
    caps = repeats * sizes.astype(float)
    while active.any():
        share = np.where(active, left * weights / weights[active].sum(), 0.0)
        over = active & (share > caps)
        if not over.any():
            target[active] = share[active]
            break
        target[over] = caps[over]
        left -= caps[over].sum()
        active &= ~over
    return target


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients votes / (2 s + 1), at most caps each; ties go
    to the earlier entry. Gives out all seats that the caps allow."""
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    seats = int(min(seats, caps[votes > 0].sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    at = lambda d: np.minimum(np.floor(votes / d + 0.5), caps).astype(np.int64)
    low, high = votes[votes > 0].min() / (2.0 * caps.max() + 2), 2.0 * votes.max() + 1  # at(low) >= seats >= at(high)
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if at(mid).sum() >= seats else (low, mid)
    got = at(high)
    missing = seats - int(got.sum())
    while missing > 0:  # the ties at the last divisor, and what rounding left
        q = np.where(got < caps, votes / (2 * got + 1), -1.0)
        best = np.argsort(-q, kind="stable")[:missing]
        best = best[q[best] > 0]
        if not len(best):
            break
        got[best] += 1
        missing -= len(best)
    return got


def plan(shards: pd.DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS, block=BLOCK) -> pd.DataFrame:
    """A row per (source, shard, words) -> with source_size, target, quota (blocks)."""
    shards = shards.sort_values(["no_source", "source", "shard"], kind="stable").reset_index(drop=True)
    keys = shards[["no_source", "source"]].drop_duplicates()
    ids = shards.groupby(["no_source", "source"], sort=False).ngroup().to_numpy()
    sizes = np.bincount(ids, shards["words"].to_numpy(), len(keys)).astype(np.int64)
    w = np.array([weights[i % len(weights)] for i in range(len(keys))])
    target = water_fill(w, sizes, share * sizes.sum(), repeats)
    words = shards["words"].to_numpy(np.int64)
    caps = repeats * words // block
    quota = np.zeros(len(shards), np.int64)
    seats = sainte_lague(target, int(round(target.sum() / block)), np.bincount(ids, caps, len(keys)).astype(np.int64))
    first = np.searchsorted(ids, np.arange(len(keys) + 1))
    for i, s in enumerate(seats):
        own = slice(first[i], first[i + 1])
        quota[own] = sainte_lague(words[own], int(s), caps[own])
    return shards.assign(source_size=sizes[ids], target=target[ids], quota=quota)


def _planner(frames: Iterator[pd.DataFrame], **kw) -> Iterator[pd.DataFrame]:
    got = [f for f in frames if len(f)]
    if got:
        yield plan(pd.concat(got), **kw)


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row (+ carried columns)."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(SIZE)), F.lit(0)).cast("long")
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
                        words.alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("h"), *carry)
    sized = stage(sized, "mix-sized")
    counts = sized.groupBy("no_source", "source").agg(F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*")) / 4)).cast("long").alias("n"))
    dealt = sized.join(side(counts, 100_000), ["no_source", "source"]).withColumn("shard", F.pmod(F.xxhash64("h", F.lit(1)), "n"))
    dealt = stage(dealt.drop("n"), "mix-dealt")
    shards = dealt.groupBy("no_source", "source", "shard").agg(F.sum("size").alias("words"))

    def planner(frames):
        yield from _planner(frames, weights=weights, share=share, repeats=repeats, block=block)

    quotas = stage(shards.coalesce(1).mapInPandas(planner, "no_source boolean, source string, shard long, words long, source_size long, target double, quota long"), "mix-quotas")
    laid = Window.partitionBy("no_source", "source", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = dealt.join(quotas, ["no_source", "source", "shard"]).withColumn("end", F.sum("size").over(laid))
    # the run [start, start + rest) on the circle of `words` words, after `full` whole turns
    q = q.withColumn("need", F.col("quota") * block).withColumn("full", F.expr("case when words > 0 then need div words else 0 end"))
    q = q.withColumn("rest", F.expr("need - full * words")).withColumn("start", F.expr(f"case when words > 0 then pmod(xxhash64({seed}L, no_source, source, shard), words) else 0 end"))
    overlap = lambda a, b: f"greatest(0L, least(end, {b}) - greatest(end - size, {a}))"
    taken = F.expr(f"full * size + {overlap('start', 'start + rest')} + {overlap('start - words', 'start + rest - words')}")
    return q.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *carry)
