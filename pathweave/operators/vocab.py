"""Histograms, vocabulary cuts, numbering and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings, SpecialWords
from .ranking import global_index, maybe_broadcast


def histogram(words: Column, df: DataFrame) -> DataFrame:
    """(word, cnt) of one column; partial + final hash aggregation."""
    return df.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def target_histogram(examples: DataFrame) -> DataFrame:
    """Count of targets, one per example (train only is the caller's filter)."""
    return histogram(F.col("target"), examples.select("ex", "target").distinct())


def token_histogram(contexts: DataFrame) -> DataFrame:
    """Source and destination tokens pooled."""
    return histogram(F.explode(F.array("src", "dst")), contexts)


def path_histogram(contexts: DataFrame) -> DataFrame:
    """D3: paths."""
    return histogram(F.col("path"), contexts)


def rank_words(hist: DataFrame) -> DataFrame:
    """0-based position ``r`` by count desc, word asc (our tie-break), for a
    histogram of any size (distributed global numbering)."""
    return global_index(hist, [F.col("cnt").desc(), F.col("word").asc()], name="r")


def count_at(hist: DataFrame, position: int) -> Column:
    """Count found at 0-based ``position`` of the descending counts (NULL when
    there are not that many words), as a scalar subquery.

    Works on the count-of-counts table: its size is the number of distinct
    count values, at most sqrt(2 * total occurrences), so its running sum
    runs in one small ordered partition whatever the vocabulary size.
    """
    cc = hist.groupBy("cnt").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("cnt").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = cc.withColumn("cum", F.sum("n").over(w))
    return cum.filter(F.col("cum") > position).agg(F.max("cnt")).scalar()


def cut_strict(hist: DataFrame, max_size: int) -> DataFrame:
    """if more than ``max_size`` words, keep those with count greater than
    the count at position ``max_size``; all ties at the border are dropped.
    At most ``max_size`` words survive."""
    thr = count_at(hist, max_size)
    return hist.filter(F.col("cnt") > F.coalesce(thr, F.lit(-1))).select("word", "cnt")


def cut_topn(ranked: DataFrame, max_size: int) -> DataFrame:
    """first ``max_size`` words of the order (count desc, word)."""
    return ranked.filter(F.col("r") < max_size)


def number_bounded(counts: DataFrame) -> DataFrame:
    """Position ``r`` by (count desc, word) for a table already cut to at most
    a vocabulary cap: a single ordered partition of proven size."""
    w = Window.orderBy(F.col("cnt").desc(), F.col("word").asc())
    return counts.withColumn("r", (F.row_number().over(w) - 1).cast("long"))


def specials_frame(spark: SparkSession, specials: SpecialWords) -> DataFrame:
    """The special words with their fixed indices."""
    rows = [(w, i) for i, w in enumerate(specials.ordered)]
    return spark.createDataFrame(rows, "word string, idx int")


def vocab_from_counts(spark: SparkSession, counts: DataFrame, max_size: int, specials: SpecialWords) -> DataFrame:
    """E1 + F2 + G5: numbered vocabulary, specials first, then the first
    ``max_size`` words by count desc. ``counts`` is the F1 cut (at most
    ``max_size`` rows), so the numbering runs on a bounded table."""
    words = cut_topn(number_bounded(counts), max_size).select(
        "word", (F.col("r") + specials.n).cast("int").alias("idx"))
    return specials_frame(spark, specials).unionByName(words)


def build_vocab(spark: SparkSession, hist: DataFrame, cap: int, specials: SpecialWords) -> tuple[DataFrame, DataFrame]:
    """Histogram -> (count map after the F1 cut, numbered vocabulary)."""
    counts = cut_strict(hist, cap)
    return counts, vocab_from_counts(spark, counts, cap, specials)


def lookup(df: DataFrame, col: str, vocab: DataFrame, out: str, oov_idx: int, cap: int,
           settings: Settings) -> DataFrame:
    """Word -> index, miss -> OOV index (left join; broadcast when the cap allows)."""
    v = maybe_broadcast(vocab.select(F.col("word").alias(f"_{out}_w"), F.col("idx").alias(f"_{out}_i")),
                        cap + 2, settings.vocab_row_bytes, settings.broadcast_limit_bytes)
    j = df.join(v, df[col] == v[f"_{out}_w"], "left")
    return j.withColumn(out, F.coalesce(F.col(f"_{out}_i"), F.lit(oov_idx)).cast("int")).drop(
        f"_{out}_w", f"_{out}_i")


def reverse_lookup(df: DataFrame, col: str, vocab: DataFrame, out: str, oov_word: str, cap: int,
                   settings: Settings) -> DataFrame:
    """Index -> word, miss -> OOV word."""
    v = maybe_broadcast(vocab.select(F.col("idx").alias(f"_{out}_i"), F.col("word").alias(f"_{out}_w")),
                        cap + 2, settings.vocab_row_bytes, settings.broadcast_limit_bytes)
    j = df.join(v, df[col] == v[f"_{out}_i"], "left")
    return j.withColumn(out, F.coalesce(F.col(f"_{out}_w"), F.lit(oov_word))).drop(f"_{out}_w", f"_{out}_i")


def membership(df: DataFrame, col: str, counts: DataFrame, flag: str, cap: int, settings: Settings) -> DataFrame:
    """Is the value a key of the count map (left join flag)."""
    v = maybe_broadcast(counts.select(F.col("word").alias(f"_{flag}_w")),
                        cap + 1, settings.vocab_row_bytes, settings.broadcast_limit_bytes)
    j = df.join(v, df[col] == v[f"_{flag}_w"], "left")
    return j.withColumn(flag, F.col(f"_{flag}_w").isNotNull()).drop(f"_{flag}_w")
