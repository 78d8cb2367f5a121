"""Evaluation metrics over ranked suggestions.

Input is the long form ``(ex, original, rank, word[, score])`` with rank
1..k. Every per-example step is a group of at most k rows (k = top-k, a
setting), and every total is a plain aggregate with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import JOINED_PAD_OR_OOV
from ..functions.names import normalize_word

LEGAL_NAME = r"^[a-zA-Z|]+$"
EPSILON = 1e-7  # the streaming-metric variant adds it to the F1 denominator

WordFilter = Callable[[Column], Column]


def default_filters(oov: str = JOINED_PAD_OR_OOV) -> list[WordFilter]:
    """K2: the two predicates of the reference, AND-ed by ``legal_mask``."""
    return [lambda w: w != F.lit(oov), lambda w: w.rlike(LEGAL_NAME)]


def legal_mask(word: Column, filters: Sequence[WordFilter] | None = None) -> Column:
    """AND of all filters over the word column."""
    fs = list(filters) if filters is not None else default_filters()
    return reduce(lambda a, b: a & b, [f(word) for f in fs])


def legal_names(preds: DataFrame, filters: Sequence[WordFilter] | None = None) -> DataFrame:
    """Legal suggestions, with their 0-based rank among legal ones."""
    legal = preds.filter(legal_mask(F.col("word"), filters))
    w = Window.partitionBy("ex").orderBy("rank")
    return legal.withColumn("legal_rank", (F.row_number().over(w) - 1).cast("int"))


def first_true(preds: DataFrame, filters: Sequence[WordFilter] | None = None) -> DataFrame:
    """Per row, is it the first legal suggestion (running count of legal = 1 and legal)."""
    m = legal_mask(F.col("word"), filters)
    w = Window.partitionBy("ex").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = F.sum(m.cast("int")).over(w)
    return preds.select("ex", "rank", ((c == 1) & m).alias("first_true"))


def first_legal(preds: DataFrame, filters: Sequence[WordFilter] | None = None) -> DataFrame:
    """(ex, original, prediction): first legal suggestion, NULL when none."""
    m = legal_mask(F.col("word"), filters)
    return preds.groupBy("ex", "original").agg(
        F.min_by(F.when(m, F.col("word")), F.when(m, F.col("rank"))).alias("prediction"))


def subtoken_confusion(first: DataFrame, strict: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN with multiplicity, by presence on the other side.

    strict: split keeps empty subtokens (Python ``str.split``); no legal
    prediction counts every original subtoken as FN.
    nonan: empty subtokens are skipped and rows without a legal prediction
    are left out (the streaming-metric variant).
    """
    orig = F.split("original", r"\|", -1)
    pred = F.coalesce(F.split("prediction", r"\|", -1), F.array().cast("array<string>"))
    if not strict:
        orig = F.filter(orig, lambda x: F.length(x) > 0)
        pred = F.filter(pred, lambda x: F.length(x) > 0)
        first = first.filter(F.col("prediction").isNotNull())
    t = first.withColumns({"o": orig, "p": pred})
    return t.select(
        "ex", "original", "prediction", *carry,
        F.size(F.filter("p", lambda x: F.array_contains("o", x))).cast("long").alias("tp"),
        F.size(F.filter("p", lambda x: ~F.array_contains("o", x))).cast("long").alias("fp"),
        F.size(F.filter("o", lambda x: ~F.array_contains("p", x))).cast("long").alias("fn"),
    )


def subtoken_prf(conf: DataFrame, strict: bool = True) -> DataFrame:
    """D7 (strict) / D8 (nonan): micro precision, recall, F1 in one row."""
    s = conf.agg(F.count(F.lit(1)).alias("n"), F.sum("tp").cast("long").alias("tp"),
                 F.sum("fp").cast("long").alias("fp"), F.sum("fn").cast("long").alias("fn"))
    p = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    if strict:
        s = s.withColumns({"precision": p, "recall": r})
        f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
            2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    else:
        s = s.withColumns({"precision": F.coalesce(p, F.lit(0.0)), "recall": F.coalesce(r, F.lit(0.0))})
        f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                     F.col("precision") + F.col("recall") + F.lit(EPSILON)), F.lit(0.0))
    return s.withColumn("f1", f1)


def first_match_rank(preds: DataFrame, filters: Sequence[WordFilter] | None = None) -> DataFrame:
    """E5: (ex, original, match_rank, match_word) for examples with a match:
    0-based rank among legal suggestions of the first one equal to the
    original after H6 (examples without a match have no row)."""
    legal = legal_names(preds, filters)
    hit = normalize_word(F.col("word")) == normalize_word(F.col("original"))
    return legal.filter(hit).groupBy("ex", "original").agg(
        F.min("legal_rank").alias("match_rank"), F.min_by("word", "legal_rank").alias("match_word"))


def topk_accuracy(matches: DataFrame, preds: DataFrame, k: int) -> DataFrame:
    """Cumulative top-k curve: share of all examples whose first match rank is < i, i = 1..k."""
    hits = F.array(*[F.count_if(F.col("match_rank") < i) for i in range(1, k + 1)])
    a = matches.agg(hits.alias("h"))
    n = preds.select("ex").distinct().agg(F.count(F.lit(1))).scalar()
    return a.select(F.posexplode("h").alias("i", "c"), n.alias("n")).select(
        (F.col("i") + 1).cast("int").alias("k"), (F.col("c") / F.col("n")).alias("acc"))


def topk_accuracy_by_index(preds: DataFrame, k: int) -> DataFrame:
    """Share of examples whose exact target is among the first i of the unfiltered list."""
    per = preds.groupBy("ex").agg(F.min(F.when(F.col("word") == F.col("original"), F.col("rank"))).alias("r"))
    hits = F.array(*[F.count_if(F.col("r") <= i) for i in range(1, k + 1)])
    a = per.agg(hits.alias("h"), F.count(F.lit(1)).alias("n"))
    return a.select(F.posexplode("h").alias("i", "c"), "n").select(
        (F.col("i") + 1).cast("int").alias("k"), (F.col("c") / F.col("n")).alias("acc"))


def prediction_log(preds: DataFrame, filters: Sequence[WordFilter] | None = None) -> DataFrame:
    """One log line per example (the reference's 'no results' line lacked a newline; fixed)."""
    matches = preds.select("ex", "original").distinct().join(
        first_match_rank(preds, filters).drop("original"), "ex", "left")
    line = (F.when(F.col("match_rank") == 0,
                   F.concat(F.lit("Original: "), F.col("original"), F.lit(", predicted 1st: "), F.col("match_word")))
            .when(F.col("match_rank").isNotNull(),
                  F.concat(F.lit("\t\t predicted correctly at rank: "), (F.col("match_rank") + 1).cast("string")))
            .otherwise(F.concat(F.lit("No results for predicting: "), F.col("original"))))
    return matches.select("ex", line.alias("line"))


def multiset_ops(first: DataFrame) -> DataFrame:
    """Intersection and both differences of subtoken bags, multiplicity kept."""
    t = first.withColumns({"o": F.split("original", r"\|", -1),
                           "p": F.coalesce(F.split("prediction", r"\|", -1), F.array().cast("array<string>"))})
    return t.select(
        "ex",
        F.array_join(F.filter("p", lambda x: F.array_contains("o", x)), "|").alias("common"),
        F.array_join(F.filter("p", lambda x: ~F.array_contains("o", x)), "|").alias("pred_only"),
        F.array_join(F.filter("o", lambda x: ~F.array_contains("p", x)), "|").alias("orig_only"),
    )


def evaluate_predictions(preds: DataFrame, k: int, filters: Sequence[WordFilter] | None = None) -> DataFrame:
    """I13 metrics in one pass: per example the k suggestions are gathered
    (a group of at most k rows), the first legal one and the first match
    are found with array functions, and a single aggregate produces the
    cumulative top-k curve and the strict subtoken P / R / F1."""
    legal = legal_mask(F.col("word"), filters)
    g = preds.groupBy("ex", "original").agg(
        F.array_sort(F.collect_list(F.when(legal, F.struct("rank", "word")))).alias("lw"))
    words = F.transform("lw", lambda x: x["word"])
    hit_ranks = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size("lw") - 1, F.lit(0))),
                                     lambda i: F.when(normalize_word(F.get(words, i)) == normalize_word(F.col("original")),
                                                      i)),
                         lambda r: r.isNotNull())
    per = g.select("ex", "original", F.get(words, 0).alias("prediction"),
                   F.array_min(hit_ranks).alias("match_rank"))
    conf = subtoken_confusion(per, carry=("match_rank",))
    agg = conf.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.count_if(F.col("match_rank") < i) for i in range(1, k + 1)]).alias("hits"),
        F.sum("tp").cast("long").alias("tp"), F.sum("fp").cast("long").alias("fp"), F.sum("fn").cast("long").alias("fn"))
    p = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    out = agg.select("n", F.transform("hits", lambda h: h / F.col("n")).alias("topk_acc"),
                     p.alias("precision"), r.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.withColumn("f1", f1)
