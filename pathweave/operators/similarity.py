"""Nearest words by cosine (I15, I16) and word2vec text export / import.

Words and query vectors meet in block products (``scoring.block_pairs``): a task
holds one block of each and keeps a partial top-k per query with numpy, and the
final top-k per query is a ``row_number() <= k`` (partial WindowGroupLimit before
the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranking import reliable_checkpoint
from .scoring import block_pairs, matrix

QUERY_ROWS = 4096  # queries in a block


def unit(col):
    """Vector divided by its L2 norm (array<double>)."""
    norm = F.sqrt(F.aggregate(F.transform(col, lambda v: v * v), F.lit(0.0), lambda a, b: a + b))
    return F.transform(col, lambda v: v / norm)


def combine_queries(vectors: DataFrame, spec: DataFrame) -> DataFrame:
    """(qid, vec, exclude) from spec(qid, word, weight): mean of weight * unit(v), then unit.

    Each query has a handful of input words; the group is bounded by that list.
    """
    j = spec.join(vectors.select("word", unit(F.col("vec")).alias("u")), "word")
    j = j.select("qid", "word", F.transform("u", lambda x: x * F.col("weight")).alias("wu"))
    g = j.groupBy("qid").agg(F.collect_list("wu").alias("vs"), F.collect_list("word").alias("exclude"))
    dim = F.size(F.get("vs", 0))
    mean = F.transform(F.sequence(F.lit(0), dim - 1),
                       lambda d: F.aggregate(F.transform("vs", lambda v: F.get(v, d)), F.lit(0.0), lambda a, b: a + b)
                       / F.size("vs"))
    return g.select("qid", unit(mean).alias("vec"), "exclude")


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int, word_blocks: int | None = None,
            query_rows: int = QUERY_ROWS) -> DataFrame:
    """(qid, rank, word, similarity): the k most similar words per query, inputs excluded.

    Words and queries meet in block products; a block pair yields its k best per query."""
    queries = reliable_checkpoint(queries)
    qb = max(1, -(-queries.count() // query_rows))
    wb = word_blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        kind = pa.schema([("qid", pa.int64()), ("word", pa.string()), ("similarity", pa.float64())])
        if left.num_rows == 0 or right.num_rows == 0:
            return kind.empty_table()
        V = matrix(left.column("vec"))
        V = V / np.linalg.norm(V, axis=1, keepdims=True)
        words, qids, excl = np.array(left.column("word").to_pylist(), dtype=object), right.column("qid").to_pylist(), right.column("exclude").to_pylist()
        Q = matrix(right.column("vec"))
        out_q, out_w, out_s = [], [], []
        for j in range(len(qids)):
            s = np.round(V @ Q[j], 6)  # the order of results is (rounded similarity, word), here and in the last step
            s[np.isin(words, excl[j])] = -np.inf
            if len(s) > k:  # all that reach the kth value, then the words decide
                near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
            else:
                near = np.arange(len(s))
            top = near[np.lexsort((words[near], -s[near]))][:k]
            top = top[np.isfinite(s[top])]
            out_q.extend([qids[j]] * len(top))
            out_w.extend(words[top])
            out_s.extend(s[top].tolist())
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_w, pa.string()), pa.array(out_s, pa.float64())], schema=kind)

    pairs = block_pairs(vectors.select("word", F.transform("vec", lambda x: x.cast("double")).alias("vec")), "word", wb, queries, "qid", qb)
    partial = pairs.applyInArrow(run, "qid long, word string, similarity double")
    w = Window.partitionBy("qid").orderBy(F.round("similarity", 6).desc(), "word")
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def word2vec_lines(vectors: DataFrame, dim: int) -> DataFrame:
    """Header `V D`, then `word f1 ... fD` in index order (6 decimals); (line_no, text), header is line 0."""
    from .ranking import global_index

    body = global_index(vectors, [F.col("idx")], name="i").select(
        (F.col("i") + 1).alias("line_no"),
        F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda v: F.format_string("%.6f", v)), " "))
        .alias("text"))
    n = vectors.agg(F.count(F.lit(1))).scalar()
    header = vectors.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("line_no"), F.concat_ws(" ", n.cast("string"), F.lit(str(dim))).alias("text"))
    return header.unionByName(body)


def read_word2vec(lines: DataFrame) -> DataFrame:
    """(word, vec) from word2vec text; the header is the line with two fields."""
    p = F.split("value", " ", -1)
    body = lines.select(p.alias("p")).filter(F.size("p") > 2)
    return body.select(F.get("p", 0).alias("word"),
                       F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("double")).alias("vec"))
