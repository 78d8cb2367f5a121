"""Small tables for the tests of the training-data operators."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     # names that operators use themselves
                     T.StructField("id", T.StringType()), T.StructField("key", T.StringType()), T.StructField("h", T.LongType()), T.StructField("n", T.StringType())])


def docs_of(spark, rows, partitions=3):
    """rows of (doc_id, text[, lang[, source]]) with clashing extra columns."""
    full = []
    for r in rows:
        i, t, lang, source = (*r, *(None, None)[: 4 - len(r)])[:4] if len(r) < 4 else r[:4]
        full.append((i, t, lang, source, None if t is None else len(t), "x", None, 7, "y"))
    return spark.createDataFrame(full, DOCS).repartition(partitions)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = [f"w{rng.randrange(vocabulary)}" if rng.random() < 0.8 else rng.choice(["the", "of", "été", "naïve"]) for _ in range(n)]
    return " ".join(words)


def awkward(rng: random.Random):
    """Null, empty, blank, tiny, very long, tied and repeated rows."""
    long = "\n".join(prose(rng, 60, 5000) for _ in range(250))
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (5, long), (6, long), (6, long), (None, "null id " + prose(rng, 80)), (8, "x" * 5000), (9, "é" * 300), (10, "x" * 4000)]
