"""From raw documents to a training mix: language identification, line
deduplication, near-duplicate removal, benchmark decontamination, mixing.

Every stage reads what the one before it kept (as Parquet) and returns the columns
of ``documents``, the last one the mix. Further columns pass through untouched.
Rows with null ids or texts go through every stage under the rules of its operator.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from pathweave.llm.common import side, table
from pathweave.llm.common import stage as staged
from pathweave.session import ensure_checkpoint_dir, ship_package

LEAST_SCORE = 0.5  # a document whose best language has a lower posterior is rejected
SHINGLE, PERCENT = 5, 80

ORACLE_SQL = None  # language models and edit distances: tested against brute force


def piece_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but the rows whose id and text hash are in gone(__gone, __th)."""
    return docs.join(side(gone, 1_000_000), F.col("doc_id").eqNullSafe(F.col("__gone")) & (text_hash() == F.col("__th")), "left_anti")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: not ``und``, posterior at least LEAST_SCORE."""
    ship_package(spark)
    d = docs.select("doc_id", "text", "lang", F.struct("*").alias("__row"))
    got = language_id.identify(d, piece_vocabulary(), keep=("__row",))
    return got.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SCORE)).select("__row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat earlier ones; documents of which nothing is left
    go. ``n_chars`` follows the text."""
    ship_package(spark)
    got = line_dedup.dedup_lines(docs)
    blank = F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\s+", " ")) == ""
    got = got.where(~((F.col("__n_removed") > 0) & blank))
    cols = [(F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType) if c == "n_chars" else F.col(c)).alias(c) for c in docs.columns]
    return got.select(*cols)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id
    (null last; of rows that repeat its id and text, one). A document is an id with a
    text, so other texts of the same or of a null id are judged by themselves."""
    ship_package(spark)
    gone = jaccard_join.later_copies(docs, shingle=SHINGLE, percent=PERCENT).select(F.col("id").alias("__gone"), F.col("th").alias("__th"))
    kept = without(docs, staged(gone, "near-gone"))
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count() == 0:
        return kept
    twice = docs.groupBy(F.col("doc_id").alias("__twice"), text_hash().alias("__th")).count().where("count > 1").drop("count")
    twice = staged(twice, "near-twice")
    same = (F.col("doc_id").eqNullSafe(F.col("__twice"))) & (text_hash() == F.col("__th"))
    again = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, same, "left_anti").unionByName(again)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents (an id with a text) that share no window with the benchmark."""
    ship_package(spark)
    keyed = docs.select(F.struct("doc_id", text_hash().alias("th")).alias("doc_id"), "text")
    found = decontaminate.decontaminate(keyed, table(spark, sf_dir, "benchmark")).select(F.col("doc_id.doc_id").alias("__gone"), F.col("doc_id.th").alias("__th"))
    return without(docs, staged(found, "leaks-gone"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of what is left."""
    ship_package(spark)
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
