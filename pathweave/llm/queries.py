"""Registered queries of the training-data operators: opN_<name> over whole tables,
with production parameters, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import ball_tree, collocations, decontaminate, jaccard_join, language_id, licences, line_dedup, mixing, quality, quotations, spelling, suffix_dedup, token_counts
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per distinct doc_id: contaminated, n_windows, first_item, first_word, best."""
    docs = table(spark, sf_dir, "documents")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    found = found.withColumnRenamed("doc_id", "found_id")
    ids = docs.select("doc_id").distinct()
    got = ids.join(found, ids.doc_id.eqNullSafe(found.found_id), "left")
    return got.select("doc_id", F.col("n_windows").isNotNull().alias("contaminated"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"), "first_item", "first_word", "best")


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return got.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op3_top_k")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return ball_tree.top_k(e, e.where("vec_id % 100 = 0"))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op5_licence_scan", licences.scan_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


@query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op7_quotation_linking")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotations(table(spark, sf_dir, "conversations"))


@query("op10_line_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: doc_id, n_lines, n_removed, kept_chars, kept_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = line_dedup.dedup_lines(docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")))
    kept = F.coalesce("text", F.lit(""))
    return got.select("doc_id", "n_lines", F.col("__n_removed").alias("n_removed"), F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_quality")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_spelling", spelling.forms_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))


@query("op13_collocations", collocations.collocations_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
