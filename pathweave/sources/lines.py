"""Text forms of examples, histograms and stores.

The text line of an example is ``target ctx ctx ...`` with contexts
``src,path,dst``; paths are hashed by default (H9). Parquet is the native
store; text is produced only for export and parity.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.names import maybe_hash_path
from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/pathweave-out/{name}-{uuid.uuid4().hex[:12]}"


def context_text(no_hash: bool = False) -> Column:
    return F.concat_ws(",", F.col("src"), maybe_hash_path("path", no_hash), F.col("dst"))


def emit_example_lines(ctx: DataFrame, no_hash: bool = False, pretty: bool = False) -> DataFrame:
    """One line per example, contexts in position order."""
    g = ctx.groupBy("ex", "target").agg(
        F.array_sort(F.collect_list(F.struct("pos", context_text(no_hash).alias("c")))).alias("cs"))
    sep = "\n\t" if pretty else " "
    line = F.concat(F.col("target"), F.lit(sep), F.array_join(F.transform("cs", lambda x: x["c"]), sep))
    return g.select("ex", line.alias("line"))


def parse_example(lines: DataFrame) -> DataFrame:
    """B1 / A3: split at single blanks (consecutive blanks give empty contexts)."""
    parts = F.split("line", " ", -1)
    return lines.select("*", parts[0].alias("target"), F.slice(parts, 2, F.size(parts) - 1).alias("contexts"))


def split_contexts(parsed: DataFrame, pad: str) -> DataFrame:
    """B2: context -> (src, path, dst), missing parts -> PAD; more than 3 parts is an error."""
    ex = parsed.select("ex", "target", F.posexplode("contexts").alias("i", "c"))
    p = F.split("c", ",", -1)
    checked = F.when(F.size(p) <= 3, p).otherwise(F.raise_error(F.concat(F.lit("context with more than 3 parts: "),
                                                                        F.col("c"))))
    ex = ex.withColumn("p", checked)
    return ex.select("ex", "target", (F.col("i") + 1).cast("int").alias("i"),
                     F.coalesce(F.get("p", 0), F.lit(pad)).alias("src"),
                     F.coalesce(F.get("p", 1), F.lit(pad)).alias("path"),
                     F.coalesce(F.get("p", 2), F.lit(pad)).alias("dst"))


def padded_lines(ctx: DataFrame, settings: Settings) -> DataFrame:
    """Line of a sampled bag (at most max contexts) plus one blank per missing
    context up to max; the role is kept."""
    g = ctx.groupBy("ex", "role", "target").agg(
        F.array_sort(F.collect_list(F.struct("pos", context_text().alias("c")))).alias("cs"))
    pad = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(settings.max_contexts) - F.size("cs")).cast("int"))
    line = F.concat(F.col("target"), F.lit(" "), F.array_join(F.transform("cs", lambda x: x["c"]), " "), pad)
    return g.select("ex", "role", line.alias("line"))


def stored(spark: SparkSession, name: str, build) -> DataFrame:
    """A table kept under a name in the shared folder: read if it is there, else built,
    written and read (A16)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pathweave-out/stored-{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def histogram_lines(hist: DataFrame) -> DataFrame:
    """`word count` text with a line number in the order count desc, word."""
    from ..operators.ranking import global_index

    g = global_index(hist, [F.col("cnt").desc(), F.col("word")], name="k")
    return g.select((F.col("k") + 1).alias("line_no"),
                    F.concat_ws(" ", "word", F.col("cnt").cast("string")).alias("value"))


def read_histogram(lines: DataFrame, min_count: int = 0, start_from: int = 0) -> DataFrame:
    """Keep lines with two fields and count >= min; the first line of a
    word wins; index = start_from + position among kept lines."""
    p = F.split(F.rtrim("value"), " ", -1)
    t = lines.select("line_no", p.alias("p")).filter(F.size("p") == 2).select(
        "line_no", F.col("p")[0].alias("word"), F.col("p")[1].try_cast("long").alias("cnt"))
    t = t.filter(F.col("cnt") >= min_count)
    first = t.groupBy("word").agg(F.min_by("cnt", "line_no").alias("cnt"), F.min("line_no").alias("line_no"))
    from ..operators.ranking import global_index

    idx = global_index(first, [F.col("line_no")], name="k")
    return idx.select("word", (F.col("k") + start_from).cast("int").alias("idx"), "cnt")


def write_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).text(path)
