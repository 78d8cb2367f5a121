"""The extractor contract (K1): any source of examples is a DataFrame with
``example_id long, target string, contexts array<struct<src, path, dst>>``.
Language front ends (code parsers, page parsers, ...) only have to produce it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAG_SCHEMA = T.StructType([
    T.StructField("example_id", T.LongType()),
    T.StructField("target", T.StringType()),
    T.StructField("contexts", T.ArrayType(T.StructType([
        T.StructField("src", T.StringType()), T.StructField("path", T.StringType()),
        T.StructField("dst", T.StringType())]))),
])


def validate_bags(df: DataFrame) -> DataFrame:
    """Check the row form (names and types) before anything is planned on it."""
    got = {f.name: f.dataType for f in df.schema.fields}
    for f in BAG_SCHEMA.fields:
        if f.name not in got:
            raise ValueError(f"bag source lacks column {f.name}")
        if f.name == "contexts":
            inner = got[f.name]
            if not isinstance(inner, T.ArrayType) or not isinstance(inner.elementType, T.StructType) or \
                    [x.name for x in inner.elementType.fields] != ["src", "path", "dst"]:
                raise ValueError("contexts must be array<struct<src, path, dst>>")
    return df.select(F.col("example_id").cast("long"), F.col("target").cast("string"), "contexts")


def to_long(bags: DataFrame) -> DataFrame:
    """One row per context with its 1-based position."""
    e = bags.select("example_id", "target", F.posexplode("contexts").alias("p", "c"))
    return e.select("example_id", "target", (F.col("p") + 1).cast("int").alias("pos"),
                    F.col("c.src").alias("src"), F.col("c.path").alias("path"), F.col("c.dst").alias("dst"))
