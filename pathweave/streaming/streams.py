"""Structured Streaming forms.

Every stream reads the table files as a file source, runs with
``trigger(availableNow=True)`` (all data present now, in bounded
micro-batches, then stop) and keeps its checkpoint in the shared folder. A
stream that is given a ``home`` folder finds its checkpoint and results there
again, so a restarted query resumes where it stopped; without one it starts
anew. Batch sinks write a folder per batch id, so a batch that is replayed
replaces its rows instead of counting twice. Results land in parquet tables
that the batch side reads back; the tests assert stream result == batch
result.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lines import scratch_path


def table_stream(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table file as a streaming source (one file per micro-batch)."""
    schema = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).schema
    df = (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
          .option("maxFilesPerTrigger", 1).parquet(sf_dir))
    return df.select(*columns) if columns else df


def _places(spark: SparkSession, name: str, home: str | None) -> tuple[str, str]:
    """(results, checkpoint) of a stream."""
    if home is None:
        return scratch_path(spark, name), scratch_path(spark, name + "-ckpt")
    return f"{home.rstrip('/')}/{name}", f"{home.rstrip('/')}/{name}-ckpt"


def run_to_parquet(df: DataFrame, name: str, mode: str = "append", home: str | None = None) -> str:
    """Append-mode stream into a parquet table; returns the table path."""
    out, ck = _places(df.sparkSession, name, home)
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def run_foreach_batch(df: DataFrame, name: str, fn, mode: str = "append", home: str | None = None) -> str:
    """Stream whose micro-batches are handled by ``fn(batch_df, epoch_id, out_path)``."""
    out, ck = _places(df.sparkSession, name, home)
    q = (df.writeStream.foreachBatch(lambda b, e: fn(b, e, out)).option("checkpointLocation", ck)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def overwrite_sink(batch: DataFrame, epoch: int, out: str) -> None:
    """Complete-mode result: each micro-batch carries the whole table."""
    batch.write.mode("overwrite").parquet(out)


def batch_sink(batch: DataFrame, epoch: int, out: str) -> None:
    """Rows of a micro-batch, in the folder of its id (read back as the column ``batch``)."""
    batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")
