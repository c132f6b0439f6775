"""Structured Streaming over event tables: windows with watermarks, deduplication, incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Counts and sums per window; works on streams (with a watermark) and tables alike."""
    rows = df.withWatermark(time, late) if late else df
    return rows.groupBy(F.window(time, width).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("_w.start").alias("start"), *keys, "n", "total")


def sliding(df: DataFrame, time: str, width: str, step: str, value: str, late: str | None = None) -> DataFrame:
    """Overlapping windows."""
    rows = df.withWatermark(time, late) if late else df
    return rows.groupBy(F.window(time, width, step).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("_w.start").alias("start"), "n", "total")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Sessions of each key, closed by a gap."""
    rows = df.withWatermark(time, late) if late else df
    return rows.groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("finish"), "n")


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, key: str, time: str, late: str, out: str, checkpoint: str) -> None:
    """Take what is new in one run and stop; rows that repeat a key within the watermark are dropped."""
    rows = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
