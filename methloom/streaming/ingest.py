"""Append-only ingest of methylation text and running window levels as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from methloom.sources.text import parse_sites


def stream_sites(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    """Site rows of text files as they arrive in a folder; the same parsing as the batch reader."""
    return parse_sites(spark.readStream.text(path), fmt, **options)


def append_table(sites: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends to the native table, by chromosome; each file of input is taken exactly once."""
    return sites.writeStream.format("parquet").partitionBy("chrom").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def window_counts(sites: DataFrame, size: int) -> DataFrame:
    """Running methylated count and coverage per chrom, window and context; integers, so updates are exact."""
    win = (F.floor(F.col("start") / size) * size).alias("win_start")
    return sites.groupBy("chrom", win, "context").agg(F.sum("meth").alias("meth"), F.sum("coverage").cast("long").alias("coverage"), F.count(F.lit(1)).alias("n_sites"))


def late_rows(sites: DataFrame, event_time: str, delay: str, window: str) -> DataFrame:
    """Rows and coverage per time window of delivery, rows later than ``delay`` behind the newest dropped by the watermark."""
    return sites.withWatermark(event_time, delay).groupBy(F.window(event_time, window).alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("total").alias("total")).select("w.start", "w.end", "n_rows", "total")
