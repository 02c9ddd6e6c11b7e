"""Streaming views of the access log; an extension, the batch operators don't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACCESS_SCHEMA = "access_id long, file_id long, query string, accessed_at timestamp"


def read_access_stream(spark: SparkSession, folder: str, files_per_batch: int = 10) -> DataFrame:
    """The access log as a stream over a growing folder of parquet files."""
    return spark.readStream.schema(ACCESS_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_access(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Accesses of each file and window; each access_id counts once within the watermark, later rows are dropped.

    Works on batch tables too, where there is no watermark and no row is late.
    """
    kept = stream.filter("access_id is not null and accessed_at is not null")
    if stream.isStreaming:
        kept = kept.withWatermark("accessed_at", late).dropDuplicates(["access_id", "accessed_at"])
    else:
        kept = kept.dropDuplicates(["access_id"])
    window = F.window("accessed_at", width, slide) if slide else F.window("accessed_at", width)
    return kept.groupBy(window, "file_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "file_id", "n")
