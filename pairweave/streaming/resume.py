"""An append-only attempt log: what is still to do, as a batch, and its growth, as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def still_to_do(items: DataFrame, log: DataFrame, keys: list[str], done: Column | None = None) -> DataFrame:
    """Items without a (successful) attempt."""
    finished = log if done is None else log.where(done)
    return items.join(finished.select(*keys).distinct(), keys, "left_anti")


def stream_log(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """The log's files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def first_attempts(attempts: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """One row a key within the watermark's delay."""
    return attempts.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_tally(
    attempts: DataFrame, time: str, by: list[str], width: str = "10 minutes", delay: str = "1 hour",
) -> DataFrame:
    """Counts of each tumbling window; rows later than the watermark are not counted."""
    return attempts.withWatermark(time, delay).groupBy(F.window(time, width).alias("window"), *by).count()
