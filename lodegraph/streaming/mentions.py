"""Counts over mentions and events as they arrive, with late rows and repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_growing(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files that grows; each file is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, at: str, key: str, kind: str, value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, kind, n, total: rows of each kind in each window.

    A row that comes later than `late` is left out, a key sent again within that
    time counts once; the state of closed windows is dropped.
    """
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    once = timed.dropDuplicatesWithinWatermark([key])
    counts = once.groupBy(F.window("_at", window).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "kind", "n", "total")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now and stop; the next call goes on from the checkpoint."""
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
