"""Scoring raster windows as files arrive: each file is taken once, and a run that stopped goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def score_windows(spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType, score: Callable[[DataFrame], DataFrame], files_per_batch: int = 8) -> int:
    """Scores all window files that aren't done yet and returns the number of batches.

    The checkpoint remembers which files are done. A batch that is repeated after a crash overwrites its own folder only, so
    each window's rows are there once."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, n: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{target}/batch={n}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(q.recentProgress)


def zone_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Running counts of zones per time window of a stream or table with ts and zone; what comes later than late is left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "zone").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "zone", "n")
