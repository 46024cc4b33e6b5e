"""Streams: rows processed once, in small steps, from where the last run ended; windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new(spark: SparkSession, source: str, out: str, state: str, work: Callable[[DataFrame], DataFrame], files_per_step: int = 16) -> int:
    """What came into a parquet folder since the last run, through `work`, appended to `out`; rows appended. Progress is kept in `state`, so a run after a failure goes on where it stopped and no file is read twice."""
    schema = spark.read.parquet(source).schema
    done = [0]

    def write(batch: DataFrame, number: int) -> None:
        made = work(batch).persist()
        done[0] += made.count()
        made.write.mode("overwrite").parquet(f"{out}/step={number}")  # the same step again replaces itself
        made.unpersist()

    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return done[0]


def windowed_counts(events: DataFrame, at: str, by: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum by window and key; on a stream rows later than `late` are left out."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")
