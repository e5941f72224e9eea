"""Heartbeats to job states, resumable ingest and retry state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(kind: Column, at: Column, now: Column, dead_after: int = 180, stall_after: int = 90, done: str = "purchase", error: str = "error") -> Column:
    """done, error, dead, stall or running by the last event and its age in seconds."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))
    return F.when(kind == done, "done").when(kind == error, "error").when(age > dead_after, "dead").when(age > stall_after, "stall").otherwise("running")


def first_seen(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Each key once, in state kept for the delay: a resumed ingest takes no row twice."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def heartbeat_counts(stream: DataFrame, at: str, by: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events in tumbling windows; windows close behind the watermark."""
    counted = stream.withWatermark(at, delay).groupBy(F.window(at, window), by).agg(F.count("*").alias("n"), F.max(at).alias("last"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), by, "n", "last")


def last_heartbeats(stream: DataFrame, key: str, kind: str, at: str) -> DataFrame:
    """The last event of each key so far; run in update mode."""
    return stream.groupBy(key).agg(F.max_by(kind, at).alias(kind), F.max(at).alias(at))


def append_new(batch: DataFrame, path: str, key: str) -> None:
    """foreachBatch sink: rows whose key the table at path lacks are appended, so a batch that is run again adds nothing."""
    spark = batch.sparkSession
    batch = batch.dropDuplicates([key])
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    there = jvm.Path(path)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        batch = batch.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
    batch.write.mode("append").parquet(path)
