"""Streaming jobs driven to the end over small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.streaming import retry, watch


def drive(stream, mode, name, spark):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_windows_and_last_heartbeats(spark, testdata, tmp_path):
    events = spark.read.parquet(str(testdata / "sf0.001" / "events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"file://{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/events")
    got = drive(watch.heartbeat_counts(stream, "ts", "event_type"), "complete", "windows", spark)
    assert sum(r["n"] for r in got) == events.count()
    last = drive(watch.last_heartbeats(stream, "user_id", "event_type", "ts"), "complete", "last", spark)
    want = {r["user_id"]: r["event_type"] for r in events.groupBy("user_id").agg(F.max_by("event_type", "ts").alias("event_type")).collect()}
    assert {r["user_id"]: r["event_type"] for r in last} == want


def test_states(spark):
    rows = spark.sql("SELECT * FROM VALUES ('purchase', 0), ('error', 999), ('view', 10), ('view', 100), ('view', 200) AS t(kind, age)")
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    at = F.timestamp_seconds(F.unix_seconds(now) - F.col("age"))
    assert [r["s"] for r in rows.select(watch.classify(F.col("kind"), at, now).alias("s")).collect()] == ["done", "error", "running", "stall", "dead"]


def test_resumed_ingest_adds_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    batch = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "ref string, n int")
    for _ in range(2):
        watch.append_new(batch, path, "ref")
    watch.append_new(spark.createDataFrame([("b", 9), ("c", 3)], "ref string, n int"), path, "ref")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_first_seen(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:10:00'), ('b', timestamp'2024-01-01 00:20:00') AS t(ref, ts)")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    assert sorted(r["ref"] for r in drive(watch.first_seen(stream, "ref", "ts"), "append", "seen", spark)) == ["a", "b"]


def test_retry_states(spark, tmp_path):
    schema = "repo string, at double, state string, retry_after string"
    rows = [("r", 0.0, "rate_limited", "7"), ("r", 30.0, "ok", None), ("r", 61.0, "transient_error", None), ("s", 5.0, "ok", None), ("t", 1.0, "rate_limited", "soon")]
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/in")
    got = {r["repo"]: r for r in drive(retry.retry_states(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")), "update", "retries", spark)}
    assert (got["r"]["attempts"], got["r"]["status"], got["r"]["retry_at"]) == (2, "transient_error", 361.0)
    assert got["s"]["retry_at"] == 5.0 + 30 * 86400 and got["t"]["retry_at"] == 301.0
