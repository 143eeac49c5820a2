"""States of a stream merge to those of its rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from basaltine.operators.aggregate import group_sparse
from basaltine.streaming import states


def test_running_states(spark, tmp_path, rows):
    source = tmp_path / "in"
    data = spark.range(500).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 != 0, F.col("id").cast("int")).alias("v"))
    data.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    states.running_states(stream, "k", "v", str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(60)
    assert rows(states.current(spark, str(tmp_path / "out"), "k")) == rows(group_sparse(data, "k", "v"))


def _ended(stream, tmp_path, name):
    stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(90)


def test_windows_and_sessions(spark, tmp_path):
    start, source = datetime(2024, 1, 1), str(tmp_path / "in")
    times = [0, 10, 70, 80, 130, 200, 205]
    data = [(start + timedelta(seconds=t), t % 2, t) for t in times] + [(start + timedelta(hours=9), 0, 0)]
    spark.createDataFrame(data, "at timestamp, k int, v int").coalesce(1).write.parquet(source)
    # a row that is too late once the first file's watermark holds, which is a batch after the next
    spark.createDataFrame([(start + timedelta(hours=10), 0, 0)], "at timestamp, k int, v int").coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([(start + timedelta(seconds=1), 0, 999)], "at timestamp, k int, v int").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("at timestamp, k int, v int").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
    _ended(states.windowed(stream(), "at", "k", "v", "1 minute", "10 seconds"), tmp_path, "windows")
    found = {(int((r["window"]["start"] - start).total_seconds()), r["k"]): (r["count"], r["sum"]) for r in spark.table("windows").collect()}
    want = {}
    for t in times:
        n, s = want.get((t // 60 * 60, t % 2), (0, 0))
        want[t // 60 * 60, t % 2] = (n + 1, s + t)
    assert {k: v for k, v in found.items() if k[0] < 3600} == want
    _ended(states.sessions(stream(), "at", "k", "v", "30 seconds", "10 seconds"), tmp_path, "sessions")
    found = sorted((int((r["session_window"]["start"] - start).total_seconds()), r["k"], r["count"], r["sum"]) for r in spark.table("sessions").collect() if r["session_window"]["start"] < start + timedelta(hours=1))
    assert found == [(0, 0, 2, 10), (70, 0, 2, 150), (130, 0, 1, 130), (200, 0, 1, 200), (205, 1, 1, 205)]
