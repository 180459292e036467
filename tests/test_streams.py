"""Streams: late events and what the watermark closes."""

from pyspark.sql import functions as F

from lodestone.streaming import rollups


def test_late_event_is_left_out(spark, tmp_path):
    """Three files, one a batch: an hour is given once, without the event that comes after the watermark passed it."""
    schema = "event_id long, event_type string, value double, ts timestamp"
    files = [
        [(1, "a", 1.0, "2024-01-01 03:10:00"), (2, "error", 3.0, "2024-01-01 03:50:00"), (3, "a", 5.0, "2024-01-01 08:00:00")],
        [(5, "a", 7.0, "2024-01-01 07:30:00")],
        [(4, "a", 100.0, "2024-01-01 03:20:00"), (6, "a", 1.0, "2024-01-01 20:00:00")],
    ]
    for i, rows in enumerate(files):
        made = spark.createDataFrame(rows, "event_id long, event_type string, value double, at string")
        made.selectExpr("event_id", "event_type", "value", "CAST(at AS TIMESTAMP) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    found = {r.hour: (r.calls, r.errors, r.mean_value) for r in rollups.drained(rollups.hourly(stream)).collect()}
    assert found == {"2024-01-01 03": (2, 1, 2.0), "2024-01-01 07": (1, 0, 7.0), "2024-01-01 08": (1, 0, 5.0)}


def test_tables_of_many_files(spark, tmp_path):
    from lodestone.plans import activity

    said = [(i % 4, i // 4, "user", "x" * i) for i in range(40)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    at = [(i, f"2024-01-01 {i:02d}:10:00", 1, "error" if i == 2 else "view", 1.0, "{}") for i in range(10)]
    spark.createDataFrame(at, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    found = {r.conv_id: (r.turns, r.chars) for r in activity.style_state_stream(spark, str(tmp_path)).collect()}
    assert found == {c: (10, sum(i for i in range(40) if i % 4 == c)) for c in range(4)}
    assert [r.calls for r in activity.metrics_stream_hourly(spark, str(tmp_path)).collect()] == [1] * 7  # two hours behind the last
