"""Structured Streaming: hourly roll-up under a watermark, and running state by session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import new_folder


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Calls, errors and mean value by hour; events behind the watermark are left out."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("calls"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors"), F.round(F.avg("value"), 6).alias("mean_value"))
        .select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "calls", "errors", "mean_value")
    )


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of what its source holds; the result as a table on disk."""
    spark = stream.sparkSession
    out, marks = new_folder(spark, "stream"), new_folder(spark, "marks")
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", marks)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(out)
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(out)
