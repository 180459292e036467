"""Sinks: partitions that are replaced alone, files of bounded size, logs by day."""

from __future__ import annotations

from pyspark.sql import DataFrame


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write ``df``; of what is there already only the partitions that it has rows for are replaced.

    ``df`` must not be read from ``path``. An empty ``df`` changes nothing that is there.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_log(df: DataFrame, path: str, day: str) -> None:
    """Append JSON lines in one folder a day."""
    df.write.mode("append").partitionBy(day).json(path)


def bounded_files(df: DataFrame, path: str, rows: int) -> None:
    """Parquet files of at most ``rows`` rows each."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)
