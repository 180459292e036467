"""Readers of the Parquet tables that the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder; ``sf_dir`` may be any URI that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as a stream of its files; the table may be one file or a folder of them."""
    found = f"{sf_dir.rstrip('/')}/{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if files.getFileStatus(path).isDirectory():
        return reader.parquet(found)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
