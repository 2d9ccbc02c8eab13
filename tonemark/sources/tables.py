"""Parquet scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as it lies; file splits set the partitions."""
    return spark.read.parquet(path)
