"""Where intermediate tables live: the folder the cluster shares, if it names one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a temporary folder in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _local[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
