"""Incremental feature store: a parquet table keyed by clip_id, partitioned by its hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemark.schema import FEATURES
from tonemark.sources.storage import new_path

BUCKETS = 64
# Committed slices of one extraction run.
COMMITS = 8
# Clips of one file of the store.
FILE_ROWS = 500_000
_STORED = T.StructType([*FEATURES.fields, T.StructField("bucket", T.IntegerType())])


def bucket() -> Column:
    return F.pmod(F.xxhash64("clip_id"), F.lit(BUCKETS)).cast("int")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The store, empty when nothing was written yet."""
    return _stored(spark, path).drop("bucket")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_STORED).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STORED)


def uncached(manifest: DataFrame, store: DataFrame) -> DataFrame:
    return manifest.join(store.select("clip_id"), "clip_id", "left_anti")


def extract(
    clips: DataFrame,
    embed: Callable[[object], np.ndarray],
    width: int,
    payload: str = "payload",
) -> DataFrame:
    """Apply a user extractor per clip. A failure yields NaNs; no clip is dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = []
            for item in batch[payload]:
                try:
                    vector = np.asarray(embed(item), dtype=np.float32)
                except Exception:  # noqa: BLE001 - a failed clip is data, not an error
                    vector = np.full(width, np.nan, dtype=np.float32)
                if vector.shape != (width,):
                    raise ValueError(f"expected {width} features, got shape {vector.shape}")
                vectors.append(vector)
            yield pd.DataFrame({"clip_id": batch["clip_id"], "features": vectors})

    return clips.select("clip_id", payload).mapInPandas(run, FEATURES)


def append(
    clips: DataFrame,
    embed: Callable[[object], np.ndarray],
    width: int,
    path: str,
    payload: str = "payload",
) -> DataFrame:
    """Extract only clips the store does not hold yet, append them, return the store.

    The input is read once: its clips that are not stored yet are written beside the store's
    data, dealt by slice. They are extracted and committed in COMMITS slices of the hash
    buckets, so a run that is cut off loses one slice and the next run resumes from what is
    there. A slice writes one file of at most about FILE_ROWS clips per bucket and part of it.
    """
    spark = clips.sparkSession
    wanted = clips.select("clip_id", payload).dropDuplicates(["clip_id"])
    staged = new_path(spark, "wanted")
    keyed = uncached(wanted, scan(spark, path)).withColumn("bucket", bucket())
    dealt = keyed.withColumn("slice", F.col("bucket") % COMMITS)
    dealt.write.partitionBy("slice").parquet(staged)
    fresh = spark.read.schema(dealt.schema).parquet(staged)
    sizes = fresh.groupBy("slice", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # At most COMMITS rows: buckets of a slice and the clips of its largest one.
    plan = sizes.groupBy("slice").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    for part in sorted(plan.collect()):
        files = -(-part["n"] // FILE_ROWS)
        own = fresh.where(F.col("slice") == part["slice"])
        vectors = extract(own, embed, width, payload).withColumn("bucket", bucket())
        spread = F.pmod(F.xxhash64(F.lit("file"), "clip_id"), F.lit(files))
        vectors.repartition(part["k"] * files, "bucket", spread).write.mode("append").partitionBy("bucket").parquet(path)
    return scan(spark, path)


def served(manifest: DataFrame, store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored vector where there is one, freshly computed vector otherwise."""
    s = store.select("clip_id", F.col("features").alias("_stored"))
    f = fresh.select("clip_id", F.col("features").alias("_fresh"))
    return (
        manifest.join(s, "clip_id", "left")
        .join(f, "clip_id", "left")
        .withColumn("hit", F.col("_stored").isNotNull())
        .withColumn("features", F.coalesce("_stored", "_fresh"))
        .drop("_stored", "_fresh")
    )
