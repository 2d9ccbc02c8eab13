"""Result tables, per-clip prediction tables, parameters and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemark.functions.labels import safe_name
from tonemark.operators.scale import lookup_join
from tonemark.schema import EVAL_RESULT, MEASUREMENT

# Per-clip rows nested into one array.
CHUNK_ROWS = 10_000


def result_name(solution: Column, dataset: Column, split_type: Column) -> Column:
    return F.concat_ws("__", safe_name(solution), dataset, split_type)


def sink_results(results: DataFrame, path: str, *, fmt: str = "json") -> None:
    named = results.withColumn(
        "result_name", result_name(F.col("solution"), F.col("dataset"), F.col("split_type"))
    )
    # Few rows: one file per result keeps each individually replaceable.
    named.repartition("result_name").write.mode("append").partitionBy("result_name").format(
        fmt
    ).save(path)


def sink_predictions(rows: DataFrame, path: str) -> None:
    """The per-clip rows of a result, as a table partitioned like the results."""
    rows.write.mode("append").partitionBy("dataset", "split_type").parquet(path)


def scan_results(spark: SparkSession, path: str, *, recursive: bool = True) -> DataFrame:
    """All readable full results; broken files and partial records are left out."""
    schema = T.StructType([*EVAL_RESULT.fields, T.StructField("_corrupt", T.StringType())])
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", recursive)
        .json(path)
        .where(F.col("_corrupt").isNull() & F.col("confusion_matrix").isNotNull())
        .drop("_corrupt")
    )


def nest_predictions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per-clip rows as arrays of bounded length: (keys, chunk, predictions)."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sized = lookup_join(rows, sizes, keys, count_col="_n", spread_by="clip_id")
    chunks = F.ceil(F.col("_n") / F.lit(CHUNK_ROWS))
    entry = F.struct(
        "clip_id",
        "prosody_sentiment",
        "text_sentiment",
        "is_congruent",
        F.col("sentiment").alias("predicted_sentiment"),
        "confidence",
        "abstained",
        "latency_ms",
        "transcript",
    )
    return (
        sized.withColumn("chunk", F.pmod(F.xxhash64("clip_id"), chunks))
        .groupBy(*keys, "chunk")
        .agg(F.collect_list(entry).alias("predictions"))
    )


def explode_predictions(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.select(*keys, F.inline("predictions"))


def sink_params(params: DataFrame, path: str) -> None:
    params.coalesce(1).write.mode("overwrite").json(path)


def scan_params(spark: SparkSession, path: str | None, defaults: dict[str, float]) -> DataFrame:
    """A one-row parameter table; a missing file or field takes the default."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in defaults])
    stored = spark.read.schema(schema).json(path) if path else spark.createDataFrame([], schema)
    return stored.agg(
        *[F.coalesce(F.first(n, ignorenulls=True), F.lit(d)).alias(n) for n, d in defaults.items()]
    )


def sink_measurements(df: DataFrame, path: str) -> None:
    names = [f.name for f in MEASUREMENT.fields]
    df.select(*names).write.mode("overwrite").option("header", True).csv(path)


def scan_measurements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEASUREMENT).option("header", True).csv(path)
