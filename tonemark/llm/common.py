"""Staged tables and small helpers of the operators."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemark.sources.storage import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_rows(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, text never null."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the table has columns called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def among(docs: DataFrame, keys: DataFrame, how: str, name: Column) -> tuple[DataFrame, str]:
    """The documents whose (doc_id, name) are among those of `keys` (left_semi) or not (left_anti).

    Returns them with the name, and its column.
    """
    named, other_id, other_name = fresh(docs, "name", "other_id", "other_name")
    keyed = docs.withColumn(named, name)
    keys = keys.toDF(other_id, other_name)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(other_id)) & (F.col(named) == F.col(other_name))
    return keyed.join(keys, same, how), named


KEY = ["d", "th"]


def dealt_texts(docs: DataFrame) -> DataFrame:
    """doc_id, the key of joins and the packed text, dealt by the key and cached.

    The key is the doc_id, never null, and the text's hash. The text moves once, packed;
    joins on the key read it from the cache, which spills to disk and is made again from
    the shuffle if an executor is lost. The caller unpersists it.
    """

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [packer.compress(x.as_py().encode("utf-8", "replace")) for x in batch.column("text")]
            yield pa.record_batch(
                [*(batch.column(c) for c in ("doc_id", *KEY)), pa.array(packed, pa.binary())], ["doc_id", *KEY, "packed"]
            )

    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(-(1 << 63))).alias("d"),
        F.xxhash64(text).alias("th"),
        text.alias("text"),
    )
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = keyed.mapInArrow(run, "doc_id long, d long, th long, packed binary")
    return packed.repartition(partitions, *KEY).persist(StorageLevel.MEMORY_AND_DISK)


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    opened = zstandard.ZstdDecompressor()
    return [opened.decompress(x.as_py()) for x in batch.column("packed")]
