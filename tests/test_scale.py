"""The bounded-task building blocks against their plain definitions."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tonemark.functions.hashing import stable_hash
from tonemark.operators import scale


@pytest.fixture(scope="module")
def rows(spark):
    # One group holds most rows and values repeat.
    i = F.col("id")
    return (
        spark.range(6000)
        .select(
            F.concat(F.lit("c"), i.cast("string")).alias("clip_id"),
            F.when(i % 97 == 0, None).when(i % 10 < 6, "hot").otherwise(F.concat(F.lit("g"), (i % 37).cast("string"))).alias("g"),
            F.when(i % 4 == 0, F.lit(5.0)).otherwise(((i * 7919) % 1000) / 7.0).alias("x"),
        )
        .withColumn("h", stable_hash("t", F.col("clip_id")))
        .persist()
    )


@pytest.mark.parametrize("rank_rows", [50, 500_000])
def test_take_by_hash(rows, rank_rows):
    got = scale.take_by_hash(rows, ["g"], "h", lambda n: F.ceil(n * 0.3), rank_rows=rank_rows)
    w = Window.partitionBy("g")
    want = rows.withColumn("r", F.row_number().over(w.orderBy("h", "clip_id"))).withColumn(
        "n", F.count(F.lit(1)).over(w)
    ).where("r <= ceil(n * 0.3)")
    assert {r[0] for r in got.select("clip_id").collect()} == {
        r[0] for r in want.select("clip_id").collect()
    }


@pytest.mark.parametrize("hot_rows", [100, 10**9])
def test_lookup_join_keeps_every_row(rows, hot_rows):
    stats = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"))
    got = scale.lookup_join(
        rows, stats, ["g"], count_col="n", spread_by="clip_id", hot_rows=hot_rows
    )
    want = rows.join(stats.withColumnRenamed("g", "s"), F.col("g").eqNullSafe(F.col("s")))
    cols = ["clip_id", "n", "m"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(
        map(tuple, want.select(cols).collect())
    )


@pytest.mark.parametrize("groups", [["g"], []])
def test_exact_percentiles_by_brackets(rows, groups):
    levels = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = scale.exact_percentiles(rows, groups, "x", levels)
    plain = rows.groupBy(*groups).agg(
        F.percentile("x", F.array(*[F.lit(q) for q in levels.values()])).alias("p")
    )
    want = {tuple(r[g] for g in groups): r["p"] for r in plain.collect()}
    for r in got.collect():
        assert [r[n] for n in levels] == pytest.approx(want[tuple(r[g] for g in groups)])


def test_bracketed_percentiles_of_a_large_group(spark):
    # Above the size where groups are ordered whole, only the brackets are.
    rows = spark.range(400_000).select(((F.col("id") * 48271) % 399_989).cast("double").alias("x"))
    levels = {"p5": 0.05, "p50": 0.5, "p95": 0.95}
    got = scale.exact_percentiles(rows.repartition(8), [], "x", levels).first()
    want = rows.agg(F.percentile("x", F.array(*[F.lit(q) for q in levels.values()]))).first()[0]
    assert list(got) == pytest.approx(want)


def test_global_orders(rows):
    by_hash = scale.global_hash_order(rows, "h", tie="clip_id")
    assert by_hash.count() == rows.count()
    want = F.row_number().over(Window.orderBy("h", "clip_id"))
    assert by_hash.withColumn("w", want).where("w <> position").isEmpty()
    # A heavy tie, and values that are missing: those come last.
    rows = rows.withColumn("x", F.when(F.col("clip_id") < "c2", None).otherwise(F.col("x")))
    by_value = scale.global_desc_order(rows, "x", tie="clip_id")
    want = F.row_number().over(Window.orderBy(F.desc_nulls_last("x"), "clip_id"))
    assert by_value.count() == rows.count()
    assert by_value.withColumn("w", want).where("w <> position").isEmpty()


@pytest.mark.parametrize("rank_rows", [50, 500_000])
def test_hash_cuts(rows, rank_rows):
    cuts = scale.hash_cuts(rows, "h", "clip_id", [F.lit(1234), F.lit(5000)], rank_rows=rank_rows)
    assert [rows.where(F.struct("h", "clip_id") <= c).count() for c in cuts] == [1234, 5000]


def test_beside_keeps_null_keys_and_unmatched_rows(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "g string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "g string, y int")
    got = {tuple(r) for r in scale.beside(left, right, ["g"]).collect()}
    assert got == {(None, 1, 10), ("a", 2, 20), ("b", 3, None)}


def test_one_heavy_value_in_a_hot_group(spark):
    # Most rows of the hot group hold one value.
    i = F.col("id")
    rows = spark.range(50_000).select(
        F.when(i % 10 < 8, "hot").when(i % 10 == 8, None).otherwise("cold").alias("g"),
        F.when(i % 7 > 0, 3.0).otherwise(i / 11.0).alias("x"),
    )
    got = {r["g"]: r["p"] for r in scale.exact_percentiles(rows, ["g"], "x", {"p": 0.93}).collect()}
    want = {r["g"]: r["p"] for r in rows.groupBy("g").agg(F.percentile("x", 0.93).alias("p")).collect()}
    assert got == pytest.approx(want) and len(got) == 3
