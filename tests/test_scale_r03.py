"""Steps whose figures grew too fast in round 3."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tonemark.operators import metrics, sampling
from tonemark.operators.scale import global_order
from tonemark.plans.views import Views


def test_places_are_joined_without_a_shuffle(spark):
    """F7, F8: each read of an ordered table shuffled it for a join with a row per partition."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = global_order(spark.range(1000).withColumn("h", F.xxhash64("id")), [F.col("h"), F.col("id")])
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert [r.position for r in placed.orderBy("h", "id").collect()] == list(range(1, 1001))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


KEYS = ["level", "majority", "seed", "speaker_id", "prosody_sentiment"]


def odd_clips(spark):
    """Groups of one to hundreds of rows, a NULL speaker, NULL and equal ids, an unknown class."""
    clips = Views(spark, SF).clips.select("clip_id", "speaker_id", "prosody_sentiment", "event_id")
    hot = F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("speaker_id"))
    extra = spark.createDataFrame(
        [("one", "s", "neutral", 1), ("two", "s", "positive", None), ("x", "s", "other", 5), ("solo", "t", "neutral", 2)], clips.schema
    )
    return clips.withColumn("speaker_id", hot).unionByName(extra)


@pytest.mark.parametrize("slice_rows", [None, 7])
def test_totals_are_those_of_copies(spark, slice_rows):
    """copies of each row were made, and ids hashed twice."""
    clips, draws = odd_clips(spark), sampling.draw_list(seeds=2)
    got = sampling.draw_totals(clips, draws, ["event_id"], slice_rows=slice_rows)
    copies = sampling.skewed_draws(clips, seeds=2, slice_rows=3 if slice_rows is None else None)
    want = copies.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("event_id"))
    rows = sorted(map(str, got.select(want.columns).collect()))
    assert rows and rows == sorted(map(str, want.collect()))


def test_sizes_are_those_of_copies(spark):
    """the rate was counted on copies, though sizes alone decide it."""
    clips = odd_clips(spark)
    sizes = sampling.draw_sizes(clips)
    copies = sampling.skewed_draws(clips, seeds=1)
    assert not any(c == "seed" for c in sizes.columns)
    want = copies.groupBy("level", "majority", "speaker_id", "prosody_sentiment").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(str, sizes.select(want.columns).collect())) == sorted(map(str, want.collect()))
    per = metrics.degeneracy_of_cells(sizes.withColumnRenamed("prosody_sentiment", "p"), ["level", "majority", "speaker_id"])
    assert per.where("is_degenerate").count() > 0
