import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemark.operators.normalise import normalise, z_within


def table(spark, values, groups):
    rows = [(f"c{i}", g, [float(x) for x in np.atleast_1d(v)]) for i, (v, g) in enumerate(zip(values, groups))]
    return spark.createDataFrame(rows, "clip_id string, speaker_id string, features array<double>")


def run(df, scheme, width):
    got = {r["clip_id"]: list(r["features"]) for r in normalise(df, scheme, width).collect()}
    return np.array([got[f"c{i}"] for i in range(len(got))])


def naive_loo(x, groups):
    out = np.zeros_like(x)
    for i in range(len(x)):
        same = np.flatnonzero(groups == groups[i])
        block, others = x[same], x[same[same != i]]
        if len(same) < 3:
            mean, std = block.mean(0), block.std(0)
        else:
            mean, std = others.mean(0), others.std(0)
            std = np.where(std < 1e-8, block.std(0), std)
        out[i] = np.where(std < 1e-8, 0.0, (x[i] - mean) / np.maximum(std, 1e-8))
    return out


def test_speaker_z(spark):
    df = table(spark, [1, 3, 101, 103], ["a", "a", "b", "b"])
    assert run(df, "speaker_z", 1).ravel().tolist() == [-1, 1, -1, 1]


@pytest.mark.parametrize("scheme", ["dataset_z", "speaker_z", "speaker_z_loo"])
@pytest.mark.parametrize("width", [2, 20])
def test_constant_dimension_is_zero(spark, scheme, width):
    df = table(spark, [[5.0] * width] * 4, ["a", "a", "a", "a"])
    assert np.all(run(df, scheme, width) == 0)


def test_loo_keeps_a_lone_outlier(spark):
    df = table(spark, [0, 0, 0, 0, 9], ["a"] * 5)
    loo, pooled = run(df, "speaker_z_loo", 1), run(df, "speaker_z", 1)
    assert loo[4, 0] == pytest.approx(2.5) and loo[4, 0] > pooled[4, 0]


def test_loo_small_group_uses_group_figures(spark):
    assert run(table(spark, [1, 3], ["a", "a"]), "speaker_z_loo", 1).ravel().tolist() == [-1, 1]


@pytest.mark.parametrize("width", [4, 20])
def test_loo_equals_deleting_the_row(spark, width):
    rng = np.random.default_rng(0)
    x = rng.normal(3, 2, size=(14, width))
    groups = np.array(["a"] * 7 + ["b"] * 5 + ["c"] * 2)
    assert run(table(spark, x, groups), "speaker_z_loo", width) == pytest.approx(
        naive_loo(x, groups), abs=1e-9
    )


@pytest.mark.parametrize("width", [4, 20, 200])
def test_one_gap_spoils_its_dimension_at_any_width(spark, width):
    x = np.random.default_rng(1).normal(size=(9, width))
    x[0, 0] = np.nan
    groups = np.array(["a"] * 5 + ["b"] * 4)
    # Gaps come back as NULL.
    got = run(table(spark, x, groups), "speaker_z_loo", width).astype(float)
    assert np.isnan(got[:5, 0]).all() and np.isnan(got).sum() == 5
    assert got[:, 1:] == pytest.approx(naive_loo(x[:, 1:], groups), abs=1e-9)


def test_null_groups_are_groups(spark):
    df = table(spark, [1, 3, 101, 103], [None, None, "b", "b"])
    assert run(df, "speaker_z", 1).ravel().tolist() == [-1, 1, -1, 1]
    rows = spark.createDataFrame([("c0", None, 2.0), ("c1", None, 4.0), ("c2", "s", 1.0)], "clip_id string, source string, v double")
    assert {r["clip_id"]: r["z"] for r in z_within(rows, "v", ["source"]).collect()} == {"c0": -1, "c1": 1, "c2": 0}


def test_pool_separates_sets(spark):
    df = table(spark, [1, 3, 101, 103], ["a"] * 4).withColumn(
        "draw", F.when(F.col("clip_id") < "c2", 0).otherwise(1)
    )
    got = {r[0]: r[1][0] for r in normalise(df, "speaker_z", 1, pool=["draw"]).select("clip_id", "features").collect()}
    assert got == {"c0": -1, "c1": 1, "c2": -1, "c3": 1}


def test_z_within_constant_group(spark):
    df = spark.createDataFrame([("c0", "s", 2.0), ("c1", "s", 2.0)], "clip_id string, source string, v double")
    assert {r["z"] for r in z_within(df, "v", ["source"]).collect()} == {0.0}
