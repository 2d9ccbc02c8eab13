import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemark.operators import experiments, folded, learn
from tonemark.schema import LABELS


def clips(spark, n=240, width=5, seed=1):
    """Three speakers, one of them with half of the clips and one NULL; a dimension constant for a speaker."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        speaker = ["s0", "s0", "s1", None][i % 4]
        y = int(rng.integers(0, 3))
        x = rng.normal(0, 1, width) + y * np.linspace(1, 0, width) + (50.0 if speaker == "s0" else 0.0)
        x[-1] = 7.25 if speaker == "s1" else x[-1]
        rows.append((f"c{i}", speaker, LABELS[y], LABELS[int(rng.integers(0, 3))] if i % 9 else None, x.tolist()))
    return spark.createDataFrame(
        rows, "clip_id string, speaker_id string, prosody_sentiment string, text_sentiment string, features array<double>"
    )


def test_moments_of_draws_equal_numpy():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (50, 4)) + [0, 1e6, 0, 0]
    x[:, 2] = 3.3
    x[:25, 3] = 1e3
    inside = rng.random((50, 7)) < 0.5
    inside[:, 0] = np.arange(50) < 25
    inside[:, 1] = False
    n, mean, squares = folded.draw_moments(x, inside)
    assert n[1] == 0
    for d in [0, *range(2, 7)]:
        rows = x[inside[:, d]]
        assert n[d] == len(rows)
        np.testing.assert_allclose(mean[d], rows.mean(axis=0), rtol=1e-12)
        np.testing.assert_allclose(squares[d], ((rows - rows.mean(axis=0)) ** 2).sum(axis=0), rtol=1e-9, atol=1e-20)


@pytest.mark.parametrize("slice_rows", [None, 16])
def test_folded_counts_equal_a_loop_over_draws(spark, slice_rows):
    rng = np.random.default_rng(2)
    df, draws = clips(spark), 6
    places = F.expr(f"filter(sequence(0, {draws - 1}), d -> pmod(hash(clip_id, d), 3) > 0)")
    placed = df.withColumn("_draws", places)
    weights, bias = rng.normal(0, 1, (3, 5)), rng.normal(0, 1, 3)
    models = {"m": folded.Linear(weights, bias, learn.logit_head([0, 1, 2]))}
    got = {tuple(r)[:-1]: r["n"] for r in folded.folded_cells(placed, draws, models, 5, slice_rows=slice_rows).collect()}
    want, rows = {}, placed.collect()
    for d in range(draws):
        for speaker in ("s0", "s1", None):
            own = [r for r in rows if r["speaker_id"] == speaker and d in r["_draws"]]
            x = np.array([r["features"] for r in own])
            std = x.std(axis=0)
            z = np.where(std < 1e-8, 0.0, (x - x.mean(axis=0)) / np.where(std < 1e-8, 1.0, std))
            for r, p in zip(own, (z @ weights.T + bias).argmax(axis=1), strict=True):
                key = ("m", d, r["prosody_sentiment"], r["text_sentiment"], LABELS[p])
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_no_rows_give_no_counts(spark):
    placed = clips(spark).limit(0).withColumn("_draws", F.array(F.lit(0)))
    models = {"m": folded.Linear(np.zeros((3, 5)), np.zeros(3), learn.logit_head([0, 1, 2]))}
    assert folded.folded_cells(placed, 2, models, 5).count() == 0


def test_folded_experiment_equals_copies(spark):
    train, held = clips(spark, seed=3), clips(spark, n=120, seed=4)
    keys = ["scheme", "model", "level"]

    def run(fold):
        scored = experiments.skew(train, held, 5, ["logreg", "linear_svm"], schemes=["speaker_z"], seeds=1, fold=fold)
        return scored.toPandas().sort_values(keys)

    a, b = run(True), run(False)
    assert a[keys].values.tolist() == b[keys].values.tolist()
    numbers = [c for c in a.columns if c not in keys]
    np.testing.assert_allclose(a[numbers].astype(float), b[numbers].astype(float), atol=1e-9)
