"""Hand-checked metric values."""

import pytest
from conftest import clip_rows
from pyspark.sql import functions as F

from tonemark.operators import metrics

NEG, NEU, POS = "negative", "neutral", "positive"
INCONGRUENT = [(NEU, NEG), (POS, NEG), (NEG, POS), (NEU, POS)]


def summary(df, *names):
    return metrics.summarise(df, [], list(names)).first()


def test_psi_follows_delivery(spark):
    rows = clip_rows(spark, [(t, p, p) for t, p in INCONGRUENT])
    assert tuple(summary(rows, "psi_contested", "psi_strict")) == (1.0, 1.0)


def test_psi_follows_words(spark):
    rows = clip_rows(spark, [(t, p, t) for t, p in INCONGRUENT])
    assert tuple(summary(rows, "psi_contested", "psi_strict")) == (0.0, 0.0)


def test_psi_is_null_without_incongruent_rows(spark):
    rows = clip_rows(spark, [(c, c, c) for c in (NEG, NEU, POS)])
    assert tuple(summary(rows, "psi_contested", "psi_strict")) == (None, None)


def test_third_label_counts_only_in_strict(spark):
    rows = clip_rows(spark, [(t, p, NEU) for t, p in INCONGRUENT])
    got = summary(rows, "psi_contested", "psi_strict", "n_incongruent")
    assert tuple(got) == (0.0, 0.0, 4)


def test_uar_is_not_accuracy(spark):
    rows = clip_rows(spark, [(NEG, NEG, NEG)] * 9 + [(POS, POS, NEG)])
    got = summary(rows, "uar", "accuracy", "macro_f1")
    assert got[0] == 0.5 and got[1] == 0.9
    assert got[2] == pytest.approx(2 * 9 / (9 + 10) / 3)


def test_ece_of_a_calibrated_model_is_zero(spark):
    rows = clip_rows(spark, [(NEG, NEG, NEG)] * 9 + [(POS, POS, NEG)])
    got = metrics.calibration_error(metrics.cells(rows, []), []).first()[0]
    assert got == pytest.approx(0.0, abs=1e-12)


def test_confidence_bins_are_right_closed(spark):
    values = [(0.0,), (0.1,), (0.1000001,), (0.3,), (0.7,), (1.0,)]
    df = spark.createDataFrame(values, "c double")
    got = [r[0] for r in df.select(metrics.confidence_bin(F.col("c"))).collect()]
    assert got == [1, 1, 2, 3, 7, 10]


def test_degeneracy_and_ties(spark):
    rows = clip_rows(spark, [(NEG, NEG, NEU)] * 19 + [(NEG, NEG, NEG)])
    got = metrics.degeneracy(rows, []).first()
    assert (got["top_class"], got["is_degenerate"]) == (NEU, True)
    tied = clip_rows(spark, [(NEG, NEG, POS), (NEG, NEG, NEU)])
    assert metrics.degeneracy(tied, []).first()["top_class"] == NEU


def test_recall_is_null_without_support(spark):
    rows = clip_rows(spark, [(NEG, NEG, NEG)])
    got = metrics.per_class_recall(rows, []).first()
    assert (got["recall_negative"], got["recall_positive"]) == (1.0, None)


def test_evaluate_has_one_row_per_group(spark):
    rows = clip_rows(spark, [(t, p, p) for t, p in INCONGRUENT])
    keyed = rows.select(
        "*", F.lit("A").alias("solution"), F.lit("d").alias("dataset"), F.lit("all").alias("split_type")
    )
    evaluated = metrics.evaluate(keyed)
    result = metrics.as_results(evaluated).first()
    assert result["n_clips"] == 4
    assert result["confusion_matrix"] == [[2, 0, 0], [0, 0, 0], [0, 0, 2]]
    assert result["latency_p50_ms"] == 1.0


def test_groups_without_latency_or_name_have_their_row(spark):
    rows = clip_rows(spark, [(t, p, p) for t, p in INCONGRUENT])
    solutions = F.explode(F.array(F.lit("A"), F.lit("B"), F.lit(None).cast("string")))
    keyed = rows.select(
        "*", solutions.alias("solution"), F.lit("d").alias("dataset"), F.lit("all").alias("split_type")
    ).withColumn("latency_ms", F.when(F.col("solution") == "A", F.col("latency_ms")))
    got = {r["solution"]: r for r in metrics.evaluate(keyed).collect()}
    assert set(got) == {"A", "B", None} and got["B"]["latency_p50_ms"] is None
    assert all(r["n_clips"] == 4 and r["ece"] is not None for r in got.values())
