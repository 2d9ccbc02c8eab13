import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tonemark.functions import arrays, labels, probs, voice
from tonemark.operators import filters, frames, summaries
from tonemark.operators.scoring import check_fusion, check_thresholds, prediction_checks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_fusion_extremes_recover_each_side(spark):
    a, b = vec(0.7, 0.2, 0.1), vec(0.1, 0.3, 0.6)
    assert one(spark, probs.fuse(a, b, F.lit(1.0), F.lit(1.0))) == pytest.approx([0.7, 0.2, 0.1])
    assert one(spark, probs.fuse(a, b, F.lit(0.0), F.lit(1.0))) == pytest.approx([0.1, 0.3, 0.6])
    hot = one(spark, probs.fuse(a, b, F.lit(1.0), F.lit(3.0)))
    assert max(hot) < 0.7 and sum(hot) == pytest.approx(1)
    zero = one(spark, probs.fuse(vec(1, 0, 0), b, F.lit(0.5), F.lit(1.0)))
    assert sum(zero) == pytest.approx(1) and not any(math.isnan(x) for x in zero)


def test_argmax_first_wins(spark):
    assert one(spark, probs.argmax_label(vec(0.4, 0.4, 0.2))) == "negative"
    assert one(spark, probs.argmax_of([F.lit(0.1), F.lit(0.4), F.lit(0.4)])) == "neutral"


def test_normalise_rejects_other_labels(spark):
    good = F.create_map(*[F.lit(x) for kv in {"positive": 2.0, "negative": 1.0, "neutral": 1.0}.items() for x in kv])
    assert one(spark, probs.normalise(good)) == [0.25, 0.25, 0.5]
    for bad in ({"glad": 1.0, "negative": 1.0, "neutral": 1.0}, {"negative": 1.0}):
        column = F.create_map(*[F.lit(x) for kv in bad.items() for x in kv])
        with pytest.raises(PySparkException, match="do not match"):
            one(spark, probs.normalise(column))


def test_missing_class_gets_zero(spark):
    m = F.create_map(F.lit("positive"), F.lit(1.0))
    assert one(spark, probs.from_map(m)) == [0.0, 0.0, 1.0]


@pytest.mark.parametrize(("v", "label"), [(0.0, "negative"), (1 / 3, "negative"), (0.5, "neutral"), (2 / 3, "positive"), (1.0, "positive")])
def test_thresholds(spark, v, label):
    assert one(spark, labels.valence_to_sentiment(F.lit(v))) == label
    c = one(spark, labels.threshold_confidence(F.lit(v)))
    assert 1 / 3 - 1e-9 <= c <= 1.0


def test_quadrants_and_clamp(spark):
    q = [one(spark, labels.vad_quadrant(F.lit(v), F.lit(a))) for v, a in ((0.5, 0.9), (0.2, 0.5), (0.2, 0.1))]
    assert q == ["fine", "agitated", "withdrawn"]
    got = one(spark, labels.vad_from_model_output(vec(1.4, 0.3, -0.2)))
    assert tuple(got) == (0.0, 1.0, 0.3)


def test_parameter_guards():
    for bad in ((0.5, 0.5), (-0.1, 0.5), (0.2, 1.2)):
        with pytest.raises(ValueError):
            check_thresholds(*bad)
    for bad in ((1.1, 1.0), (0.5, 0.0)):
        with pytest.raises(ValueError):
            check_fusion(*bad)


def test_prediction_contract(spark):
    rows = spark.createDataFrame(
        [
            ({"negative": 0.2, "neutral": 0.3, "positive": 0.5}, 0.5, 0.4),
            ({"negative": 0.2, "neutral": 0.3, "positive": 0.6}, 0.6, 1.2),
            ({"negative": 0.2, "neutral": 0.8}, 0.3, 0.1),
        ],
        "probs map<string,double>, confidence double, valence double",
    )
    got = prediction_checks(rows, [], vad="valence").first()
    assert tuple(got) == (1, 1, 1, 1)


def test_arrays(spark):
    assert one(spark, arrays.rms(vec(3, 4, 0, 0))) == pytest.approx(2.5)
    assert one(spark, arrays.peak_normalise(vec(0.5, -0.25))) == pytest.approx([0.95, -0.475])
    assert one(spark, arrays.peak_normalise(vec(1e-7, 0))) == [1e-7, 0.0]
    assert one(spark, arrays.to_mono(F.array(vec(1, 3), vec(0, 0)))) == [2.0, 0.0]
    assert one(spark, arrays.duration_s(F.array_repeat(F.lit(0.0), 8000))) == 0.5
    assert one(spark, arrays.semitones(F.lit(200.0))) == pytest.approx(12)
    top = one(spark, arrays.describe_topk(vec(1, float("nan"), -3, 3), 2, F.array(*map(F.lit, "abcd"))))
    assert [(t["name"], t["value"]) for t in top] == [("c", -3.0), ("d", 3.0)]


def test_voice(spark):
    inputs = {n: F.lit(1.0) for n in ("cpps", "hnr", "shimmer_local", "shimmer_local_db", "slope", "tilt")}
    want = (3.295 - 0.111 - 0.073 - 0.213 + 2.789 - 0.032 + 0.077) * 2.571
    assert one(spark, voice.avqi(**inputs)) == pytest.approx(min(want, 10.0))
    inputs["slope"] = F.lit(None).cast("double")
    assert one(spark, voice.avqi(**inputs)) is None
    assert one(spark, voice.is_whispered(F.lit(5.0), F.lit(2.0))) is True
    assert one(spark, voice.is_whispered(F.lit(5.1), F.lit(0.0))) is False
    assert one(spark, voice.speech_rate(F.lit("abcd"), F.lit(2.0))) == 2.0
    assert one(spark, voice.speech_rate(F.lit("abcd"), F.lit(0.0))) == 0.0


def test_request_guard(spark):
    rows = spark.createDataFrame([(0, 16000), (2_880_001, 16000), (10, 0), (10, 16000)], "n int, r int")
    got = [r[0] for r in rows.select(filters.request_problem(F.col("n"), F.col("r"))).collect()]
    assert got == ["no audio submitted", "clip too long", "invalid sample rate", None]


def test_contour_on_a_ramp(spark):
    rows = [("a", float(t), 100.0 * 2 ** (t / 12), -10.0 - t, 5.0) for t in range(5)]
    rows += [("a", 5.0, 0.0, -80.0, -200.0), ("b", 0.0, 0.0, -80.0, -200.0)]
    df = spark.createDataFrame(rows, "clip_id string, t double, f0_hz double, intensity_db double, hnr double")
    got = {r["clip_id"]: r for r in frames.contour_features(df).collect()}
    a, b = got["a"], got["b"]
    assert a["f0_slope_st_per_s"] == pytest.approx(1.0)
    assert a["energy_slope_db_per_s"] == pytest.approx(-1.0)
    assert a["f0_iqr_st"] == pytest.approx(2.0)
    assert a["voiced_fraction"] == pytest.approx(5 / 6)
    assert b["f0_slope_st_per_s"] is None and b["pause_ratio"] == 1.0
    hnr = {r["clip_id"]: r["hnr_mean"] for r in frames.hnr_mean(df).collect()}
    assert hnr == {"a": 5.0, "b": None}
    assert {r["clip_id"]: r["f0_mean"] for r in frames.pitch_stats(df).collect()}["b"] is None


def test_meanstd_pool(spark):
    df = spark.createDataFrame([("a", [[1.0, 10.0], [3.0, 10.0]])], "clip_id string, frames array<array<double>>")
    assert frames.meanstd_pool(df).first()["features"] == [2.0, 10.0, 1.0, 0.0]


def test_undefined_is_null(spark):
    one_pair = spark.createDataFrame([(1.0, 2.0)], "v_a double, v_b double")
    assert summaries.test_retest(one_pair, ["v"]).first()["r_v"] is None
    df = spark.createDataFrame([("happy", 1.0), ("sad", 0.0)], "emotion string, v double")
    assert summaries.sentiment_ordering(df, "emotion", "v").first()["ordering_holds"] is None
    draws = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    got = summaries.draw_aggregate(draws, [], "v").first()
    assert (got["mean"], got["std"], got["n_draws"]) == (2.0, 1.0, 2)
