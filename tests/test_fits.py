import numpy as np
import pytest
from conftest import clip_rows
from pyspark.sql import functions as F

from tonemark.operators import bootstrap, calibration, experiments, joins, learn, metrics
from tonemark.schema import LABELS

NEG, NEU, POS = LABELS


def uar(true, predicted):
    true, predicted = np.array(true), np.array(predicted)
    return np.mean([(predicted[true == c] == c).mean() for c in LABELS if (true == c).any()])


def test_threshold_grid_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.uniform(0, 1, 60), 3).tolist() + [0.0, 1.0, 0.5, 0.075, 0.35]
    y = [LABELS[i] for i in rng.integers(0, 3, len(v))]
    df = spark.createDataFrame(list(zip(v, y)), "valence double, prosody_sentiment string")
    points, best, want = np.linspace(0, 1, 41), -1.0, None
    for i, low in enumerate(points):
        for high in points[i + 1 :]:
            p = [NEG if x <= low else POS if x >= high else NEU for x in v]
            s = uar(y, p)
            if s > best + 1e-12:
                best, want = s, (low, high)
    got = calibration.fit_valence_thresholds(df).first()
    assert (got["low"], got["high"]) == pytest.approx(want)
    assert got["uar"] == pytest.approx(best)
    assert calibration.valence_threshold_scores(df).count() == 820


def test_fusion_fit_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.dirichlet([1, 1, 1], 80), rng.dirichlet([1, 1, 1], 80)
    y = rng.integers(0, 3, 80)
    rows = [(LABELS[t], [float(x) for x in p], [float(x) for x in q]) for t, p, q in zip(y, a, b)]
    df = spark.createDataFrame(rows, "prosody_sentiment string, probs_a array<double>, probs_b array<double>")

    def fuse(w, t):
        logit = (w * np.log(a.clip(1e-9, 1)) + (1 - w) * np.log(b.clip(1e-9, 1))) / t
        e = np.exp(logit - logit.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    scores = [(w, np.mean([(fuse(w, 1).argmax(1)[y == c] == c).mean() for c in range(3)])) for w in np.linspace(0, 1, 21)]
    best = max(s for _, s in scores)
    weight = next(w for w, s in scores if s > best - 1e-12)
    temps = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
    temperature = min(temps, key=lambda t: -np.log(fuse(weight, t)[np.arange(80), y].clip(1e-9)).sum())
    cut = np.quantile(fuse(weight, temperature).max(1), 0.1)
    got = calibration.fit_fusion_params(df).first()
    assert tuple(got) == pytest.approx((weight, temperature, cut))
    with pytest.raises(ValueError, match="empty"):
        calibration.fit_fusion_params(df.limit(0))


def test_bootstrap_matches_row_resampling(spark):
    rng = np.random.default_rng(0)
    true = [LABELS[i] for i in rng.integers(0, 3, 120)]
    text = [LABELS[i] for i in rng.integers(0, 3, 120)]
    pred = [t if rng.random() < 0.6 else x for t, x in zip(true, text)]
    rows = clip_rows(spark, list(zip(text, true, pred)))
    got = bootstrap.bootstrap_ci(rows, [], n_boot=2000).first()
    t, x, p = map(np.array, (true, text, pred))
    uars, psis = [], []
    for _ in range(2000):
        i = rng.integers(0, 120, 120)
        uars.append(uar(t[i], p[i]))
        tone = ((p[i] == t[i]) & (t[i] != x[i])).sum()
        words = ((p[i] == x[i]) & (t[i] != x[i])).sum()
        psis.append(tone / (tone + words))
    want = [*np.percentile(uars, [2.5, 97.5]), *np.percentile(psis, [2.5, 97.5])]
    assert [got[c] for c in ("uar_lo", "uar_hi", "psi_lo", "psi_hi")] == pytest.approx(want, abs=0.025)
    again = bootstrap.bootstrap_ci(rows.repartition(3), [], n_boot=2000).first()
    assert again == got


def test_bootstrap_edges(spark):
    perfect = clip_rows(spark, [(c, c, c) for c in LABELS for _ in range(8)])
    got = bootstrap.bootstrap_ci(perfect, []).first()
    assert got["uar_hi"] == 1.0 and got["uar_lo"] > 0.9
    assert got["psi_lo"] is None and got["psi_hi"] is None and got["n_boot"] == 2000

    def width(n):
        rows = [(c, c, c if i % 4 else NEG) for c in LABELS for i in range(n)]
        r = bootstrap.bootstrap_ci(clip_rows(spark, rows), []).first()
        return r["uar_hi"] - r["uar_lo"]

    assert width(4) / width(40) > 1.5


def blobs(spark, n=90, d=4, gap=3.0, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = i % 3
        x = rng.normal(size=d)
        x[0] += gap * k
        split = "train" if i < n * 0.6 else "val" if i < n * 0.8 else "test"
        text = LABELS[(i // 3) % 3]
        rows.append((f"c{i}", f"s{i % 9}", f"t{(i // 3) % 5}", text, LABELS[k], text == LABELS[k], split, x.tolist(), i))
    return spark.createDataFrame(
        rows,
        "clip_id string, speaker_id string, text string, text_sentiment string, prosody_sentiment string, "
        "is_congruent boolean, split string, features array<double>, vec_id bigint",
    )


def test_logreg_is_the_optimum(spark):
    df = blobs(spark, gap=1.0)
    model = learn.fit(df, 4)["logreg"]
    rows = df.collect()
    x = np.array([r["features"] for r in rows])
    x = (x - x.mean(0)) / x.std(0)
    y = np.array([LABELS.index(r["prosody_sentiment"]) for r in rows])
    w, b = model.notes["coefficients"], model.notes["intercepts"]
    logit = x @ w.T + b
    p = np.exp(logit - logit.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    # Gradient of half the squared norm plus the summed losses (weights are 1 here).
    gradient = w + (p - np.eye(3)[y]).T @ x
    assert np.abs(gradient).max() < 1e-5
    scored = {r["clip_id"]: r for r in model.score(df).collect()}
    assert [scored[f"c{i}"]["probs"] for i in range(5)] == [pytest.approx(q, abs=1e-6) for q in p[:5].tolist()]


def test_every_candidate_learns(spark):
    df = blobs(spark)
    train, test = df.where("split <> 'test'"), df.where("split = 'test'")
    models = learn.fit(train, 4, ["logreg", "linear_svm", "svm_rbf", "hist_gbdt", "mlp"])
    scores = learn.candidate_scores(models, test).collect()
    assert {r["model"] for r in scores} == set(models)
    assert all(r["uar"] > 0.7 for r in scores)
    vectors = learn.score_all(models, test).select("probs").collect()
    assert all(sum(r[0]) == pytest.approx(1) for r in vectors)
    table = learn.top_features(learn.importance_table(spark, models["hist_gbdt"], list("abcd")), 1)
    assert table.first()["name"] == "a"


def test_unseen_class_gets_zero_mass(spark):
    df = blobs(spark).where("prosody_sentiment <> 'neutral'")
    scored = learn.fit(df, 4)["logreg"].score(df).first()
    assert scored["probs"][1] == 0.0 and sum(scored["probs"]) == pytest.approx(1)


def test_medians_come_from_training_rows(spark):
    rows = [("a", [1.0, float("nan")]), ("b", [3.0, 2.0]), ("c", [4.0, 8.0])]
    train = spark.createDataFrame(rows, "clip_id string, features array<double>")
    other = spark.createDataFrame([("z", [float("nan"), float("nan")])], train.schema)
    medians = calibration.median_vector(train, 2)
    assert calibration.impute(other, medians).first()["features"] == [3.0, 5.0]
    assert learn.has_gaps(train) and not learn.has_gaps(train.where("clip_id <> 'a'"))
    scaled = calibration.standard_scale(train.where("clip_id <> 'a'"), train.where("clip_id <> 'a'"), 2)
    assert sorted(r["features"] for r in scaled.collect()) == [[-1.0, -1.0], [1.0, 1.0]]


def test_leave_group_out(spark):
    df = blobs(spark)
    predicted = learn.leave_group_out(df, "text", 4, balanced=False)
    got = learn.recoverability(predicted, "prosody_sentiment").first()
    assert got["n"] == 90 and got["n_folds"] == 5 and got["accuracy"] > 0.7
    # One group leaves nothing to train on: no predictions, an undefined accuracy.
    alone = learn.leave_group_out(df.where("text = 't0'"), "text", 4, balanced=False)
    assert alone.collect() == []
    none = learn.recoverability(alone, "prosody_sentiment").first()
    assert none["accuracy"] is None and none["n"] == 0
    # One fold for every group, however many there are; rows with gaps take no part.
    many = df.withColumn("g", F.col("vec_id") % 40)
    gappy = F.transform("features", lambda x: F.when(F.col("vec_id") == 3, F.lit(float("nan"))).otherwise(x))
    folds = learn.leave_group_out(many.withColumn("features", gappy), "g", 4, balanced=True)
    assert folds.count() == 89 and folds.select("fold").distinct().count() == 40
    assert learn.incomplete(many.withColumn("features", gappy)).first()[0] == 1


def test_gaps_are_filled_per_fold(spark):
    """Every row is scored; a fold's fill is the median of its own training rows."""
    df = blobs(spark)
    missing = F.lit(None).cast("double")
    gaps = F.transform("features", lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i == 1), missing).otherwise(x))
    got = learn.leave_group_out(df.withColumn("features", gaps), "text", 4, balanced=True, gaps="impute")
    assert got.count() == 90
    filled = None
    for fold in sorted(r[0] for r in df.select("text").distinct().collect()):
        held = df.where(F.col("text") == fold)
        train = df.where((F.col("text") != fold) & (F.col("vec_id") % 7 != 0))
        middle = train.agg(F.expr("median(features[1])")).first()[0]
        fill = F.transform("features", lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i == 1), F.lit(middle)).otherwise(x))
        model = learn.fit(df.where(F.col("text") != fold).withColumn("features", fill), 4)["logreg"]
        part = model.score(held.withColumn("features", fill)).select("clip_id", "sentiment")
        filled = part if filled is None else filled.unionByName(part)
    assert dict(filled.collect()) == {r["clip_id"]: r["predicted"] for r in got.collect()}
    with pytest.raises(ValueError, match="gaps"):
        learn.leave_group_out(df, "text", 4, balanced=True, gaps="keep")


def test_single_class_folds(spark):
    # Without t0 only one class is left to train on.
    df = blobs(spark, n=30).where("text = 't0' OR (text = 't1' AND prosody_sentiment = 'negative')")
    skipped = learn.leave_group_out(df, "text", 4, balanced=True, single_class="skip")
    assert {r[0] for r in skipped.select("fold").collect()} == {"t1"}
    kept = learn.leave_group_out(df, "text", 4, balanced=True, single_class="predict")
    assert {r["predicted"] for r in kept.where("fold = 't0'").collect()} == {"negative"}


def test_whisper_thresholds(spark):
    df = spark.createDataFrame([(10.0, 2.0, False), (2.0, 1.0, True), (4.0, 1.0, True)], "hnr double, loudness double, w boolean")
    assert tuple(calibration.fit_whisper_thresholds(df, F.col("w")).first()) == (6.5, 1.5)
    with pytest.raises(Exception, match="both groups"):
        calibration.fit_whisper_thresholds(df.where("w"), F.col("w")).collect()


def test_no_combination_scores_a_training_speaker(spark):
    df = blobs(spark, n=180)
    base = df.where("speaker_id IN ('s0','s1','s2','s3','s4')").withColumn(
        "split", F.when(F.col("speaker_id") == "s4", "test").otherwise("train")
    )
    first = df.where("speaker_id IN ('s5','s6')")
    second = df.where("speaker_id IN ('s6','s7')")  # shares s6 with the first
    got = {(r["train_set"], r["eval_set"]): r for r in experiments.combos(base, first, second, width=4, n_boot=50).collect()}
    assert len(got) == 12
    assert got["base_first", "first"]["excluded_reason"] and got["base_first", "first"]["uar"] is None
    assert got["base_first", "second"]["n_shared"] == 1
    assert got["base_only", "second"]["uar"] is not None
    assert all(got[t, "base_test"]["n_shared"] == 0 for t, e in got if e == "base_test")


def test_normalisation_experiment_reports_changes(spark):
    df = blobs(spark)
    out = experiments.normalisation(df.where("split = 'train'"), {"test": df.where("split = 'test'")}, 4, ["logreg"]).collect()
    by = {r["scheme"]: r for r in out}
    assert set(by) == {"raw", "dataset_z", "speaker_z", "speaker_z_loo"}
    assert by["raw"]["delta"] is None
    assert by["speaker_z"]["delta"] == pytest.approx(by["speaker_z"]["uar"] - by["raw"]["uar"])


def test_evaluation_matrix_lists_every_pair(spark):
    train = spark.createDataFrame([("a", "s1"), ("b", "s2")], "train_set string, speaker_id string")
    evals = spark.createDataFrame([("x", "s1"), ("y", "s3")], "eval_set string, speaker_id string")
    got = {(r[0], r[1]): r["n_shared"] for r in joins.evaluation_matrix(train, evals).collect()}
    assert got == {("a", "x"): 1, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 0}
    assert metrics is not None


def test_candidates_train_on_rows_with_gaps(spark):
    df = blobs(spark).withColumn(
        "features", F.transform("features", lambda x: F.when(F.col("vec_id") % 13 == 0, F.lit(float("nan"))).otherwise(x))
    )
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    models = learn.fit(train, 4, ["logreg", "linear_svm", "svm_rbf", "mlp"])
    scores = learn.candidate_scores(models, test).collect()
    assert len(scores) == 4 and all(r["uar"] > 0.6 for r in scores)
    out = experiments.normalisation(train, {"test": test}, 4, ["logreg"]).collect()
    assert len(out) == 4 and all(r["uar"] is not None for r in out)


def test_scaled_rows_take_the_models_of_raw_ones(spark, monkeypatch):
    """`dataset_z` was fitted anew, though every fit scales its rows itself."""
    df = blobs(spark)
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    scaled = experiments.normalise(train, "dataset_z", 4)
    apart = learn.fit(scaled, 4, ["logreg"])["logreg"].score(test)
    shared = learn.standardised(learn.fit(train, 4, ["logreg"]))["logreg"].score(test)
    probs = {r["clip_id"]: r["probs"] for r in apart.collect()}
    rows = shared.collect()
    assert rows and all(r["probs"] == pytest.approx(probs[r["clip_id"]], abs=1e-6) for r in rows)
    fits, fit = [], learn.fit
    monkeypatch.setattr(learn, "fit", lambda *a: fits.append(a) or fit(*a))
    assert len(experiments.normalisation(train, {"test": test}, 4, ["logreg"]).collect()) == 4
    assert len(fits) == 2
    # A dimension that scaling takes as constant is none to a fit: both are fitted.
    faint = F.transform("features", lambda x, i: F.when(i == 0, x * 1e-12).otherwise(x))
    assert learn.standardised(fit(train.withColumn("features", faint), 4, ["logreg"])) is None


def test_fits_read_as_many_partitions_as_their_rows_are_worth(spark, monkeypatch):
    """every iteration ran a task per file of the input, however small."""
    train = blobs(spark).repartition(7)
    weights, n = learn.class_weights(train)
    prep = learn.fit_preprocessing(train, 4)
    for rows, tasks in ((50_000, 1), (-(-n // 3), 3)):
        monkeypatch.setattr(learn, "TASK_ROWS", rows)
        frame = learn.training_frame(train, prep, weights, n=n)
        assert frame.rdd.getNumPartitions() == tasks and frame.count() == n
        frame.unpersist()
