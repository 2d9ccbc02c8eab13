"""Model fitting, scoring and experiment queries over the feature view."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tonemark.operators import experiments, learn, metrics, ranking, scoring
from tonemark.operators.scale import one_row
from tonemark.plans.label_queries import DOC_SCORES, vad_view
from tonemark.plans.registry import query
from tonemark.plans.shape import tidy
from tonemark.plans.views import TEXTS, with_
from tonemark.schema import LABELS

WIDTH = 64
NAMES = [f"f{i}" for i in range(WIDTH)]
CANDIDATES = ["logreg", "linear_svm", "svm_rbf", "hist_gbdt"]
SCORES = ["n_clips", "uar", "macro_f1", "psi_contested", "psi_strict"]


def sets(v):
    f = v.features
    return f.where("split = 'train'"), f.where("split = 'val'"), f.where("split = 'test'")


def scored_summary(rows, keys):
    return tidy(metrics.summarise(rows, keys, SCORES))


@query("logreg_probe")
def _(v):
    train, _, _ = sets(v)
    model = learn.fit(train, WIDTH)["logreg"]
    return scored_summary(model.score(v.features), ["split"])


@query("mlp_fallback")
def _(v):
    train, val, _ = sets(v)
    model, scores = learn.with_mlp_fallback(train, val, WIDTH)
    rows = model.score(v.features).withColumn("model", F.lit(model.name))
    return scored_summary(rows, ["model", "split"])


@query("mlp_probe")
def _(v):
    train, _, _ = sets(v)
    return scored_summary(learn.fit(train, WIDTH, ["mlp"])["mlp"].score(v.features), ["split"])


@query("linear_svm")
def _(v):
    train, _, _ = sets(v)
    model = learn.fit(train, WIDTH, ["linear_svm"])["linear_svm"]
    return scored_summary(model.score(v.features), ["split"])


@query("boosted_trees")
def _(v):
    train, _, _ = sets(v)
    model = learn.fit(train, WIDTH, ["hist_gbdt"])["hist_gbdt"]
    return scored_summary(model.score(v.features), ["split"])


@query("rbf_approx")
def _(v):
    train, _, _ = sets(v)
    model = learn.fit(train, WIDTH, ["svm_rbf"])["svm_rbf"]
    return scored_summary(model.score(v.features), ["split"])


@query("train_select_prosodic")
def _(v):
    train, val, _ = sets(v)
    models = learn.fit(train, WIDTH, CANDIDATES)
    scores = learn.candidate_scores(models, val).withColumn("experiment", F.lit("prosodic"))
    best = ranking.select_best(scores, ["experiment"], "model", "uar", "candidate_order")
    joined = scores.join(best.select("experiment", "selected"), "experiment")
    return tidy(
        joined.select(
            "model",
            "n_clips",
            "uar",
            "macro_f1",
            (F.col("model") == F.col("selected")).alias("is_selected"),
            scoring.suspicious(F.col("uar")).alias("suspicious"),
        )
    )


@query("batch_score")
def _(v):
    train, _, _ = sets(v)
    scored = learn.fit(train, WIDTH)["logreg"].score(v.features)
    p = F.col("probs")
    return tidy(
        scored.select(
            "clip_id",
            "sentiment",
            "confidence",
            *[p[i].alias(f"prob_{x[:3]}") for i, x in enumerate(LABELS)],
        ),
        4,
    )


@query("feature_importance")
def _(v):
    train, _, _ = sets(v)
    model = learn.fit(train, WIDTH)["logreg"]
    return tidy(learn.importance_table(v.spark, model, NAMES), 4)


@query("top_features")
def _(v):
    train, _, _ = sets(v)
    model = learn.fit(train, WIDTH, ["hist_gbdt"])["hist_gbdt"]
    return tidy(learn.top_features(learn.importance_table(v.spark, model, NAMES)), 4)


@query("logo_recoverability")
def _(v):
    descriptors = v.features.withColumn("features", F.slice("features", 1, 9))
    predicted = learn.leave_group_out(descriptors, "text", 9, balanced=False)
    return tidy(
        learn.recoverability(predicted, "prosody_sentiment")
        .withColumn("chance", F.lit(1 / 3))
        .withColumn("n_dropped_missing_features", one_row(learn.incomplete(descriptors)).getField("n_dropped_missing_features"))
    )


@query("logo_uar")
def _(v):
    parts = []
    for name, vector in {
        "head": F.slice("features", 1, 16),
        "tail": F.slice("features", 17, 48),
    }.items():
        width = 16 if name == "head" else 48
        rows = v.features.withColumn("features", vector)
        predicted = learn.leave_group_out(
            rows, "text", width, balanced=True, single_class="predict", gaps="impute"
        )
        parts.append(
            predicted.select(
                F.lit(name).alias("representation"),
                "prosody_sentiment",
                F.col("predicted").alias("sentiment"),
                F.col("prosody_sentiment").alias("text_sentiment"),
            )
        )
    rows = parts[0].unionByName(parts[1])
    return tidy(metrics.summarise(rows, ["representation"], ["n_clips", "uar"]))


@query("kmeans_best_k")
def _(v):
    points = vad_view(v).select(
        "clip_id", array_to_vector(F.array("valence", "arousal")).alias("x")
    )
    return tidy(learn.best_k(points))


@query("normalisation_experiment")
def _(v):
    train, val, test = sets(v)
    result = experiments.normalisation(train, {"val": val, "test": test}, WIDTH, CANDIDATES)
    return tidy(result)


@query("skew_experiment")
def _(v):
    train, val, test = sets(v)
    return tidy(experiments.skew(train, test, WIDTH, ["logreg", "linear_svm", "hist_gbdt"]))


@query("combo_experiment")
def _(v):
    base, first, second, outside = corpora(v)
    voice = F.col("vec_id") % 2 == 0
    train = "split = 'train'"
    train_sets = {
        "base": base.where(train),
        "second": second.where(train),
        "first": first.where(voice),
        "first_second": first.where(voice).unionByName(second.where(train)),
        "all": base.where(train).unionByName(first.where(voice)).unionByName(second.where(train)),
    }
    eval_sets = {
        "base_test": base.where("split = 'test'"),
        "second_val": second.where("split = 'val'"),
        "second_test": second.where("split = 'test'"),
        "first_held_out": first.where(~voice),
        "first_train": first.where(voice),
        "outside": outside,
    }
    return tidy(
        experiments.training_matrix(train_sets, eval_sets, width=WIDTH, exclude=["outside"])
    )


@query("zero_shot_vs_retrained")
def _(v):
    # Two corpora that together hold every vector.
    first = F.col("label").isin(0, 2, 4, 6, 8)
    base, extra = v.features.where(first), v.features.where(~first)
    return tidy(experiments.zero_shot_vs_retrained(base, extra, width=WIDTH))


def corpora(v):
    """Four corpora of the feature view: by voice group of the speaker."""
    group = F.col("vec_id") % 20
    base = v.features.where(group < 10)
    first = v.features.where((group >= 10) & (group < 14))
    second = v.features.where((group >= 14) & (group < 18))
    return base, first, second, v.features.where(group >= 18)


def _length_scores(series):
    out = []
    for text in series:
        n = len(text)
        out.append(
            {"negative": 1.0 + n % 7, "neutral": 1.0 + n % 11, "positive": 1.0 + n % 13}
        )
    return out


@query(
    "scorer_udf",
    with_(TEXTS, DOC_SCORES.replace("n_chars", "length(text)"))
    + """SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 'negative' WHEN b >= c THEN 'neutral'
        ELSE 'positive' END AS sentiment, round(greatest(a,b,c)/(a+b+c), 6) AS confidence FROM sc""",
)
def _(v):
    rows = v.table("documents").select(
        F.col("doc_id").cast("string").alias("clip_id"), F.col("text").alias("payload")
    )
    scored = scoring.score_with(rows, _length_scores, "length")
    return tidy(
        scored.select(F.col("clip_id").cast("bigint").alias("doc_id"), "sentiment", "confidence")
    )
