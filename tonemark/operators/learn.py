"""Classifiers on feature arrays, fitted with Spark ML.

Where Spark ML's defaults mean something else than the wanted estimator (scaling
by the sample deviation, approximate medians, no probabilities) the missing
piece is computed here with DataFrame operations. Independent fits of one call
run as concurrent Spark jobs over the same persisted frame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark import fixed_values as fixed
from tonemark.functions.hashing import HASH_SPACE, stable_hash
from tonemark.functions.labels import literal_map
from tonemark.operators import metrics
from tonemark.operators.folded import Linear
from tonemark.operators.medians import vector_medians
from tonemark.operators.normalise import EPS, feature_stats
from tonemark.operators.scale import global_order
from tonemark.operators.scoring import prediction_columns
from tonemark.schema import LABELS
from tonemark.sources.storage import new_path

LABEL = "prosody_sentiment"
PARALLEL_FITS = 8
# Labelled rows of one leave-one-group-out fit: more are thinned by hash.
FIT_ROWS = 1_000_000
# Rows of one task of a fit. Iterative fits run thousands of short jobs whose cost is their
# tasks, and many run at a time: more tasks a job only pay once a task has this many rows.
TASK_ROWS = 50_000


def fit_tasks(n: int) -> int:
    """Partitions of a table of n rows that a fit reads over and over."""
    return max(1, -(-n // TASK_ROWS))


def standardised(models: dict[str, Classifier]) -> dict[str, Classifier] | None:
    """The same models for rows that were scaled by their training set's figures beforehand.

    Fits scale their rows, so they see the same vectors either way and need not run twice.
    None where that does not hold: gaps, or a dimension that scaling takes as constant.
    """
    preps = [m.prep for m in models.values()]
    if any(p.medians is not None or any(0 < s < EPS for s in p.stds) for p in preps):
        return None
    unit = Preprocessing(None, [0.0] * len(preps[0].means), [1.0] * len(preps[0].means))
    return {name: replace(m, prep=unit, linear=None) for name, m in models.items()}


def in_parallel(jobs: Sequence[Callable[[], object]]) -> list:
    if len(jobs) == 1:
        return [jobs[0]()]
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return list(pool.map(lambda job: job(), jobs))


@dataclass
class Preprocessing:
    """Training-set medians, means and deviations, one number per dimension each."""

    medians: list[float] | None
    means: list[float]
    stds: list[float]

    def apply(self, df: DataFrame, features: str = "features") -> DataFrame:
        fill, means = self.medians, np.array(self.means)
        stds = np.array([s if s > 0 else 1.0 for s in self.stds])

        @F.pandas_udf("array<double>")
        def prepare(x: pd.Series) -> pd.Series:
            if len(x) == 0:
                return pd.Series([], dtype=object)
            v = np.stack([np.asarray(row, dtype=np.float64) for row in x])
            if fill is not None:
                v = np.where(np.isnan(v), np.array(fill), v)
            return pd.Series(list((v - means) / stds))

        return df.withColumn("_x", prepare(features))


def has_gaps(df: DataFrame, features: str = "features") -> bool:
    gap = F.exists(features, lambda v: v.isNull() | F.isnan(v))
    return not df.where(gap).select(F.lit(1)).isEmpty()


def fit_preprocessing(train: DataFrame, width: int, *, impute: bool = False) -> Preprocessing:
    medians = None
    rows = train
    if impute:
        medians = [0.0 if m is None else m for m in vector_medians(train, width)]
        missing = F.lit(None).cast("double")
        rows = train.withColumn(
            "features",
            F.zip_with(
                "features", F.lit(medians), lambda v, m: F.coalesce(F.nanvl(v, missing), m)
            ),
        )
    s = feature_stats(rows, [], width).first()
    return Preprocessing(medians, list(s["_mean"]), list(s["_std"]))


@dataclass
class Classifier:
    """A fitted model: preprocessing plus class probabilities as a column."""

    name: str
    classes: list[str]
    prep: Preprocessing
    add_probs: Callable[[DataFrame], DataFrame]
    importances: list[float] | None = None
    notes: dict[str, object] = field(default_factory=dict)
    linear: Linear | None = None

    def score(self, df: DataFrame) -> DataFrame:
        """Add sentiment, probs (canonical order, 0 for unseen classes) and confidence."""
        keep = df.columns
        raw = self.add_probs(self.prep.apply(df))
        slots = [
            F.col("_p")[self.classes.index(c)] if c in self.classes else F.lit(0.0)
            for c in LABELS
        ]
        out = [c for c in keep if c not in ("sentiment", "probs", "confidence")]
        vector = raw.select(*out, F.array(*slots).alias("_v"))
        return vector.select(*out, *prediction_columns(F.col("_v")))


def class_weights(train: DataFrame, label: str = LABEL) -> tuple[dict[str, float], int]:
    """Balanced weights n / (k * n_c), in canonical class order, and n."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    total = sum(counts.values())
    order = [c for c in LABELS if c in counts] + sorted(set(counts) - set(LABELS))
    return {c: total / (len(counts) * counts[c]) for c in order}, total


def training_frame(
    train: DataFrame,
    prep: Preprocessing,
    weights: dict[str, float],
    label: str = LABEL,
    balanced: bool = True,
    n: int | None = None,
) -> DataFrame:
    """The pruned frame every fit of a call reads: id, label index, weight, vector; in as many
    partitions as its `n` rows are worth."""
    classes = F.array(*[F.lit(c) for c in weights])
    w = F.element_at(literal_map(weights), F.col(label)) if balanced else F.lit(1.0)
    kept = prep.apply(train).select(
        "clip_id",
        (F.array_position(classes, F.col(label)) - 1).cast("double").alias("y"),
        w.alias("w"),
        "_x",
        array_to_vector("_x").alias("x"),
    )
    if n is not None:
        kept = kept.coalesce(fit_tasks(n))
    return kept.persist(StorageLevel.MEMORY_AND_DISK)


def _logreg(frame: DataFrame, total_weight: float, column: str = "x", max_iter: int = 2000):
    # Half the squared norm plus the weighted losses, divided by the weights.
    return LogisticRegression(
        featuresCol=column,
        labelCol="y",
        weightCol="w",
        family="multinomial",
        regParam=1.0 / total_weight,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=1e-12,
    ).fit(frame)


def canonical(classes: Sequence[str]) -> list[int]:
    """Place of each known class among those a model has; -1 for one it does not have."""
    return [list(classes).index(c) if c in classes else -1 for c in LABELS]


def linear_form(prep: Preprocessing, weights: np.ndarray, bias: np.ndarray, head: Callable) -> Linear | None:
    """Scores as a linear form of the features before scaling; None where gaps are filled first."""
    if prep.medians is not None:
        return None
    stds = np.array([s if s > 0 else 1.0 for s in prep.stds])
    scaled = weights / stds
    return Linear(scaled, bias - scaled @ np.array(prep.means), head)


def logit_head(places: Sequence[int]) -> Callable[[np.ndarray], np.ndarray]:
    """Class scores of logits: an unseen class is never the largest."""

    def head(scores: np.ndarray) -> np.ndarray:
        lowest = np.full(scores.shape[:-1], -np.inf)
        return np.stack([scores[..., k] if k >= 0 else lowest for k in places], axis=-1)

    return head


def platt_head(places: Sequence[int], slopes: np.ndarray, offsets: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Mean over the folds of their calibrated margins, which are made to sum to one in a fold."""

    def head(scores: np.ndarray) -> np.ndarray:
        margins = scores.reshape(*scores.shape[:-1], *slopes.shape)
        with np.errstate(over="ignore"):
            p = 1.0 / (1.0 + np.exp(-(margins * slopes + offsets)))
        p = (p / p.sum(axis=-1, keepdims=True)).mean(axis=-2)
        return np.stack([p[..., k] if k >= 0 else np.zeros(p.shape[:-1]) for k in places], axis=-1)

    return head


def _probability(model, column: str = "x") -> Callable[[DataFrame], DataFrame]:
    def add(df: DataFrame) -> DataFrame:
        with_x = df if column != "x" else df.withColumn("x", array_to_vector("_x"))
        return model.transform(with_x).withColumn("_p", vector_to_array("probability"))

    return add


def fit_logreg(frame, weights, prep, n) -> Classifier:
    model = _logreg(frame, n)
    magnitude = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    return Classifier(
        "logreg",
        list(weights),
        prep,
        _probability(model),
        [float(x) for x in magnitude],
        {"coefficients": model.coefficientMatrix.toArray(), "intercepts": model.interceptVector.toArray()},
        linear_form(prep, model.coefficientMatrix.toArray(), model.interceptVector.toArray(), logit_head(canonical(weights))),
    )


def fit_mlp(
    frame, weights, prep, n, hidden: int = 128, max_iter: int = 500, step: int = 25, patience: int = 2
) -> Classifier:
    """A network with early stopping: a tenth of the rows, by hash, is held out, and training
    goes on in steps until the held-out loss has not fallen for `patience` steps."""
    part = stable_hash("held", F.col("clip_id")) % 10
    held = frame.where(part == 0)
    seen = frame if held.isEmpty() else frame.where(part > 0)
    best, best_loss, start, waited = None, float("inf"), None, 0
    for _ in range(0, max_iter, step):
        trainer = MultilayerPerceptronClassifier(
            featuresCol="x",
            labelCol="y",
            layers=[len(prep.means), hidden, len(weights)],
            maxIter=step,
            seed=0,
        )
        if start is not None:
            trainer = trainer.setInitialWeights(start)
        model = trainer.fit(seen)
        start = model.weights
        right = F.element_at(vector_to_array("probability"), F.col("y").cast("int") + 1)
        loss = model.transform(held).agg(F.avg(-F.log(F.greatest(right, F.lit(1e-12))))).first()[0]
        if loss is None or loss < best_loss:
            best, best_loss, waited = model, loss if loss is not None else best_loss, 0
        else:
            waited += 1
        if waited >= patience:
            break
    return Classifier("mlp", list(weights), prep, _probability(best))


def _dot(values: Column, coefficients: Sequence[float], intercept: float) -> Column:
    products = F.zip_with(values, F.lit(list(map(float, coefficients))), lambda a, b: a * b)
    return F.aggregate(products, F.lit(float(intercept)), lambda acc, p: acc + p)


def fit_linear_svm(frame, weights, prep, n, folds: int = 3) -> Classifier:
    """One-vs-rest linear SVM; margins become probabilities by Platt scaling.

    Each fold's SVM is calibrated on the fold it has not seen; the folds'
    probabilities are averaged. Folds deal the rows of each class in turn, in hash order.
    """
    k = len(weights)
    order = [F.col("y"), stable_hash("fold", F.col("clip_id")), F.col("clip_id")]
    placed = global_order(frame.select("clip_id", "y", "w", "x"), order)
    fold = (F.col("position") % folds).alias("fold")
    # Every fit reads it several times.
    folded = placed.select("y", "w", "x", fold).coalesce(fit_tasks(n)).persist(StorageLevel.MEMORY_AND_DISK)

    def one(fold: int, c: int):
        target = (F.col("y") == float(c)).cast("double")
        seen = folded.where(F.col("fold") != fold).withColumn("t", target)
        held = folded.where(F.col("fold") == fold).withColumn("t", target)
        svc = LinearSVC(
            featuresCol="x", labelCol="t", weightCol="w", regParam=1.0 / n, maxIter=50
        ).fit(seen)
        coef, bias = svc.coefficients.toArray(), float(svc.intercept)
        margins = held.select(
            "t", "w", array_to_vector(F.array(_dot(vector_to_array("x"), coef, bias))).alias("m")
        )
        platt = LogisticRegression(
            featuresCol="m", labelCol="t", weightCol="w", maxIter=50
        ).fit(margins)
        return coef, bias, float(platt.coefficients[0]), float(platt.intercept)

    plan = [(f, c) for f in range(folds) for c in range(k)]
    fits = dict(
        zip(plan, in_parallel([lambda f=f, c=c: one(f, c) for f, c in plan]), strict=True)
    )
    folded.unpersist()

    def add(df: DataFrame) -> DataFrame:
        per_fold = []
        for f in range(folds):
            raw = []
            for c in range(k):
                coef, bias, slope, offset = fits[f, c]
                margin = _dot(F.col("_x"), coef, bias)
                raw.append(F.lit(1.0) / (F.lit(1.0) + F.exp(-(margin * slope + offset))))
            per_fold.append(F.array(*raw))
        df = df.withColumn("_f", F.array(*per_fold))
        normal = F.transform(
            "_f",
            lambda v: F.transform(
                v, lambda p: p / F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
            ),
        )
        df = df.withColumn("_f", normal)
        mean = [
            sum((F.col("_f")[f][c] for f in range(folds)), F.lit(0.0)) / F.lit(float(folds))
            for c in range(k)
        ]
        return df.withColumn("_p", F.array(*mean))

    magnitude = np.mean([np.abs(v[0]) for v in fits.values()], axis=0)
    in_order = [fits[p] for p in plan]
    slopes, offsets = (np.array([v[at] for v in in_order]).reshape(folds, k) for at in (2, 3))
    linear = linear_form(
        prep,
        np.array([v[0] for v in in_order]),
        np.array([v[1] for v in in_order]),
        platt_head(canonical(weights), slopes, offsets),
    )
    return Classifier("linear_svm", list(weights), prep, add, [float(x) for x in magnitude], linear=linear)


def fit_boosted_trees(frame, weights, prep, n, rounds: int = 100) -> Classifier:
    """One boosted ensemble per class against the rest, probabilities rescaled to one."""

    def one(c: int):
        t = frame.withColumn("t", (F.col("y") == float(c)).cast("double"))
        model = GBTClassifier(
            featuresCol="x",
            labelCol="t",
            weightCol="w",
            maxIter=rounds,
            maxDepth=4,
            seed=0,
            predictionCol=f"_g{c}",
        ).fit(t)
        return model.setRawPredictionCol(f"_r{c}").setProbabilityCol(f"_q{c}")

    models = in_parallel([lambda c=c: one(c) for c in range(len(weights))])

    def add(df: DataFrame) -> DataFrame:
        df = df.withColumn("x", array_to_vector("_x"))
        for m in models:
            df = m.transform(df)
        raw = [vector_to_array(f"_q{c}")[1] for c in range(len(models))]
        df = df.withColumn("_q", F.array(*raw))
        total = F.aggregate("_q", F.lit(0.0), lambda a, b: a + b)
        return df.withColumn("_p", F.transform("_q", lambda q: q / total))

    importance = np.mean([m.featureImportances.toArray() for m in models], axis=0)
    return Classifier("hist_gbdt", list(weights), prep, add, [float(x) for x in importance])


def random_fourier(width: int, n_features: int, gamma: float, seed: int):
    """Arrow-batched map to cosine features approximating a Gaussian kernel."""

    @F.pandas_udf("array<double>")
    def expand(x: pd.Series) -> pd.Series:
        rng = np.random.default_rng(seed)
        directions = rng.normal(0.0, np.sqrt(2 * gamma), size=(width, n_features))
        phases = rng.uniform(0.0, 2 * np.pi, size=n_features)
        if len(x) == 0:
            return pd.Series([], dtype=object)
        z = np.cos(np.stack(x.to_numpy()) @ directions + phases) * np.sqrt(2.0 / n_features)
        return pd.Series(list(z))

    return expand


def fit_rbf_approx(frame, weights, prep, n, n_features: int = 256, seed: int = 0) -> Classifier:
    """Kernel machine by random Fourier features: an approximation, named as such."""
    width = len(prep.means)
    expand = random_fourier(width, n_features, 1.0 / width, seed)
    expanded = frame.withColumn("r", array_to_vector(expand("_x"))).select("y", "w", "r")
    expanded.persist(StorageLevel.MEMORY_AND_DISK)
    model = _logreg(expanded, n, "r")
    expanded.unpersist()

    def add(df: DataFrame) -> DataFrame:
        return _probability(model, "r")(df.withColumn("r", array_to_vector(expand("_x"))))

    return Classifier("svm_rbf", list(weights), prep, add)


FITTERS = {
    "logreg": fit_logreg,
    "linear_svm": fit_linear_svm,
    "svm_rbf": fit_rbf_approx,
    "hist_gbdt": fit_boosted_trees,
    "mlp": fit_mlp,
}


def fit(
    train: DataFrame,
    width: int,
    names: Sequence[str] = ("logreg",),
    *,
    impute: bool | None = None,
) -> dict[str, Classifier]:
    """Fit the named candidates on one training set: impute, scale, classify.

    Gaps are filled with the training medians, which the models keep for scoring. Without
    `impute` being set that is done where the training rows have gaps.
    """
    if impute is None:
        impute = has_gaps(train)
    weights, n = class_weights(train)
    if len(weights) < 2:
        raise ValueError("training rows hold fewer than two classes")
    prep = fit_preprocessing(train, width, impute=impute)
    frame = training_frame(train, prep, weights, n=n)
    try:
        fitted = in_parallel([lambda f=FITTERS[x]: f(frame, weights, prep, n) for x in names])
    finally:
        frame.unpersist()
    return dict(zip(names, fitted, strict=True))


def score_all(models: dict[str, Classifier], df: DataFrame) -> DataFrame:
    """One long table of every model's predictions on the same rows."""
    out = None
    for name, model in models.items():
        rows = model.score(df).withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_mlp_fallback(train: DataFrame, val: DataFrame, width: int) -> tuple[Classifier, dict]:
    """Logistic regression, or the better of it and an MLP when it is weak on val."""
    models = fit(train, width)
    scores = {"logreg": uar_of(models["logreg"], val)}
    if scores["logreg"] is not None and scores["logreg"] < fixed.WEAK_UAR:
        models |= fit(train, width, ["mlp"])
        scores["mlp"] = uar_of(models["mlp"], val)
    best = max(scores, key=lambda k: scores[k] if scores[k] is not None else -1.0)
    return models[best], scores


def uar_of(model: Classifier, df: DataFrame) -> float | None:
    row = metrics.summarise(model.score(df), [], ["uar"]).first()
    return row[0] if row else None


def candidate_scores(models: dict[str, Classifier], val: DataFrame) -> DataFrame:
    """Validation scores of every candidate, with their position for ties."""
    order = literal_map({m: i for i, m in enumerate(models)})
    scored = metrics.summarise(score_all(models, val), ["model"], ["n_clips", "uar", "macro_f1"])
    return scored.withColumn("candidate_order", F.element_at(order, F.col("model")))


def importance_table(spark, model: Classifier, names: Sequence[str]) -> DataFrame:
    """Features by importance; empty for a model that has none."""
    rows = list(zip(names, model.importances or [], strict=False))
    return spark.createDataFrame(rows, "name string, importance double")


def top_features(table: DataFrame, k: int = 20) -> DataFrame:
    return table.orderBy(F.desc("importance"), "name").limit(k)


def complete_vectors(df: DataFrame, features: str = "features") -> DataFrame:
    """Rows whose vectors have no gap."""
    gap = F.exists(features, lambda v: v.isNull() | F.isnan(v))
    return df.where(~F.coalesce(gap, F.lit(True)))


def leave_group_out(
    df: DataFrame,
    group: str,
    width: int,
    *,
    label: str = LABEL,
    balanced: bool,
    single_class: str = "skip",
    gaps: str = "drop",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """Out-of-fold predictions, each group predicted by a model that never saw it.

    Every group is a fold; fewer than two groups give no predictions. Rows with a gap in their
    features take no part (`gaps="drop"`, `incomplete` counts them), or each fold fills them
    with the medians of its training rows (`"impute"`). A fold whose training rows hold one
    class is skipped, or predicted as that class, as asked. A fit reads at most about
    `fit_rows` labelled rows, drawn by hash.
    """
    if gaps not in ("drop", "impute"):
        raise ValueError(f"gaps are to drop or to impute, not {gaps!r}")
    filled = gaps == "impute"
    whole = (df if filled else complete_vectors(df)).where(F.col(group).isNotNull())
    kept = whole.withColumn("fold", F.col(group).cast("string"))
    path = new_path(df.sparkSession, "folds")
    kept.write.parquet(path)
    rows = df.sparkSession.read.schema(kept.schema).parquet(path)
    sizes = {r[0]: r[1] for r in rows.groupBy("fold").count().collect()}  # one fit each
    nothing = rows.limit(0).select("clip_id", "fold", label, F.lit("").alias("predicted"))
    if len(sizes) < 2:
        return nothing
    filled = filled and has_gaps(rows)
    total = sum(sizes.values())

    def one(fold: str) -> DataFrame | None:
        held, train = rows.where(F.col("fold") == fold), rows.where(F.col("fold") != fold)
        share = fit_rows / (total - sizes[fold])
        if share < 1:
            drawn = stable_hash("fit", F.col("clip_id")) < F.lit(int(share * HASH_SPACE))
            train = train.where(drawn)
        weights, n = class_weights(train, label)
        if len(weights) < 2:
            if single_class == "skip" or not weights:
                return None
            only = next(iter(weights))
            return held.select("clip_id", "fold", label, F.lit(only).alias("predicted"))
        prep = fit_preprocessing(train, width, impute=filled)
        frame = training_frame(train, prep, weights, label, balanced)
        model = _logreg(frame, n)
        frame.unpersist()
        scored = _probability(model)(prep.apply(held))
        at = F.array_position("_p", F.array_max("_p")).cast("int")
        named = F.element_at(F.array(*[F.lit(c) for c in weights]), at)
        return scored.select("clip_id", "fold", label, named.alias("predicted"))

    parts = [p for p in in_parallel([lambda f=f: one(f) for f in sorted(sizes)]) if p is not None]
    if not parts:
        return nothing
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def incomplete(df: DataFrame, features: str = "features") -> DataFrame:
    """n_dropped_missing_features: the rows that `complete_vectors` leaves out, as one row."""
    gap = F.exists(features, lambda v: v.isNull() | F.isnan(v))
    return df.agg(F.count_if(F.coalesce(gap, F.lit(True))).alias("n_dropped_missing_features"))


def recoverability(predicted: DataFrame, label: str) -> DataFrame:
    """Share of out-of-fold predictions that are right, over the scored rows; NULL without any."""
    return predicted.agg(
        F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("fold").alias("n_folds"),
    )


def best_k(points: DataFrame, min_k: int = 2, max_k: int = 10, seed: int = 0) -> DataFrame:
    """Silhouette of k-means per k (squared Euclidean), best first."""
    n = points.count()
    rows = points.select("clip_id", "x").persist(StorageLevel.MEMORY_AND_DISK)
    evaluator = ClusteringEvaluator(featuresCol="x", predictionCol="cluster")

    def one(k: int) -> tuple[int, float]:
        model = KMeans(k=k, seed=seed, featuresCol="x", predictionCol="cluster").fit(rows)
        return k, float(evaluator.evaluate(model.transform(rows)))

    scored = in_parallel([lambda k=k: one(k) for k in range(min_k, min(max_k, n - 1) + 1)])
    rows.unpersist()
    return points.sparkSession.createDataFrame(scored, "k int, silhouette double").orderBy(
        F.desc("silhouette"), "k"
    )
