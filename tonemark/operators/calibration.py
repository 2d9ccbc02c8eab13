"""Threshold, fusion and preprocessing parameters fitted as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark import fixed_values as fixed
from tonemark.functions import probs as P
from tonemark.functions.labels import literal_map
from tonemark.operators.medians import vector_medians
from tonemark.operators.metrics import metric_columns
from tonemark.operators.scale import exact_percentiles, one_row
from tonemark.schema import LABELS


def grid(n: int) -> list[float]:
    """n equally spaced points on [0, 1], stepwise as a linear space computes them."""
    step = 1.0 / (n - 1)
    return [i * step for i in range(n - 1)] + [1.0]


def valence_threshold_scores(
    rows: DataFrame, valence: str = "valence", label: str = "prosody_sentiment", n: int = 41
) -> DataFrame:
    """UAR of every (low, high) pair of grid points.

    One pass counts, per class, the rows at or below and at or above each grid
    point. Every pair's score is arithmetic on those counts.
    """
    edges = grid(n)
    v = F.col(valence)
    points = F.array(*[F.lit(e) for e in edges])
    # Position on the grid: points strictly below v, and whether v is a point.
    # Arithmetic finds the neighbourhood, comparison with its points settles it.
    near = F.least(F.greatest(F.floor(v * (n - 1)), F.lit(0)), F.lit(n - 1)).cast("int")
    around = [F.get(points, near + d) for d in (-1, 0, 1)]
    below = F.greatest(near - 1, F.lit(0))
    on = F.lit(False)
    for point in around:
        below = below + F.coalesce((point < v).cast("int"), F.lit(0))
        on = on | F.coalesce(point == v, F.lit(False))
    placed = rows.where(v.isNotNull()).select(
        F.col(label).alias("c"), below.alias("b"), on.alias("on")
    )
    tally = placed.groupBy("c", "b", "on").agg(F.count(F.lit(1)).alias("n"))

    # v <= edge[i] holds when at most i points lie strictly below v; v >= edge[i]
    # when more than i do, or when v is that point.
    at = tally.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    le = F.col("b") <= F.col("i")
    ge = (F.col("b") > F.col("i")) | (F.col("on") & (F.col("b") == F.col("i")))
    counted = at.groupBy("c", "i").agg(
        F.sum(F.when(le, F.col("n")).otherwise(F.lit(0))).alias("le"),
        F.sum(F.when(ge, F.col("n")).otherwise(F.lit(0))).alias("ge"),
        F.sum("n").alias("total"),
    )
    # n entries per class.
    ladder = counted.groupBy("c").agg(
        F.array_sort(F.collect_list(F.struct("i", "le", "ge", "total"))).alias("l")
    )
    zeros = F.array(*[F.lit(0).cast("bigint")] * n)

    def of(label: str, field: str) -> Column:
        mine = F.first(F.when(F.col("c") == label, F.col("l")), ignorenulls=True)
        return F.coalesce(F.transform(mine, lambda e: e[field]), zeros).alias(f"{field}_{label}")

    counts = ladder.agg(*[of(c, f) for c in LABELS for f in ("le", "ge", "total")])
    counts = counts.withColumns({f"n_{c}": F.col(f"total_{c}")[0] for c in LABELS})
    pairs = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 2)))).withColumn(
        "j", F.explode(F.sequence(F.col("i") + 1, F.lit(n - 1)))
    )
    lo, hi = F.col("i"), F.col("j")
    neg = F.try_divide(F.get("le_negative", lo), F.col("n_negative"))
    pos = F.try_divide(F.get("ge_positive", hi), F.col("n_positive"))
    neu = F.try_divide(
        F.col("n_neutral") - F.get("le_neutral", lo) - F.get("ge_neutral", hi), F.col("n_neutral")
    )
    recalls = F.array_compact(F.array(*[r.cast("double") for r in (neg, neu, pos)]))
    total = F.aggregate(recalls, F.lit(0.0), lambda acc, r: acc + r)
    return pairs.select(
        F.get(points, lo).alias("low"),
        F.get(points, hi).alias("high"),
        F.try_divide(total, F.size(recalls).cast("double")).alias("uar"),
    )


def fit_valence_thresholds(
    rows: DataFrame, valence: str = "valence", label: str = "prosody_sentiment", n: int = 41
) -> DataFrame:
    """The best pair; the first on the grid wins a tie. Fit on validation rows only."""
    scores = valence_threshold_scores(rows, valence, label, n)
    # Rounding makes equal scores equal whatever the order of their terms.
    key = F.struct(F.round("uar", 12), -F.col("low"), -F.col("high"))
    best = F.max_by(F.struct("low", "high", "uar"), key)
    return scores.agg(best.alias("b")).select("b.*")


def fusion_weight_scores(pairs: DataFrame, weights: Sequence[float] | None = None) -> DataFrame:
    """UAR per fusion weight; `pairs` holds probs_a, probs_b and the true label."""
    weights = weights or grid(21)
    w = F.explode(F.array(*[F.lit(x) for x in weights]))
    # Logarithms are taken once per row, and the softmax does not move the argmax.
    logs = pairs.select(
        F.col("prosody_sentiment").alias("t"),
        F.array(*[P.clipped_log(x) for x in P.entries(F.col("probs_a"))]).alias("a"),
        F.array(*[P.clipped_log(x) for x in P.entries(F.col("probs_b"))]).alias("b"),
        w.alias("weight"),
    )
    logits = P.pooled_logits(
        P.entries(F.col("a")), P.entries(F.col("b")), F.col("weight"), F.lit(1.0)
    )
    fused = logs.select("weight", "t", P.argmax_of(logits).alias("p"))
    counted = fused.groupBy("weight", "t", "p").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("x", F.col("t")).withColumn("abst", F.lit(0))
    return counted.groupBy("weight").agg(metric_columns()["uar"].alias("uar"))


def fusion_temperature_scores(
    pairs: DataFrame, weight: float, temperatures: Sequence[float] = fixed.FUSION_TEMPERATURES
) -> DataFrame:
    """Mean negative log-likelihood of the true label per temperature."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in temperatures]))
    rows = pairs.withColumn("temperature", t)
    vector = P.fuse(F.col("probs_a"), F.col("probs_b"), F.lit(weight), F.col("temperature"))
    p = P.prob_of(vector, F.col("prosody_sentiment"))
    return rows.groupBy("temperature").agg(
        F.avg(-F.log(F.greatest(p, F.lit(P.EPS)))).alias("nll")
    )


def fit_fusion_params(pairs: DataFrame, *, abstain_share: float = 0.10) -> DataFrame:
    """Weight by UAR, then temperature by likelihood, then the abstention threshold.

    Each step needs the previous parameter, so three numbers pass through the
    driver; rows never do. The pairs are kept for the three passes. Fit on
    validation rows only.
    """
    spark = pairs.sparkSession
    pairs = pairs.select("prosody_sentiment", "probs_a", "probs_b").persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        weight = (
            fusion_weight_scores(pairs)
            .agg(F.max_by("weight", F.struct(F.round("uar", 12), -F.col("weight"))))
            .first()[0]
        )
        if weight is None:
            raise ValueError("cannot fit fusion parameters on an empty validation set")
        order = {t: i for i, t in enumerate(fixed.FUSION_TEMPERATURES)}
        position = F.element_at(literal_map(order), F.col("temperature"))
        temperature = (
            fusion_temperature_scores(pairs, weight)
            .agg(F.min_by("temperature", F.struct(F.round("nll", 12), position)))
            .first()[0]
        )
        fused = P.fuse(F.col("probs_a"), F.col("probs_b"), F.lit(weight), F.lit(temperature))
        confidence = pairs.select(F.array_max(fused).alias("confidence"))
        cut = exact_percentiles(confidence, [], "confidence", {"cut": abstain_share}).first()[0]
    finally:
        pairs.unpersist()
    return spark.createDataFrame(
        [(weight, temperature, cut)],
        "weight_lexical double, temperature double, abstain_threshold double",
    )


def fit_whisper_thresholds(
    rows: DataFrame, whispered: Column, hnr: str = "hnr", loudness: str = "loudness"
) -> DataFrame:
    """Midpoint of the two groups' means; a missing group raises."""

    def mean(column: str, flag: Column) -> Column:
        return F.avg(F.when(flag, F.col(column)))

    def middle(column: str) -> Column:
        return (mean(column, ~whispered) + mean(column, whispered)) / F.lit(2.0)

    both = (F.count_if(whispered) > 0) & (F.count_if(~whispered) > 0)
    need = F.raise_error(F.lit("both groups need at least one row")).cast("double")
    return rows.agg(
        F.when(both, middle(hnr)).otherwise(need).alias("hnr_max"),
        F.when(both, middle(loudness)).otherwise(need).alias("loudness_max"),
    )


def median_vector(train: DataFrame, width: int, features: str = "features") -> Column:
    """Training medians as one array column; a dimension without values gets NULL."""
    return F.lit(vector_medians(train, width, features)).cast("array<double>")


def impute(df: DataFrame, medians: Column, features: str = "features") -> DataFrame:
    """Fill NaN and NULL entries with the training medians."""
    with_medians = df.withColumn("_fill", medians)
    fixed_up = F.zip_with(
        F.col(features),
        F.col("_fill"),
        lambda x, m: F.coalesce(F.nanvl(x, F.lit(None).cast("double")), m),
    )
    return with_medians.withColumn(features, fixed_up).drop("_fill")


def standard_scale(
    df: DataFrame, train: DataFrame, width: int, features: str = "features"
) -> DataFrame:
    """(x - mean) / population deviation, both taken from training rows."""
    from tonemark.operators.normalise import feature_stats

    s = one_row(feature_stats(train, [], width, features))
    rows = df.withColumn("_mean", s.getField("_mean")).withColumn("_std", s.getField("_std"))
    zipped = F.arrays_zip(
        F.col(features).alias("0"), F.col("_mean").alias("1"), F.col("_std").alias("2")
    )
    # A constant dimension is centred but not scaled.
    scaled = F.transform(
        zipped, lambda e: (e["0"] - e["1"]) / F.when(e["2"] == 0, F.lit(1.0)).otherwise(e["2"])
    )
    return rows.withColumn(features, scaled).drop("_mean", "_std")
