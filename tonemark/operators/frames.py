"""Aggregations over frame tables (clip_id, t, f0_hz, intensity_db, hnr)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemark import fixed_values as fixed
from tonemark.functions.arrays import semitones
from tonemark.operators.scale import exact_percentiles


def meanstd_pool(clips: DataFrame, key: str = "clip_id", frames: str = "frames") -> DataFrame:
    """Frame matrix of a clip to one vector: means, then population deviations.

    The matrix already sits in one row, so pooling is array arithmetic in place
    rather than an explode and a shuffle.
    """
    m = F.col(frames)
    n = F.size(m).cast("double")
    zero = F.transform(m[0], lambda _: F.lit(0.0))
    total = F.aggregate(m, zero, lambda acc, f: F.zip_with(acc, f, lambda a, b: a + b))
    mean = F.transform(total, lambda s: s / n)
    with_mean = clips.withColumn("_mean", mean)
    spread = F.aggregate(
        m,
        zero,
        lambda acc, f: F.zip_with(
            acc,
            F.zip_with(f, F.col("_mean"), lambda x, mu: (x - mu) * (x - mu)),
            lambda a, b: a + b,
        ),
    )
    std = F.transform(spread, lambda s: F.sqrt(s / n))
    return with_mean.select(key, F.concat(F.col("_mean"), std).alias("features"))


def contour_features(frames: DataFrame, key: str = "clip_id") -> DataFrame:
    """Pitch and energy trend and spread per clip; NULL below three usable frames."""
    voiced = F.col("f0_hz") > 0
    loud = F.col("intensity_db") > fixed.SILENCE_DB
    f = frames.select(
        key,
        "t",
        voiced.alias("_voiced"),
        loud.alias("_loud"),
        F.when(voiced, semitones(F.col("f0_hz"))).alias("_st"),
        F.when(loud, F.col("intensity_db")).alias("_db"),
    )
    base = f.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if("_voiced").alias("_nv"),
        F.count_if("_loud").alias("_nl"),
        F.regr_slope("_st", "t").alias("_st_slope"),
        F.regr_slope("_db", "t").alias("_db_slope"),
    )
    st = exact_percentiles(f, [key], "_st", {"_s5": 0.05, "_s25": 0.25, "_s75": 0.75, "_s95": 0.95})
    db = exact_percentiles(f, [key], "_db", {"_d5": 0.05, "_d95": 0.95})
    enough_v, enough_l = F.col("_nv") >= 3, F.col("_nl") >= 3
    n = F.col("_n").cast("double")
    return (
        base.join(st, key, "left")
        .join(db, key, "left")
        .select(
            key,
            F.when(enough_v, F.col("_st_slope")).alias("f0_slope_st_per_s"),
            F.when(enough_v, F.col("_s95") - F.col("_s5")).alias("f0_dynamic_range_st"),
            F.when(enough_v, F.col("_s75") - F.col("_s25")).alias("f0_iqr_st"),
            F.when(enough_l, F.col("_db_slope")).alias("energy_slope_db_per_s"),
            F.when(enough_l, F.col("_d95") - F.col("_d5")).alias("energy_contrast_db"),
            (F.col("_nv") / n).alias("voiced_fraction"),
            (F.lit(1.0) - F.col("_nl") / n).alias("pause_ratio"),
        )
    )


def pitch_stats(frames: DataFrame, groups: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Mean, population deviation and range of voiced F0; NULL without voiced frames."""
    f0 = F.when(F.col("f0_hz") > 0, F.col("f0_hz"))
    return frames.groupBy(*groups).agg(
        F.avg(f0).alias("f0_mean"),
        F.stddev_pop(f0).alias("f0_std"),
        (F.max(f0) - F.min(f0)).alias("f0_range"),
    )


def hnr_mean(frames: DataFrame, groups: Sequence[str] = ("clip_id",)) -> DataFrame:
    hnr = F.when(F.col("hnr") != fixed.HNR_UNDEFINED, F.col("hnr"))
    return frames.groupBy(*groups).agg(F.avg(hnr).alias("hnr_mean"))
