"""Feature normalisation: whole set, per group, and leave-one-out per group.

Statistics are aggregated once per group (map-side combine, one row per group)
and joined back; raw rows are never shuffled for a window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemark.operators.scale import lookup_join, one_row

EPS = 1e-8
# A leave-one-out variance below this share of the group's is rounding noise.
NOISE = 1e-13
SCHEMES = ("raw", "dataset_z", "speaker_z", "speaker_z_loo")


def feature_stats(
    df: DataFrame, groups: Sequence[str], width: int, features: str = "features"
) -> DataFrame:
    """Per group: row count and per-dimension mean and population deviation.

    A NaN makes its dimension missing for its group, at any width; impute before.
    """
    groups = list(groups)
    figures = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(features))
    n = F.col("_s.count")
    # The summary's variance divides by n - 1.
    share = F.when(n > 1, (n - 1) / n).otherwise(F.lit(0.0))
    return (
        df.groupBy(*groups)
        .agg(figures.alias("_s"))
        .select(
            *groups,
            n.alias("_n"),
            vector_to_array("_s.mean").alias("_mean"),
            F.transform(vector_to_array("_s.variance"), lambda v: F.sqrt(v * share)).alias("_std"),
        )
    )


def group_coefficients(stats: DataFrame, loo: bool) -> DataFrame:
    """Reduce group figures to what a row needs: z = c * gap / sqrt(a - b * gap^2).

    With gap = x - mean, the group without the row has mean - gap / (n - 1) as
    its mean and (n * std^2 - gap^2 * n / (n - 1)) / (n - 1) as its variance, so
    a = n * std^2 / (n - 1), b = n / (n - 1)^2 and c = n / (n - 1). The plain
    score, also used for groups of fewer than three rows, is a = std^2, b = 0
    and c = 1.
    """
    n = F.col("_n").cast("double")
    small = (n < 3) | F.lit(not loo)
    ratio = F.when(small, F.lit(1.0)).otherwise(n / (n - 1))
    return stats.select(
        "*",
        ratio.alias("_c"),
        F.when(small, F.lit(0.0)).otherwise(n / ((n - 1) * (n - 1))).alias("_b"),
        F.transform("_std", lambda s: s * s * ratio).alias("_a"),
    )


def normalise(
    df: DataFrame,
    scheme: str,
    width: int,
    *,
    groups: Sequence[str] = ("speaker_id",),
    pool: Sequence[str] = (),
    features: str = "features",
    spread_by: str = "clip_id",
) -> DataFrame:
    """Replace the feature vector by its normalised form under one scheme.

    `pool` names columns that separate independent sets (a draw, an evaluation
    set); statistics never cross them.
    """
    if scheme == "raw":
        return df
    if scheme not in SCHEMES:
        raise ValueError(f"{scheme!r} is none of {', '.join(SCHEMES)}")
    keys = list(pool) if scheme == "dataset_z" else [*pool, *groups]
    stats = group_coefficients(
        feature_stats(df, keys, width, features), scheme == "speaker_z_loo"
    )
    names = ["_mean", "_std", "_a", "_b", "_c"]
    if keys:
        joined = lookup_join(
            df, stats, keys, count_col="_n", spread_by=spread_by, row_bytes=100 + 8 * width
        )
    else:
        s = one_row(stats)
        joined = df.withColumns({c: s.getField(c) for c in names})
    return joined.withColumn(features, vector_z(features, *names)).drop("_n", *names)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def vector_z(
    x: pd.Series, mean: pd.Series, std: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series
) -> pd.Series:
    """Scores of whole vectors, one numpy operation per Arrow batch.

    Where the other rows do not vary, the group deviation is the scale; a dimension
    that is constant in the group becomes 0 and a NaN is a gap (NULL). Array lambdas are
    interpreted per element, which is many times slower.
    """
    if len(x) == 0:
        return pd.Series([], dtype=object)
    v, m, s, aa = (np.stack(column.to_numpy()) for column in (x, mean, std, a))
    bb, cc = (column.to_numpy(dtype=np.float64)[:, None] for column in (b, c))
    gap = v - m
    variance = aa - bb * gap * gap
    usable = variance >= np.maximum(EPS * EPS, aa * NOISE)
    scale = np.where(usable, np.sqrt(np.where(usable, variance, 1.0)), np.maximum(s, EPS))
    known = usable | (s >= EPS) | np.isnan(variance)
    return pd.Series(list(np.where(known, cc * gap / scale, 0.0)))


def z_within(df: DataFrame, value: str, groups: Sequence[str], out: str = "z") -> DataFrame:
    """z-score of one column within groups; 0 where the group does not vary."""
    groups = list(groups)
    stats = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(value).alias("_mean"),
        F.stddev_pop(value).alias("_std"),
    )
    joined = lookup_join(df, stats, groups, count_col="_n", spread_by="clip_id")
    scaled = F.when(F.col("_std") > 0, (F.col(value) - F.col("_mean")) / F.col("_std"))
    return joined.withColumn(out, scaled.otherwise(F.lit(0.0))).drop("_n", "_mean", "_std")
