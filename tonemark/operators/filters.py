"""Row selection and named, overlapping evaluation cuts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark import fixed_values as fixed


def by_split(manifest: DataFrame, split: str) -> DataFrame:
    """Rows of one split; raises when there are none (reads at most one row)."""
    rows = manifest.where(F.col("split") == split)
    if rows.select("clip_id").isEmpty():
        raise ValueError(f"the table has nothing in its {split!r} part")
    return rows


def without_whisper(df: DataFrame) -> DataFrame:
    return df.where(~F.col("clip_id").contains("whisper"))


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every listed value is present (neither NULL nor NaN)."""
    return df.na.drop(subset=list(columns))


def completeness(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Rows kept and dropped by `complete_rows`, in one aggregation."""
    lacking = F.lit(False)
    for c in columns:
        lacking = lacking | F.col(c).isNull()
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~lacking).alias("n_kept"),
        F.count_if(lacking).alias("n_dropped"),
    )


def request_problem(n_samples: Column, rate: Column) -> Column:
    """Why a request is refused, NULL when it is acceptable."""
    return (
        F.when(n_samples.isNull() | (n_samples == 0), "no audio submitted")
        .when(n_samples > fixed.MAX_REQUEST_SAMPLES, "clip too long")
        .when(
            rate.isNull() | (rate <= 0) | (rate > fixed.MAX_SAMPLE_RATE), "invalid sample rate"
        )
    )


def named_cuts(df: DataFrame, cuts: Mapping[str, Column], name: str = "cut") -> DataFrame:
    """One copy of a row per cut it belongs to, so all cuts are scored in one pass."""
    members = F.array_compact(F.array(*[F.when(cond, F.lit(c)) for c, cond in cuts.items()]))
    return df.withColumn(name, F.explode(members))
