"""Per-record voice descriptors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonemark import fixed_values as fixed


def avqi(**inputs: Column) -> Column:
    """Weighted composite clamped to [0, 10]; NULL as soon as one input is NULL."""
    if set(inputs) != set(fixed.AVQI_WEIGHTS):
        raise ValueError(f"expected inputs {sorted(fixed.AVQI_WEIGHTS)}")
    terms = [F.lit(w) * inputs[name] for name, w in fixed.AVQI_WEIGHTS.items()]
    raw = reduce(lambda a, b: a + b, terms, F.lit(fixed.AVQI_CONSTANT)) * F.lit(fixed.AVQI_SCALE)
    clamped = F.least(F.greatest(raw, F.lit(0.0)), F.lit(10.0))
    return F.when(raw.isNotNull(), clamped)


def is_whispered(
    hnr: Column,
    loudness: Column,
    hnr_max: Column | float = fixed.WHISPER_HNR_MAX,
    loudness_max: Column | float = fixed.WHISPER_LOUDNESS_MAX,
) -> Column:
    return (hnr <= hnr_max) & (loudness <= loudness_max)


def divided_rate(text: Column, seconds: Column) -> Column:
    """Characters a second as doubles divide: infinite over zero seconds, NULL over NULL."""
    n = F.length(text).cast("double")
    # The power keeps the sign of a zero.
    return F.when(seconds == 0, n * F.pow(seconds, F.lit(-1.0))).otherwise(F.try_divide(n, seconds))


def speech_rate(text: Column, seconds: Column, *, default: float | None = 0.0) -> Column:
    rate = F.try_divide(F.length(text).cast("double"), seconds)
    return rate if default is None else F.coalesce(rate, F.lit(default))
