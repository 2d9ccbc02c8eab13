"""Signal and feature arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonemark import fixed_values as fixed
from tonemark.schema import SAMPLE_RATE


def to_doubles(x: Column) -> Column:
    return x.cast("array<double>")


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def rms(samples: Column) -> Column:
    squares = F.transform(to_doubles(samples), lambda v: v * v)
    return F.sqrt(F.try_divide(array_sum(squares), F.size(samples).cast("double")))


def to_mono(frames: Column) -> Column:
    """Frames of channels to one mean value per frame."""
    return F.transform(frames, lambda f: array_sum(to_doubles(f)) / F.size(f))


def peak_normalise(samples: Column) -> Column:
    peak = F.array_max(F.transform(samples, lambda v: F.abs(v)))
    scaled = F.transform(samples, lambda v: v * (F.lit(fixed.PEAK_TARGET) / peak))
    return F.when(peak < fixed.SILENCE_PEAK, samples).otherwise(F.coalesce(scaled, samples))


def duration_s(samples: Column, rate: Column | int = SAMPLE_RATE) -> Column:
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    return F.size(samples).cast("double") / rate.cast("double")


def semitones(hz: Column) -> Column:
    return F.lit(12.0) * F.log2(F.greatest(hz, F.lit(1e-6)) / F.lit(100.0))


def describe_topk(values: Column, k: int, names: Column) -> Column:
    """The k entries of largest magnitude, NaN counted as zero; first wins ties."""
    magnitude = F.transform(
        values, lambda v: F.coalesce(F.nanvl(F.abs(v), F.lit(0.0)), F.lit(0.0))
    )
    entries = F.transform(
        F.arrays_zip(magnitude.alias("m"), names.alias("n"), values.alias("v")),
        lambda e, i: F.struct(
            (-e["m"]).alias("key"), i.alias("pos"), e["n"].alias("name"), e["v"].alias("value")
        ),
    )
    return F.slice(F.array_sort(entries), 1, k)
