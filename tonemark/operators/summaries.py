"""Descriptive summaries of corpora, measurements, draws and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark import fixed_values as fixed
from tonemark.functions.labels import literal_map
from tonemark.operators.scale import beside, exact_percentiles


def group_sizes(df: DataFrame, sets: Sequence[str], group: str = "speaker_id") -> DataFrame:
    """Number of groups per set, smallest and median size, undersized groups."""
    sizes = df.groupBy(*sets, group).agg(F.count(F.lit(1)).alias("n"))
    base = sizes.groupBy(*sets).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.min("n").alias("min_group_size"),
        F.count_if(F.col("n") < fixed.UNDERSIZED_GROUP).alias("n_undersized"),
    )
    wide = sizes.withColumn("n", F.col("n").cast("double"))
    medians = exact_percentiles(wide, sets, "n", {"median_group_size": 0.5})
    return beside(base, medians, sets)


def undersized_groups(df: DataFrame, sets: Sequence[str], group: str = "speaker_id") -> DataFrame:
    return (
        df.groupBy(*sets, group)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") < fixed.UNDERSIZED_GROUP)
    )


def split_counts(df: DataFrame) -> DataFrame:
    """Clips per split and per (split, speaker) from one rollup."""
    return (
        df.rollup("split", "speaker_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.grouping_id().alias("_level"),
        )
        .withColumn(
            "level",
            F.when(F.col("_level") == 0, "speaker")
            .when(F.col("_level") == 1, "split")
            .otherwise("all"),
        )
        .drop("_level")
    )


def duration_stats(df: DataFrame, seconds: str, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(
        F.sum(seconds).alias("total"),
        F.avg(seconds).alias("mean"),
        F.min(seconds).alias("min"),
        F.max(seconds).alias("max"),
    )


def group_mean_span(df: DataFrame, cut: Sequence[str], label: str, value: str) -> DataFrame:
    """Widest distance between class means, per cut."""
    means = df.groupBy(*cut, label).agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    return means.groupBy(*cut).agg(
        F.sum("_n").alias("n"),
        F.count("_m").alias("n_classes"),
        (F.max("_m") - F.min("_m")).alias("span"),
    )


def summary_by_cuts(df: DataFrame, label: str, value: str, cuts: Sequence[str]) -> DataFrame:
    """The span for the whole table and for every value of each cut column.

    Grouping sets feed all cuts from one scan and one shuffle.
    """
    sets = [[F.col(label)], *[[F.col(c), F.col(label)] for c in cuts]]
    columns = [F.col(c) for c in (*cuts, label)]
    means = df.groupingSets(sets, *columns).agg(
        F.avg(value).alias("_m"),
        F.count(F.lit(1)).alias("_n"),
        *[F.grouping(c).alias(f"_g_{c}") for c in cuts],
    )
    name = F.lit("all")
    for c in cuts:
        name = F.when(
            F.col(f"_g_{c}") == 0, F.concat(F.lit(f"{c}="), F.col(c).cast("string"))
        ).otherwise(name)
    return (
        means.withColumn("cut", name)
        .groupBy("cut")
        .agg(
            F.sum("_n").alias("n"),
            F.count("_m").alias("n_classes"),
            (F.max("_m") - F.min("_m")).alias("span"),
        )
    )


def range_of(value: str) -> Column:
    """max - min, NULL below two values."""
    return F.when(F.count(value) >= 2, F.max(value) - F.min(value))


def condition_summary(df: DataFrame, groups: Sequence[str], f0: str, valence: str) -> DataFrame:
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_clips"),
        range_of(f0).alias("f0_span_hz"),
        range_of(valence).alias("valence_range"),
    )


def per_label_means(df: DataFrame, label: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values]
    )


def sentiment_ordering(
    df: DataFrame,
    emotion: str,
    value: str,
    groups: Sequence[str] = (),
    sentiment_of: dict[str, str] | None = None,
) -> DataFrame:
    """Do emotion means order positive > neutral > negative; NULL if one is missing."""
    lookup = literal_map(sentiment_of or fixed.PROBE_SENTIMENT)
    means = df.groupBy(*groups, emotion).agg(F.avg(value).alias("_m"))
    s = F.try_element_at(lookup, F.col(emotion))
    cols = {
        x: F.avg(F.when(s == x, F.col("_m"))).alias(x) for x in ("positive", "neutral", "negative")
    }
    wide = means.groupBy(*groups).agg(*cols.values())
    holds = (F.col("positive") > F.col("neutral")) & (F.col("neutral") > F.col("negative"))
    return wide.withColumn("ordering_holds", holds)


def per_tag_summary(df: DataFrame, tag: str, values: Sequence[str], cluster: str) -> DataFrame:
    # There are at most ten cluster ids.
    clusters = F.array_join(F.array_sort(F.collect_set(F.col(cluster).cast("string"))), ",")
    return df.groupBy(tag).agg(
        *[F.avg(v).alias(f"mean_{v}") for v in values], clusters.alias("clusters")
    )


def value_span(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg((F.max(value) - F.min(value)).alias("span"))


def test_retest(paired: DataFrame, values: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Correlation of the readings of two takes, NULL for fewer than two pairs."""
    return paired.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_paired"),
        *[F.corr(f"{v}_a", f"{v}_b").alias(f"r_{v}") for v in values],
    )


def draw_aggregate(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Mean, population deviation, range and count over finite values."""
    v = F.col(value)
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return df.groupBy(*groups).agg(
        F.avg(finite).alias("mean"),
        F.stddev_pop(finite).alias("std"),
        F.min(finite).alias("min"),
        F.max(finite).alias("max"),
        F.count(finite).alias("n_draws"),
    )


def realised_share(draws: DataFrame, groups: Sequence[str], draw: Sequence[str], label: str):
    """Majority share and size actually reached by the draws of each level."""
    counts = draws.groupBy(*groups, *draw, label).agg(F.count(F.lit(1)).alias("n"))
    per_draw = counts.groupBy(*groups, *draw).agg(
        (F.max("n") / F.sum("n")).alias("share"), F.sum("n").alias("size")
    )
    return per_draw.groupBy(*groups).agg(
        F.avg("share").alias("mean_share"),
        F.min("share").alias("min_share"),
        F.max("share").alias("max_share"),
        F.avg("size").alias("mean_size"),
        F.min("size").alias("min_size"),
        F.count(F.lit(1)).alias("n_draws"),
    )


def key_numbers(results: DataFrame, required: Sequence[tuple[str, str]]) -> DataFrame:
    """The named headline results; a missing one keeps its row with NULLs.

    `required` is a fixed short list of (key, result_name).
    """
    spark = results.sparkSession
    wanted = spark.createDataFrame(list(required), "key string, result_name string")
    found = results.select("result_name", "n_clips", "uar", "psi_contested")
    return wanted.join(found, "result_name", "left").select(
        "key", "result_name", "n_clips", "uar", "psi_contested",
        F.col("n_clips").isNotNull().alias("available"),
    )


def results_matrix(results: DataFrame, datasets: Sequence[str], value: str = "uar") -> DataFrame:
    """Solutions by datasets; the dataset list is fixed, so no extra pass finds it."""
    return (
        results.groupBy("solution", "split_type")
        .pivot("dataset", list(datasets))
        .agg(F.max(value))
        .orderBy("solution", "split_type")
    )


def ci_verdicts(uar_lo: Column, psi_hi: Column) -> dict[str, Column]:
    return {"beats_chance": uar_lo > F.lit(1 / 3), "follows_words": psi_hi < F.lit(0.5)}
