"""Joins between manifests, predictions, feature stores and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonemark.operators.scale import one_row
from tonemark.schema import SplitError


def join_predictions(manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each clip with its predictions, joined by id rather than by position."""
    return manifest.join(predictions, "clip_id")


def prediction_alignment(manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per solution: predictions, clips without one, and predictions without a clip."""
    known = manifest.select("clip_id").withColumn("known", F.lit(True))
    per = (
        predictions.select("clip_id", "solution")
        .join(known, "clip_id", "left")
        .groupBy("solution")
        .agg(
            F.count(F.lit(1)).alias("n_predictions"),
            F.count_if(F.col("known").isNull()).alias("n_unknown"),
            F.count_if("known").alias("_matched"),
        )
    )
    n = one_row(manifest.agg(F.count(F.lit(1)).alias("n"))).getField("n")
    return per.select(
        "solution",
        n.alias("n_clips"),
        "n_predictions",
        (n - F.col("_matched")).alias("n_missing"),
        "n_unknown",
    )


def require_aligned(manifest: DataFrame, predictions: DataFrame) -> None:
    bad = (
        prediction_alignment(manifest, predictions)
        .where((F.col("n_missing") != 0) | (F.col("n_unknown") != 0))
        .limit(5)
        .collect()
    )
    if bad:
        raise ValueError(f"predictions and clips do not match one to one: {bad}")


def join_features(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """Clips with stored vectors; use `missing_features` to find the rest."""
    return manifest.join(store, "clip_id")


def missing_features(manifest: DataFrame, store: DataFrame) -> DataFrame:
    return manifest.join(store.select("clip_id"), "clip_id", "left_anti")


def require_features(manifest: DataFrame, store: DataFrame) -> DataFrame:
    absent = [r[0] for r in missing_features(manifest, store).select("clip_id").limit(5).collect()]
    if absent:
        raise KeyError(f"clip_id(s) missing from the feature store, e.g. {absent}")
    return join_features(manifest, store)


def speaker_overlap(train: DataFrame, other: DataFrame) -> DataFrame:
    """Speakers present on both sides."""
    return (
        train.select("speaker_id")
        .distinct()
        .join(other.select("speaker_id").distinct(), "speaker_id", "left_semi")
    )


def split_violations(manifest: DataFrame) -> DataFrame:
    """Speakers found in more than one of train, val and test (one shuffle)."""
    flags = [F.max(F.col("split") == s).alias(f"in_{s}") for s in ("train", "val", "test")]
    crowded = sum((F.col(f"in_{s}").cast("int") for s in ("train", "val", "test")), F.lit(0))
    return (
        manifest.where(F.col("split").isin("train", "val", "test"))
        .groupBy("speaker_id")
        .agg(*flags)
        .where(crowded > 1)
    )


def assert_speaker_disjoint(manifest: DataFrame) -> None:
    bad = [r[0] for r in split_violations(manifest).select("speaker_id").limit(5).collect()]
    if bad:
        raise SplitError(f"speaker(s) in more than one split, e.g. {sorted(bad)}")


def split_intersections(manifest: DataFrame) -> DataFrame:
    """Number of speakers shared by each pair of splits."""
    v = split_violations(manifest)
    pairs = (("train", "test"), ("train", "val"), ("val", "test"))
    counts = v.agg(
        *[F.count_if(F.col(f"in_{a}") & F.col(f"in_{b}")).alias(f"{a}|{b}") for a, b in pairs]
    )
    entries = [
        F.struct(
            F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(f"{a}|{b}").alias("shared")
        )
        for a, b in pairs
    ]
    return counts.select(F.inline(F.array(*entries)))


def paired_takes(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]):
    """Readings of two takes side by side, suffixed _a and _b."""
    left = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values])
    right = b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values])
    return left.join(right, list(keys))


def delta_vs_baseline(
    scores: DataFrame, keys: Sequence[str], *, scheme: str = "scheme", value: str = "uar",
    baseline: str = "raw",
) -> DataFrame:
    """Each scheme's score minus the baseline scheme's, within the same keys."""
    base = F.max(F.when(F.col(scheme) == baseline, F.col(value))).over(Window.partitionBy(*keys))
    return (
        scores.withColumn(f"{baseline}_{value}", base)
        .where(F.col(scheme) != baseline)
        .withColumn("delta", F.col(value) - F.col(f"{baseline}_{value}"))
    )


def evaluation_matrix(train_sets: DataFrame, eval_sets: DataFrame) -> DataFrame:
    """Every (training set, evaluation set) pair with the speakers they share.

    Inputs are (set name, speaker_id) memberships. The pairs come from the two
    short lists of names; sharing is an equi-join on distinct speakers.
    """
    train = train_sets.select("train_set", "speaker_id").distinct()
    evals = eval_sets.select("eval_set", "speaker_id").distinct()
    shared = (
        train.join(evals, "speaker_id").groupBy("train_set", "eval_set")
        .agg(F.count(F.lit(1)).alias("n_shared"))
    )
    names = one_row(
        evals.agg(F.array_sort(F.collect_set("eval_set")).alias("names"))
    ).getField("names")
    pairs = train.select("train_set").distinct().select(
        "train_set", F.explode(names).alias("eval_set")
    )
    n = F.coalesce(F.col("n_shared"), F.lit(0).cast("bigint"))
    return pairs.join(shared, ["train_set", "eval_set"], "left").select(
        "train_set",
        "eval_set",
        n.alias("n_shared"),
        F.when(n > 0, "speakers on both sides").alias("excluded_reason"),
    )


def existing_only(rows: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    return rows.join(listing.select(path).distinct(), path, "left_semi")


def leakage_gap(
    results: DataFrame, leaky: str, disjoint: str, keys: Sequence[str] = ("solution",)
) -> DataFrame:
    """Score under a leaky split minus the score under the disjoint one."""
    pick = {
        name: F.max(F.when(F.col("split_type") == kind, F.col("uar"))).alias(name)
        for name, kind in (("leaky_uar", leaky), ("disjoint_uar", disjoint))
    }
    return (
        results.groupBy(*keys)
        .agg(*pick.values())
        .withColumn("gap", F.col("leaky_uar") - F.col("disjoint_uar"))
    )
