"""Evaluation metrics over joined predictions and labels.

Metrics run in two steps. `cells` reduces the rows to counts per (group, true,
predicted, text class, confidence bin) with map-side combine: the only shuffle
that sees the fact table carries at most a few hundred rows per group and task.
Every metric is then arithmetic on those counts. Undefined is NULL, never 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemark import fixed_values as fixed
from tonemark.operators.scale import beside, exact_percentiles
from tonemark.schema import LABELS

TRUE, PRED, TEXT = "prosody_sentiment", "sentiment", "text_sentiment"
KEY = ("solution", "dataset", "split_type")


def confidence_bin(confidence: Column, n_bins: int = 10) -> Column:
    """Right-closed equal-width bin; rounding absorbs 0.30000000000000004."""
    return F.greatest(F.ceil(F.round(confidence * n_bins, 9)), F.lit(1)).cast("bigint")


def cells(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Counts per class triple and confidence bin, the input of every metric."""
    present = set(rows.columns)
    confidence = F.col("confidence") if "confidence" in present else F.lit(None).cast("double")
    abstained = F.col("abstained") if "abstained" in present else F.lit(False)
    prepared = rows.select(
        *groups,
        F.col(TRUE).alias("t"),
        F.col(PRED).alias("p"),
        F.col(TEXT).alias("x"),
        confidence_bin(confidence).alias("bin"),
        confidence.alias("c"),
        abstained.alias("a"),
    )
    return prepared.groupBy(*groups, "t", "p", "x", "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("c").alias("conf"),
        F.count_if("a").alias("abst"),
    )


def _n(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0))).cast("bigint")


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def matrix_columns() -> dict[str, Column]:
    """The confusion matrix as nine counts, zeros kept."""
    t, p = F.col("t"), F.col("p")
    return {
        f"c_{a[:3]}_{b[:3]}": _n((t == a) & (p == b)) for a in LABELS for b in LABELS
    }


def metric_columns() -> dict[str, Column]:
    """All count-based metrics, to be used in one aggregation over cells."""
    t, p, x = F.col("t"), F.col("p"), F.col("x")
    total = F.sum("n")
    hits = {c: _n((t == c) & (p == c)) for c in LABELS}
    support = {c: _n(t == c) for c in LABELS}
    guessed = {c: _n(p == c) for c in LABELS}
    recalls = F.array_compact(F.array(*[_ratio(hits[c], support[c]) for c in LABELS]))
    f1s = [
        F.coalesce(_ratio(hits[c] * 2, support[c] + guessed[c]), F.lit(0.0)) for c in LABELS
    ]
    incongruent = t != x
    n_incongruent = _n(incongruent)
    tone = _n(incongruent & (p == t))
    words = _n(incongruent & (p == x))
    recall_sum = F.aggregate(recalls, F.lit(0.0), lambda acc, r: acc + r)
    return {
        "n_clips": total.cast("bigint"),
        "n_incongruent": n_incongruent,
        "uar": F.try_divide(recall_sum, F.size(recalls).cast("double")),
        "macro_f1": (f1s[0] + f1s[1] + f1s[2]) / F.lit(3.0),
        "accuracy": _ratio(_n(t == p), total),
        "psi_contested": _ratio(tone, tone + words),
        "psi_strict": _ratio(tone, n_incongruent),
        "abstention_rate": _ratio(F.sum("abst"), total),
    }


def summarise(rows: DataFrame, groups: Sequence[str], names: Sequence[str]) -> DataFrame:
    return summarise_cells(cells(rows, groups), groups, names)


def summarise_cells(counted: DataFrame, groups: Sequence[str], names: Sequence[str]) -> DataFrame:
    columns = metric_columns()
    return counted.groupBy(*groups).agg(*[columns[n].alias(n) for n in names])


def calibration_error(cell_rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Expected calibration error of the top label from the confidence bins."""
    bins = cell_rows.groupBy(*groups, "bin").agg(
        F.sum("n").alias("n"),
        _n(F.col("t") == F.col("p")).alias("right"),
        F.sum("conf").alias("conf"),
    )
    gap = F.abs(F.col("right") - F.col("conf"))
    return bins.groupBy(*groups).agg(_ratio(F.sum(gap), F.sum("n")).alias("ece"))


def per_class_recall(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    t, p = F.col("t"), F.col("p")
    return (
        cells(rows, groups)
        .groupBy(*groups)
        .agg(
            *[
                _ratio(_n((t == c) & (p == c)), _n(t == c)).alias(f"recall_{c}") for c in LABELS
            ]
        )
    )


def latency_percentiles(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    return exact_percentiles(
        rows, groups, "latency_ms", {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95}
    )


def evaluate(rows: DataFrame, groups: Sequence[str] = KEY) -> DataFrame:
    """One result row per group: every metric plus the confusion matrix.

    Groups with NULL keys and groups without any latency have their row too.
    """
    rows = rows.select(*groups, TRUE, PRED, TEXT, "confidence", "abstained", "latency_ms")
    counted = cells(rows, groups)
    # ECE needs a second level of grouping; it rides on the same cells, and the
    # two branches share their exchange.
    metrics = counted.groupBy(*groups).agg(
        *[c.alias(n) for n, c in {**metric_columns(), **matrix_columns()}.items()]
    )
    with_error = beside(metrics, calibration_error(counted, groups), groups)
    return beside(with_error, latency_percentiles(rows, groups), groups)


def as_results(evaluated: DataFrame, git_sha: str = "unknown") -> DataFrame:
    """Evaluated rows in the declared result layout, without the per-clip rows."""
    matrix = F.array(
        *[F.array(*[F.col(f"c_{a[:3]}_{b[:3]}") for b in LABELS]) for a in LABELS]
    )
    return evaluated.select(
        *KEY,
        *[
            "n_clips",
            "n_incongruent",
            "uar",
            "macro_f1",
            "accuracy",
            "ece",
            "psi_contested",
            "psi_strict",
        ],
        matrix.alias("confusion_matrix"),
        F.array(*[F.lit(x) for x in LABELS]).alias("confusion_labels"),
        "abstention_rate",
        "latency_p50_ms",
        "latency_p95_ms",
        F.lit(git_sha).alias("git_sha"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
    )


def degeneracy(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Most predicted class, its share, and whether the model has collapsed."""
    predicted = rows.groupBy(*groups, F.col(PRED).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return degeneracy_of_cells(predicted, groups)


def degeneracy_of_cells(cell_rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """`degeneracy` from counts n per predicted class p and whatever else."""
    p = F.col("p")
    counted = cell_rows.groupBy(*groups).agg(*[_n(p == x).alias(f"n_{x}") for x in LABELS])
    vector = F.array(*[F.col(f"n_{x}") for x in LABELS])
    total = F.col("n_negative") + F.col("n_neutral") + F.col("n_positive")
    top = F.array_max(vector)
    share = _ratio(top, total)
    return counted.select(
        *groups,
        F.element_at(
            F.array(*[F.lit(x) for x in LABELS]), F.array_position(vector, top).cast("int")
        ).alias("top_class"),
        share.alias("top_class_share"),
        (share >= fixed.DEGENERATE_SHARE).alias("is_degenerate"),
        *[f"n_{x}" for x in LABELS],
    )


def class_share(rows: DataFrame, groups: Sequence[str], label: str) -> DataFrame:
    # The window sees one row per class, not the fact table.
    counted = rows.groupBy(*groups, label).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*groups))
    return counted.select(
        *groups, F.col(label).alias("label"), "n", _ratio(F.col("n"), whole).alias("share")
    )


def majority_baseline(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Metrics of always predicting the most frequent true class of the group."""
    base = (
        rows.groupBy(*groups, F.col(TRUE).alias("t"), F.col(TEXT).alias("x"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("abst", F.lit(0))
    )
    support = F.array(
        *[F.sum(F.when(F.col("t") == c, F.col("n")).otherwise(F.lit(0))) for c in LABELS]
    )
    top = base.groupBy(*groups).agg(
        F.element_at(
            F.array(*[F.lit(x) for x in LABELS]),
            F.array_position(support, F.array_max(support)).cast("int"),
        ).alias("p")
    )
    columns = metric_columns()
    names = ("n_clips", "uar", "macro_f1", "accuracy", "psi_contested", "psi_strict")
    return (
        beside(base, top, groups)
        .groupBy(*groups, "p")
        .agg(*[columns[n].alias(n) for n in names])
        .withColumnRenamed("p", "majority_class")
    )
