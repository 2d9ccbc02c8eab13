"""Rank consistency, detection ranking and best-of selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonemark.functions.labels import detection_score
from tonemark.operators.normalise import z_within
from tonemark.operators.scale import global_desc_order


def rank_consistency(
    df: DataFrame, cell: Sequence[str], label: str, value: str, n_classes: int
) -> DataFrame:
    """Mean rank of each class by mean value within cells (rank 1 = highest).

    Cells with a single class cannot rank anything and are left out.
    """
    means = df.groupBy(*cell, label).agg(F.avg(value).alias("_m")).where(F.col("_m").isNotNull())
    # A cell holds one row per class here.
    per_cell = Window.partitionBy(*cell)
    ranked = means.withColumn(
        "_rank", F.row_number().over(per_cell.orderBy(F.desc("_m"), label))
    ).withColumn("_k", F.count(F.lit(1)).over(per_cell))
    return (
        ranked.where(F.col("_k") >= 2)
        .groupBy(label)
        .agg(
            F.avg(F.col("_rank").cast("double")).alias("mean_rank"),
            F.count(F.lit(1)).alias("n_cells"),
        )
        .withColumn("chance_mean_rank", F.lit((n_classes + 1) / 2))
    )


def scored_table(df: DataFrame, value: str, *, source: str = "source", intended: str) -> DataFrame:
    """z within the source, signed by the intended class."""
    scored = z_within(df, value, [source])
    return scored.withColumn("detection_score", detection_score(F.col("z"), F.col(intended)))


def detection_ranking(scored: DataFrame) -> DataFrame:
    """Rank 1 = most detectable, over the whole table."""
    return global_desc_order(scored, "detection_score", tie="clip_id").withColumnRenamed(
        "position", "rank"
    )


def top_and_bottom(scored: DataFrame, by: str, k: int, tie: str = "clip_id") -> DataFrame:
    """The k best and k worst rows; each side is a bounded top-k, not a full sort."""
    top = scored.orderBy(F.desc(by), tie).limit(k).withColumn("side", F.lit("top"))
    bottom = scored.orderBy(F.asc(by), F.desc(tie)).limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def best_cell(df: DataFrame, cell: Sequence[str], value: str) -> DataFrame:
    """The cell with the widest spread of values; cells need two values."""
    spread = F.max(value) - F.min(value)
    return (
        df.groupBy(*cell)
        .agg(spread.alias("spread"), F.count(value).alias("n"))
        .where(F.col("n") >= 2)
        .orderBy(F.desc("spread"), *cell)
        .limit(1)
    )


def select_best(
    scores: DataFrame, groups: Sequence[str], name: str, score: str, order: str
) -> DataFrame:
    """Best name per group; the earliest by `order` wins a tie. Losers stay listed."""
    best = F.max_by(F.col(name), F.struct(F.col(score), -F.col(order)))
    listed = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct(order, name))), lambda e: e[name]
        ),
        ",",
    )
    return scores.groupBy(*groups).agg(
        best.alias("selected"), F.max(score).alias(score), listed.alias("candidates")
    )
