"""Scoring of arriving requests: the batch projections on a stream.

Nothing here keeps state, so the same function serves a batch and a stream and
both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemark import fixed_values as fixed
from tonemark.functions import labels, probs
from tonemark.operators.filters import request_problem
from tonemark.operators.scoring import check_fusion, check_thresholds, prediction_columns


def score_requests(
    requests: DataFrame,
    *,
    low: float = fixed.VALENCE_LOW,
    high: float = fixed.VALENCE_HIGH,
    weight: float = 0.5,
    temperature: float = 1.0,
    abstain_threshold: float = 0.0,
) -> DataFrame:
    """Guard, read out valence, fuse with the lexical vector, flag abstentions.

    Needs clip_id, n_samples, sample_rate, valence and lexical_probs. A refused
    request keeps its row with the reason and no prediction.
    """
    check_thresholds(low, high)
    check_fusion(weight, temperature)
    valence = F.col("valence")
    acoustic = probs.soft_onehot(
        labels.valence_to_sentiment(valence, low, high),
        labels.threshold_confidence(valence, low, high),
    )
    fused = probs.fuse(F.col("lexical_probs"), acoustic, F.lit(weight), F.lit(temperature))
    guarded = requests.withColumn(
        "reason", request_problem(F.col("n_samples"), F.col("sample_rate"))
    ).withColumn("_v", F.when(F.col("reason").isNull(), fused))
    return guarded.select(
        "clip_id",
        "reason",
        *prediction_columns(F.col("_v")),
        (F.array_max("_v") < abstain_threshold).alias("abstained"),
    )


def drain_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything available now into a parquet table, then read it.

    The file sink and the checkpoint make a restarted run continue without
    repeating rows.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
