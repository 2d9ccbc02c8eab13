"""Scoring protocol, prediction contract and guards."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark import fixed_values as fixed
from tonemark.functions import probs as P
from tonemark.schema import LABELS


def prediction_checks(
    rows: DataFrame, groups: Sequence[str], *, probs: str = "probs", vad: str | None = None
) -> DataFrame:
    """Violations of the prediction contract per group, in one pass."""
    p = F.col(probs)
    keys = F.array_sort(F.map_keys(p))
    total = F.aggregate(F.map_values(p), F.lit(0.0), lambda acc, x: acc + x)
    top = F.array_max(F.map_values(p))
    outside = F.lit(False) if vad is None else ~F.col(vad).between(0.0, 1.0)
    return rows.groupBy(*groups).agg(
        F.count_if(keys != F.array(*[F.lit(x) for x in sorted(LABELS)])).alias("wrong_keys"),
        F.count_if(F.abs(total - 1.0) > 1e-6).alias("bad_sum"),
        F.count_if(F.abs(F.col("confidence") - top) > 1e-6).alias("bad_confidence"),
        F.count_if(outside).alias("vad_outside"),
    )


def check_thresholds(low: float, high: float) -> None:
    if not 0.0 <= low < high <= 1.0:
        raise ValueError(f"expected 0 <= low < high <= 1, got {low}, {high}")


def check_fusion(weight: float, temperature: float) -> None:
    if not 0.0 <= weight <= 1.0:
        raise ValueError(f"weight outside [0, 1]: {weight}")
    if temperature <= 0.0:
        raise ValueError(f"temperature must be positive: {temperature}")


def suspicious(uar: Column, ceiling: float = fixed.SUSPICIOUS_UAR) -> Column:
    """A held-out score this high points to leakage before it points to skill."""
    return F.coalesce(uar > ceiling, F.lit(False))


def prediction_columns(vector: Column) -> list[Column]:
    """Label and confidence follow from the vector; the label is always its argmax."""
    return [
        P.argmax_label(vector).alias("sentiment"),
        vector.alias("probs"),
        F.array_max(vector).alias("confidence"),
    ]


SCORED = "clip_id string, raw map<string,double>, latency_ms double"


def score_with(
    clips: DataFrame,
    predict_batch: Callable[[pd.Series], Sequence[dict[str, float]]],
    solution: str,
    payload: str = "payload",
) -> DataFrame:
    """Run a user model over the payload column, batch by batch.

    `predict_batch` gets a pandas Series and returns one label -> score dict per
    row; a different number of predictions is an error, as is an unknown label.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            started = time.perf_counter()
            out = list(predict_batch(batch[payload]))
            if len(out) != len(batch):
                raise ValueError(f"{solution}: {len(out)} predictions for {len(batch)} clips")
            each = (time.perf_counter() - started) * 1000 / max(len(out), 1)
            yield pd.DataFrame({"clip_id": batch["clip_id"], "raw": out, "latency_ms": each})

    raw = clips.select("clip_id", payload).mapInPandas(run, SCORED)
    normal = raw.withColumn("vector", P.normalise(F.col("raw")))
    return normal.select(
        "clip_id",
        F.lit(solution).alias("solution"),
        *prediction_columns(F.col("vector")),
        "latency_ms",
        F.lit(False).alias("abstained"),
    )


def fused_predictions(
    a: DataFrame,
    b: DataFrame,
    *,
    weight: float,
    temperature: float,
    abstain_threshold: float,
    name: str = "C:fusion",
) -> DataFrame:
    """Fused prediction per clip; transcript comes from `a`, VAD from `b`."""
    check_fusion(weight, temperature)
    left = a.select(
        "clip_id",
        F.col("probs").alias("_a"),
        F.col("latency_ms").alias("_ta"),
        *(["transcript"] if "transcript" in a.columns else []),
    )
    right = b.select(
        "clip_id",
        F.col("probs").alias("_b"),
        F.col("latency_ms").alias("_tb"),
        *(["vad"] if "vad" in b.columns else []),
    )
    both = left.join(right, "clip_id").withColumn(
        "vector", P.fuse(F.col("_a"), F.col("_b"), F.lit(weight), F.lit(temperature))
    )
    extra = [c for c in ("transcript", "vad") if c in both.columns]
    return both.select(
        "clip_id",
        F.lit(name).alias("solution"),
        *prediction_columns(F.col("vector")),
        (F.col("_ta") + F.col("_tb")).alias("latency_ms"),
        (F.array_max("vector") < abstain_threshold).alias("abstained"),
        *extra,
    )
