"""One measurement row per clip from frames and model readings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark.functions.probs import valence_proxy
from tonemark.functions.voice import speech_rate
from tonemark.operators import frames
from tonemark.operators.scale import lookup_join


def measurement_table(
    clips: DataFrame,
    frame_rows: DataFrame,
    readings: DataFrame,
    *,
    seconds: str,
    frames_key: str = "clip_id",
    rate: Callable[[Column, Column], Column] = speech_rate,
) -> DataFrame:
    """Descriptors and model readings side by side.

    Joins are outer on the clip side: an instrument that failed leaves NULLs and
    the clip stays. `rate` takes text and seconds to characters a second.
    """
    pitch = frames.pitch_stats(frame_rows)
    noise = frames.hnr_mean(frame_rows).withColumnRenamed("hnr_mean", "egemaps_hnr")
    # A descriptor row may serve many clips, so the join is spread by its use.
    use = clips.groupBy(F.col(frames_key).alias("clip_id")).agg(F.count(F.lit(1)).alias("_n"))
    described = (
        use.join(pitch, "clip_id", "left")
        .join(noise, "clip_id", "left")
        .withColumnRenamed("clip_id", "_frames")
    )
    read = readings.select(
        "clip_id",
        F.col("sentiment").alias("permissive_predicted_sentiment"),
        valence_proxy(F.col("probs")).alias("permissive_valence_proxy"),
    )
    keyed = clips.select(
        "clip_id",
        F.col("text").alias("carrier"),
        F.col("prosody_sentiment").alias("intended"),
        rate(F.col("text"), F.col(seconds)).alias("speech_rate_cps"),
        F.col(frames_key).alias("_frames"),
    )
    joined = lookup_join(
        keyed, described, ["_frames"], count_col="_n", spread_by="clip_id", how="left"
    )
    return joined.drop("_frames", "_n").join(read, "clip_id", "left")
