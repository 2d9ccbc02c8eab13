"""Factorial designs: every combination of fixed factors, per row of a table.

The factors are short fixed lists, so a grid is an explode of array literals on
the rows that carry the open-ended factor (a voice, a text); nothing is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark import fixed_values as fixed
from tonemark.functions.labels import carrier_group, literal_map, probe_text, slug
from tonemark.schema import LABELS


def cross_factor(rows: DataFrame, name: str, values: Sequence[object]) -> DataFrame:
    return rows.withColumn(name, F.explode(F.array(*[F.lit(x) for x in values])))


def carriers(per_sentiment: int = 5) -> Column:
    """Fixed carrier sentences as an array of (text_sentiment, carrier_index, text)."""
    return F.array(
        *[
            F.struct(
                F.lit(s).alias("text_sentiment"),
                F.lit(i).cast("bigint").alias("carrier_index"),
                F.lit(t).alias("text"),
            )
            for s, texts in fixed.CARRIERS.items()
            for i, t in enumerate(texts[:per_sentiment])
        ]
    )


def _with_carriers(rows: DataFrame, per_sentiment: int = 5) -> DataFrame:
    keep = rows.columns
    return rows.withColumn("_c", F.explode(carriers(per_sentiment))).select(*keep, "_c.*")


def emotion_probe_grid(voices: DataFrame) -> DataFrame:
    """Emotion x text condition x length x speed condition, per voice."""
    g = cross_factor(voices, "emotion", fixed.PROBE_EMOTIONS)
    g = cross_factor(g, "text_condition", ["neutral", "congruent"])
    g = cross_factor(g, "length", ["short", "long"])
    g = cross_factor(g, "speed_condition", ["default", "adjusted"])
    factors = ("emotion", "text_condition", "length", "speed_condition")
    args = [F.col(c) for c in factors[:3]]
    return g.select(
        *voices.columns,
        F.concat_ws("_", F.lit("d1"), *factors, *voices.columns).alias("clip_id"),
        *factors,
        probe_text(*args).alias("text"),
        F.when(
            F.col("speed_condition") == "adjusted",
            F.try_element_at(literal_map(fixed.PROBE_SPEED), F.col("emotion")),
        ).alias("speed"),
        F.lit(fixed.PROBE_MODEL).alias("model_id"),
        carrier_group(*args).alias("carrier_group"),
    )


def described_grid(voices: DataFrame) -> DataFrame:
    """Emotion x text condition x length x with/without a delivery description."""
    g = cross_factor(voices, "emotion", fixed.PROBE_EMOTIONS)
    g = cross_factor(g, "text_condition", ["neutral", "congruent"])
    g = cross_factor(g, "length", ["short", "long"])
    g = cross_factor(g, "has_description", [True, False])
    args = [F.col(c) for c in ("emotion", "text_condition", "length")]
    suffix = F.when(F.col("has_description"), "desc").otherwise("nodesc")
    return g.select(
        *voices.columns,
        F.concat_ws("_", F.lit("hume"), *args, suffix, *voices.columns).alias("clip_id"),
        *[c for c in ("emotion", "text_condition", "length", "has_description")],
        probe_text(*args).alias("text"),
        carrier_group(*args).alias("carrier_group"),
    )


def delivery_grid(voices: DataFrame, voice: str = "voice") -> DataFrame:
    """Voice x carrier sentence x delivery."""
    g = _with_carriers(voices)
    g = cross_factor(g, "prosody_sentiment", ["positive", "neutral", "negative"])
    clip_id = F.concat_ws(
        "_",
        F.lit("e5"),
        slug(F.col(voice)),
        F.concat("text_sentiment", F.col("carrier_index").cast("string")),
        "prosody_sentiment",
    )
    return g.withColumn("clip_id", clip_id).withColumn(
        "is_congruent", F.col("text_sentiment") == F.col("prosody_sentiment")
    )


def synthetic_grid(voices: DataFrame, voice: str = "voice") -> DataFrame:
    """Carrier sentence x delivery tag x voice."""
    g = _with_carriers(voices)
    g = cross_factor(g, "prosody_sentiment", list(fixed.SYNTHETIC_TAGS))
    clip_id = F.concat_ws(
        "_",
        F.lit("e2"),
        "text_sentiment",
        F.col("carrier_index").cast("string"),
        "prosody_sentiment",
        voice,
    )
    return g.select(
        clip_id.alias("clip_id"),
        F.concat(F.lit("cartesia_"), voice).alias("speaker_id"),
        "text",
        "text_sentiment",
        "prosody_sentiment",
        F.element_at(literal_map(fixed.SYNTHETIC_TAGS), F.col("prosody_sentiment")).alias(
            "emotion_tag"
        ),
        (F.col("text_sentiment") == F.col("prosody_sentiment")).alias("is_congruent"),
    )


def prompt_grid(speakers: DataFrame, *, reduced: bool = False) -> DataFrame:
    """Reading prompts per speaker: carriers x delivery, plus the whispered ones.

    Whisper prompts have no delivery target (NULL prosody_sentiment).
    """
    deliveries = ["positive", "negative"] if reduced else list(LABELS)
    g = _with_carriers(speakers, 2 if reduced else 3)
    g = cross_factor(g, "prosody_sentiment", deliveries)
    prompts = g.select(
        F.concat_ws(
            "_",
            F.lit("e3"),
            "speaker_id",
            "text_sentiment",
            F.col("carrier_index").cast("string"),
            "prosody_sentiment",
        ).alias("clip_id"),
        "speaker_id",
        "text",
        "text_sentiment",
        "prosody_sentiment",
    )
    if reduced:
        return prompts
    whispers = speakers.select(
        "speaker_id", F.posexplode(F.array(*[F.lit(t) for t in fixed.WHISPER_PROMPTS]))
    ).select(
        F.concat_ws(
            "_", F.lit("e3"), "speaker_id", F.lit("whisper"), F.col("pos").cast("string")
        ).alias("clip_id"),
        "speaker_id",
        F.col("col").alias("text"),
        F.lit("neutral").alias("text_sentiment"),
        F.lit(None).cast("string").alias("prosody_sentiment"),
    )
    return prompts.unionByName(whispers)


def prompt_manifest(prompts: DataFrame) -> DataFrame:
    """A prompt without a delivery target takes the label of its words."""
    filled = prompts.withColumn(
        "prosody_sentiment", F.coalesce("prosody_sentiment", "text_sentiment")
    )
    return filled.withColumn(
        "is_congruent", F.col("text_sentiment") == F.col("prosody_sentiment")
    )


def tag_grid(texts: DataFrame) -> DataFrame:
    """Every known tag, ambiguous ones included, per carrier row (carrier, text)."""
    tags = sorted(
        {t for ts in fixed.EMOTION_TAGS["cartesia"].values() for t in ts}
        | set(fixed.AMBIGUOUS_TAGS)
    )
    g = cross_factor(texts, "tag", tags)
    return g.withColumn("clip_id", F.concat_ws("_", F.lit("d0"), "tag", "carrier"))


def comparison_grid(best_cell: DataFrame) -> DataFrame:
    """The chosen cell's emotions again, under the alternate model id."""
    g = cross_factor(best_cell, "emotion", fixed.PROBE_EMOTIONS)
    factors = ("emotion", "text_condition", "length", "speed_condition")
    args = [F.col(c) for c in factors[:3]]
    return g.select(
        F.concat_ws("_", F.lit("d1"), *factors, F.lit("sonic35")).alias("clip_id"),
        *factors,
        probe_text(*args).alias("text"),
        F.when(
            F.col("speed_condition") == "adjusted",
            F.try_element_at(literal_map(fixed.PROBE_SPEED), F.col("emotion")),
        ).alias("speed"),
        F.lit(fixed.PROBE_ALT_MODEL).alias("model_id"),
        carrier_group(*args).alias("carrier_group"),
    )
