"""Declared schemas and closed value domains."""

from __future__ import annotations

from pyspark.sql import types as T

from tonemark.fixed_values import DESCRIPTORS

# Canonical class order. It fixes the layout of probability vectors and of the
# confusion matrix, and it breaks ties in every argmax.
LABELS = ("negative", "neutral", "positive")
SOURCES = ("crema_d", "synthetic", "recorded", "hume")
TRAIN, VAL, TEST = "train", "val", "test"
SAMPLE_RATE = 16_000

MANIFEST_COLUMNS = (
    "clip_id",
    "path",
    "speaker_id",
    "source",
    "text",
    "text_sentiment",
    "prosody_sentiment",
    "emotion_tag",
    "voice_id",
    "is_congruent",
    "split",
)

MANIFEST = T.StructType(
    [
        T.StructField(name, T.BooleanType() if name == "is_congruent" else T.StringType())
        for name in MANIFEST_COLUMNS
    ]
)

VAD = T.StructType([T.StructField(n, T.DoubleType()) for n in ("valence", "arousal", "dominance")])

PREDICTION = T.StructType(
    [
        T.StructField("clip_id", T.StringType()),
        T.StructField("solution", T.StringType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("probs", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("abstained", T.BooleanType()),
        T.StructField("vad", VAD),
        T.StructField("transcript", T.StringType()),
    ]
)

FEATURES = T.StructType(
    [
        T.StructField("clip_id", T.StringType()),
        T.StructField("features", T.ArrayType(T.FloatType())),
    ]
)

CLIP_PREDICTION = T.StructType(
    [
        T.StructField("clip_id", T.StringType()),
        T.StructField("prosody_sentiment", T.StringType()),
        T.StructField("text_sentiment", T.StringType()),
        T.StructField("is_congruent", T.BooleanType()),
        T.StructField("predicted_sentiment", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("abstained", T.BooleanType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("transcript", T.StringType()),
    ]
)

EVAL_RESULT = T.StructType(
    [
        T.StructField("solution", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("split_type", T.StringType()),
        T.StructField("n_clips", T.LongType()),
        T.StructField("n_incongruent", T.LongType()),
        T.StructField("uar", T.DoubleType()),
        T.StructField("macro_f1", T.DoubleType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("ece", T.DoubleType()),
        T.StructField("psi_contested", T.DoubleType()),
        T.StructField("psi_strict", T.DoubleType()),
        T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("confusion_labels", T.ArrayType(T.StringType())),
        T.StructField("abstention_rate", T.DoubleType()),
        T.StructField("latency_p50_ms", T.DoubleType()),
        T.StructField("latency_p95_ms", T.DoubleType()),
        T.StructField("git_sha", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("predictions", T.ArrayType(CLIP_PREDICTION)),
    ]
)

MEASUREMENT = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("take", "clip_id", "carrier", "intended", "text_sentiment")
    ]
    + [T.StructField(n, T.DoubleType()) for n in DESCRIPTORS]
    + [T.StructField("permissive_predicted_sentiment", T.StringType())]
    + [
        T.StructField(n, T.DoubleType())
        for n in ("permissive_valence_proxy", "research_valence", "research_arousal")
    ]
)


class ManifestError(ValueError):
    """A table breaks the manifest contract."""


class SplitError(AssertionError):
    """A speaker sits on both sides of a split."""
