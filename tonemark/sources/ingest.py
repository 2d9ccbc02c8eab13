"""Corpora in their own layouts to manifest rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemark import fixed_values as fixed
from tonemark.functions.labels import file_stem, literal_map, map_emotion, probe_text
from tonemark.schema import LABELS, MANIFEST_COLUMNS, ManifestError
from tonemark.sources.manifest import add_congruence

PROBE_FILE = T.StructType(
    [
        T.StructField(
            "per_clip",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("clip_id", T.StringType()),
                        T.StructField("emotion", T.StringType()),
                        T.StructField("text_condition", T.StringType()),
                        T.StructField("length", T.StringType()),
                        T.StructField("has_description", T.BooleanType()),
                    ]
                )
            ),
        )
    ]
)


def acted_listing(listing: DataFrame) -> DataFrame:
    """Parse file names; `reason` is NULL for rows that are usable."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    parts = [F.regexp_extract(name, fixed.ACTED_FILE, i) for i in (1, 2, 3)]
    parsed = listing.select(
        "path",
        name.alias("_name"),
        *[p.alias(c) for p, c in zip(parts, ("speaker_id", "_code", "emotion_tag"), strict=True)],
    )
    mapped = map_emotion(F.col("emotion_tag"), "crema_d")
    text = F.try_element_at(literal_map(fixed.SENTENCE_CODES), F.col("_code"))
    reason = (
        F.when(F.col("speaker_id") == "", "unexpected file name")
        .when(text.isNull(), "unknown sentence code")
        .when(mapped["status"] != "mapped", F.concat(mapped["status"], F.lit(" emotion tag")))
    )
    rows = parsed.select(
        F.concat(F.lit("cremad_"), file_stem(F.col("path"))).alias("clip_id"),
        "path",
        "speaker_id",
        F.lit("crema_d").alias("source"),
        text.alias("text"),
        F.lit("neutral").alias("text_sentiment"),
        mapped["sentiment"].alias("prosody_sentiment"),
        "emotion_tag",
        F.lit("").alias("voice_id"),
        F.lit("").alias("split"),
        reason.alias("reason"),
    )
    return add_congruence(rows)


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).select(*MANIFEST_COLUMNS)


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select("path", "reason")


def require_all(parsed: DataFrame, show: int = 10) -> DataFrame:
    bad = quarantined(parsed).limit(show).collect()
    if bad:
        raise ManifestError("unusable files, e.g. " + "; ".join(f"{r[0]}: {r[1]}" for r in bad))
    return accepted(parsed)


def require_counts(
    manifest: DataFrame,
    n_clips: int = fixed.ACTED_CLIPS,
    n_speakers: int = fixed.ACTED_SPEAKERS,
) -> None:
    got = manifest.agg(F.count(F.lit(1)), F.count_distinct("speaker_id")).first()
    if tuple(got) != (n_clips, n_speakers):
        raise ManifestError(f"expected {(n_clips, n_speakers)} clips and speakers, got {tuple(got)}")


def _by_prefix(value: Column, prefixes: Mapping[str, str]) -> Column:
    """First listed prefix that fits."""
    hits = F.coalesce(*[F.when(value.startswith(p), F.lit(s)) for p, s in prefixes.items()])
    return hits


def recorded_metadata(
    metadata: DataFrame,
    speakers: Mapping[str, str],
    valence: Mapping[str, str] | None = None,
    *,
    out_dir: str,
    id_prefix: str = "e6",
) -> DataFrame:
    """Session metadata to manifest rows; `reason` is NULL for usable rows."""
    folder = F.element_at(F.split("audio_path", "/"), 3)
    speaker = _by_prefix(folder, speakers)
    text_label = F.try_element_at(
        literal_map(valence or fixed.SENTENCE_VALENCE), F.col("sentence_text")
    )
    label = F.lower("sentiment")
    clip_id = F.concat_ws(
        "_", F.lit(id_prefix), speaker, F.substring("recording_id", 1, 8)
    )
    split = F.when(F.col("dataset_split") == "validation", "val").otherwise(F.col("dataset_split"))
    reason = (
        F.when(speaker.isNull(), "unknown speaker folder")
        .when(text_label.isNull(), "sentence without a valence")
        .when(~label.isin(*LABELS), "unknown sentiment")
    )
    rows = metadata.select(
        clip_id.alias("clip_id"),
        F.concat(F.lit(out_dir.rstrip("/") + "/"), clip_id, F.lit(".wav")).alias("path"),
        speaker.alias("speaker_id"),
        F.lit("recorded").alias("source"),
        F.col("sentence_text").alias("text"),
        text_label.alias("text_sentiment"),
        label.alias("prosody_sentiment"),
        F.lit("").alias("emotion_tag"),
        F.lit("").alias("voice_id"),
        split.alias("split"),
        reason.alias("reason"),
    )
    return add_congruence(rows)


def probe_manifest(
    probe: DataFrame,
    *,
    audio_dir: str = "data/probes/hume",
    speaker_id: str = "hume_ava_song",
    voice_id: str = "Ava Song",
) -> DataFrame:
    """Nested probe records to manifest rows, described clips only."""
    clips = probe.select(F.explode("per_clip").alias("c")).select("c.*")
    intended = F.try_element_at(literal_map(fixed.PROBE_SENTIMENT), F.col("emotion"))
    rows = clips.where("has_description").select(
        "clip_id",
        F.concat(F.lit(audio_dir + "/"), "clip_id", F.lit(".wav")).alias("path"),
        F.lit(speaker_id).alias("speaker_id"),
        F.lit("hume").alias("source"),
        probe_text(F.col("emotion"), F.col("text_condition"), F.col("length")).alias("text"),
        F.when(F.col("text_condition") == "neutral", "neutral")
        .otherwise(intended)
        .alias("text_sentiment"),
        intended.alias("prosody_sentiment"),
        F.col("emotion").alias("emotion_tag"),
        F.lit(voice_id).alias("voice_id"),
        F.lit("").alias("split"),
    )
    return add_congruence(rows).select(*MANIFEST_COLUMNS)
