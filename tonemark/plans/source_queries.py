"""Sources, sinks and validation over the driver tables."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tonemark import fixed_values as fixed
from tonemark.operators import joins, metrics
from tonemark.plans.metric_queries import _evaluate_sql, joined
from tonemark.plans.registry import query
from tonemark.plans.shape import tidy
from tonemark.plans.views import CLIPS, FEATS, PREDS, const, label_at, with_
from tonemark.schema import DESCRIPTORS, LABELS, MANIFEST_COLUMNS, SOURCES
from tonemark.sources import feature_store, ingest, manifest, pcm, results
from tonemark.sources.storage import new_path

COLS = ", ".join(f'"{c}"' for c in MANIFEST_COLUMNS)
VOICELESS = with_(CLIPS) + f"""SELECT {COLS.replace('"voice_id"',
    "CASE WHEN value < 20 THEN '' ELSE voice_id END AS voice_id")} FROM clips"""


def sparse_voice(v):
    """The clip manifest with NULL voices, as corpora without voices deliver it."""
    return v.clips.withColumn("voice_id", F.when(F.col("value") >= 20, F.col("voice_id")))


@query("manifest_scan", VOICELESS)
def _(v):
    path = new_path(v.spark, "manifest")
    sparse_voice(v).select(*MANIFEST_COLUMNS).write.option("header", True).csv(path)
    return manifest.scan(v.spark, path)


@query("manifest_sink", with_(CLIPS) + f"SELECT {COLS} FROM clips")
def _(v):
    path = new_path(v.spark, "manifest")
    manifest.sink(v.manifest, path, fmt="parquet")
    return v.spark.read.parquet(path).select(*MANIFEST_COLUMNS)


@query(
    "validate_columns",
    "SELECT c AS \"column\", c IN ('text','source') AS present, CASE c "
    "WHEN 'text' THEN (SELECT count(*) FILTER (WHERE text IS NULL) FROM documents) "
    "WHEN 'source' THEN (SELECT count(*) FILTER (WHERE source IS NULL) FROM documents) "
    "ELSE (SELECT count(*) FROM documents) END AS n_null FROM (VALUES "
    + ",".join(f"('{c}')" for c in MANIFEST_COLUMNS)
    + ") t(c)",
)
def _(v):
    return tidy(manifest.column_report(v.table("documents")))


@query(
    "validate_unique",
    """SELECT l_orderkey||'-'||l_linenumber AS clip_id, count(*) AS n FROM lineitem
    GROUP BY 1 HAVING count(*) > 1""",
)
def _(v):
    rows = v.table("lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        .alias("clip_id")
    )
    return manifest.duplicates(rows)


@query(
    "validate_speaker",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE quality IS NULL) AS n_blank
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(v):
    # Documents without a label stand for clips without a speaker.
    speaker = F.col("quality").cast("string")
    return v.texts.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(manifest.blank(speaker)).alias("n_blank")
    )


@query(
    "validate_domain",
    """SELECT 'event_type' AS "column", event_type AS value, count(*) AS n FROM events
      GROUP BY event_type
    UNION ALL SELECT 'source', source, count(*) FROM documents
      WHERE source NOT IN ('crema_d','synthetic','recorded','hume') OR source IS NULL
      GROUP BY source""",
)
def _(v):
    labels = manifest.outside_domain(v.table("events"), "event_type", LABELS)
    sources = manifest.outside_domain(v.table("documents"), "source", SOURCES)
    return labels.select(F.lit("event_type").alias("column"), "value", "n").unionByName(
        sources.select(F.lit("source").alias("column"), "value", "n")
    )


@query(
    "validate_congruence",
    with_(CLIPS)
    + """SELECT source, count(*) FILTER (WHERE (value < 35) <> is_congruent) AS n_inconsistent
    FROM clips GROUP BY source""",
)
def _(v):
    declared = v.clips.withColumn("is_congruent", F.col("value") < 35)
    return declared.groupBy("source").agg(
        manifest.incongruence_errors(declared).alias("n_inconsistent")
    )


@query(
    "validate_files",
    with_(CLIPS) + "SELECT path, clip_id FROM clips WHERE value < 20",
)
def _(v):
    listing = v.clips.where("value >= 20").select("path")
    return manifest.missing_files(v.clips, listing).select("path", "clip_id")


@query(
    "manifest_violations",
    with_(CLIPS)
    + """SELECT 'blank speaker_id' AS rule,
        count(*) FILTER (WHERE speaker_id IS NULL OR trim(speaker_id) = '') AS n_violations
      FROM clips
    UNION ALL SELECT 'text_sentiment outside domain', 0
    UNION ALL SELECT 'prosody_sentiment outside domain', count(*) FILTER
      (WHERE emotion_tag NOT IN ('negative','neutral','positive')) FROM clips
    UNION ALL SELECT 'source outside domain', 0
    UNION ALL SELECT 'is_congruent inconsistent', count(*) FILTER
      (WHERE is_congruent <> (text_sentiment = emotion_tag)) FROM clips
    UNION ALL SELECT 'duplicate clip_id', count(*) FROM
      (SELECT speaker_id FROM clips GROUP BY speaker_id HAVING count(*) > 1)""",
)
def _(v):
    # Raw tags as labels and speakers as ids: a corpus that was not mapped yet.
    raw = v.clips.withColumn("prosody_sentiment", F.col("emotion_tag")).withColumn(
        "clip_id", F.col("speaker_id")
    )
    return tidy(manifest.violations(raw))


@query(
    "manifest_summary",
    with_(CLIPS)
    + """SELECT count(*) AS n_clips, count(DISTINCT speaker_id) AS n_speakers,
      count(*) FILTER (WHERE NOT is_congruent) AS n_incongruent,
      string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM clips""",
)
def _(v):
    return manifest.summary(v.clips)


RESULT_NAMES = """solution, dataset, split_type, n_clips, n_incongruent, uar, macro_f1, accuracy,
    ece, psi_contested, psi_strict, abstention_rate, latency_p50_ms, latency_p95_ms"""
RESULT_COLUMNS = [c.strip() for c in RESULT_NAMES.split(",")]


def _results(v):
    rows = joined(v).withColumn("dataset", F.col("source")).withColumn("split_type", F.lit("all"))
    named = rows.withColumn("solution", F.concat("solution", F.lit(":model/1")))
    return metrics.as_results(metrics.evaluate(named))


RESULTS_SQL = (
    "SELECT {cols} FROM ("
    + _evaluate_sql("source AS dataset, 'all' AS split_type")
    + ")"
)


@query(
    "result_sink",
    RESULTS_SQL.format(
        cols=RESULT_NAMES.replace("solution,", "solution||':model/1' AS solution,")
        + ", solution||'_model_1__'||dataset||'__all' AS result_name"
    ),
)
def _(v):
    path = new_path(v.spark, "results")
    results.sink_results(_results(v), path, fmt="parquet")
    return tidy(v.spark.read.parquet(path).select(*RESULT_COLUMNS, "result_name"))


@query(
    "result_scan",
    RESULTS_SQL.format(cols=RESULT_NAMES.replace("solution,", "solution||':model/1' AS solution,")
    + ", c_neg_neg + c_neu_neu + c_pos_pos AS n_right"),
)
def _(v):
    path = new_path(v.spark, "results")
    results.sink_results(_results(v), path)
    # A partial record and an unreadable file beside the full results.
    partial = v.clips.groupBy("source").agg(F.count(F.lit(1)).alias("n_clips"))
    partial.coalesce(1).write.json(f"{path}/result_name=partial")
    partial.select(F.concat(F.lit("{"), "source").alias("value")).coalesce(1).write.text(
        f"{path}/result_name=broken"
    )
    matrix = F.col("confusion_matrix")
    return tidy(
        results.scan_results(v.spark, path).select(
            *RESULT_COLUMNS, (matrix[0][0] + matrix[1][1] + matrix[2][2]).alias("n_right")
        )
    )


@query(
    "result_explode",
    with_(CLIPS, PREDS)
    + """SELECT solution, clip_id, prosody_sentiment, text_sentiment, is_congruent,
      sentiment AS predicted_sentiment, round(confidence, 6) AS confidence, abstained,
      latency_ms, text AS transcript FROM preds""",
)
def _(v):
    rows = joined(v).withColumn("transcript", F.col("text"))
    nested = results.nest_predictions(rows, ["solution"])
    return tidy(results.explode_predictions(nested, ["solution"]))


@query(
    "measurements_io",
    with_(FEATS)
    + "SELECT 'take'||(vec_id%2) AS take, clip_id, text AS carrier, prosody_sentiment AS intended,"
    + ", ".join(f"round(features[{i + 1}], 6) AS {n}" for i, n in enumerate(DESCRIPTORS[:3]))
    + ", round(features[10], 6) AS permissive_valence_proxy, NULL::DOUBLE AS research_valence"
    + " FROM feats",
)
def _(v):
    path = new_path(v.spark, "measurements")
    results.sink_measurements(measurements(v).withColumn(
        "research_valence", F.lit(None).cast("double")), path)
    read = results.scan_measurements(v.spark, path)
    return tidy(
        read.select(
            "take", "clip_id", "carrier", "intended", *DESCRIPTORS[:3],
            "permissive_valence_proxy", "research_valence",
        )
    )


def measurements(v):
    """Feature vectors read as a measurement table: one descriptor per dimension."""
    f = F.col("features")
    return v.features.select(
        F.concat(F.lit("take"), (F.col("vec_id") % 2).cast("string")).alias("take"),
        "clip_id",
        F.col("text").alias("carrier"),
        F.col("prosody_sentiment").alias("intended"),
        "text_sentiment",
        "is_congruent",
        "speaker_id",
        *[f[i].alias(n) for i, n in enumerate(DESCRIPTORS)],
        F.col("prosody_sentiment").alias("permissive_predicted_sentiment"),
        f[9].alias("permissive_valence_proxy"),
        f[10].alias("research_valence"),
        f[11].alias("research_arousal"),
        "vec_id",
        "label",
    )


@query(
    "params_io",
    with_(CLIPS, PREDS)
    + """SELECT 0.5::DOUBLE AS weight_lexical, 1.0::DOUBLE AS temperature,
      round(avg(confidence), 6) AS abstain_threshold FROM preds""",
)
def _(v):
    path = new_path(v.spark, "params")
    results.sink_params(
        v.predictions.agg(F.avg("confidence").alias("abstain_threshold")), path
    )
    return tidy(results.scan_params(v.spark, path, fixed.FUSION_DEFAULTS))


FIRST_LAST = """clip_id, len(features)::BIGINT AS width, round(features[1], 6) AS first_value,
    round(features[-1], 6) AS last_value"""


def _vector(payload):
    return np.asarray(payload, dtype=np.float32)


@query("feature_store_append", with_(FEATS) + f"SELECT {FIRST_LAST} FROM feats")
def _(v):
    path = new_path(v.spark, "features")
    clips = v.features.withColumn("payload", F.col("features"))
    feature_store.append(clips.where("split = 'train'"), _vector, 64, path)
    store = feature_store.append(clips, _vector, 64, path)
    return tidy(
        store.select(
            "clip_id",
            F.size("features").alias("width"),
            F.col("features")[0].cast("double").alias("first_value"),
            F.element_at("features", -1).cast("double").alias("last_value"),
        )
    )


SENTENCES = list(fixed.SENTENCE_CODES)
TAGS = ["ANG", "DIS", "FEA", "HAP", "NEU", "SAD", "SUR"]


def _sql_list(values):
    return "[" + ",".join(const(x) for x in values) + "]"


@query(
    "corpus_listing_ingest",
    f"""WITH n AS (SELECT *, printf('%04d', user_id::INT)||'_'||code||'_'||tag||
        CASE WHEN value < 2 THEN '.wav' ELSE '_XX.wav' END AS name FROM (
      SELECT event_id, user_id, value, ({_sql_list(SENTENCES)})[1+event_id%12] AS code,
        ({_sql_list(TAGS)})[1+(event_id*5+user_id)%7] AS tag FROM events))
    SELECT 'AudioWAV/'||event_id||'/'||name AS path,
      'cremad_'||name[:-5] AS clip_id,
      CASE WHEN value < 2 THEN '' ELSE printf('%04d', user_id::INT) END AS speaker_id,
      CASE WHEN value < 2 THEN NULL ELSE (MAP {{{", ".join(
          f"{const(k)}: {const(t)}" for k, t in fixed.SENTENCE_CODES.items())}}})[code] END
        AS text,
      CASE WHEN value < 2 OR tag = 'SUR' THEN NULL WHEN tag = 'HAP' THEN 'positive'
        WHEN tag = 'NEU' THEN 'neutral' ELSE 'negative' END AS prosody_sentiment,
      CASE WHEN value < 2 OR tag = 'SUR' THEN NULL ELSE tag = 'NEU' END AS is_congruent,
      CASE WHEN value < 2 THEN 'unexpected file name'
        WHEN tag = 'SUR' THEN 'unknown emotion tag' END AS reason FROM n""",
)
def _(v):
    e = F.col("event_id")
    from tonemark.functions.labels import pick

    stem = F.concat_ws(
        "_",
        # Four digits at least; lpad would cut longer numbers.
        F.format_string("%04d", F.col("user_id").cast("bigint")),
        pick(SENTENCES, e % 12),
        pick(TAGS, (e * 5 + F.col("user_id")) % 7),
    )
    name = F.concat(stem, F.when(F.col("value") < 2, ".wav").otherwise("_XX.wav"))
    listing = v.table("events").select(
        F.concat(F.lit("AudioWAV/"), e.cast("string"), F.lit("/"), name).alias("path")
    )
    return ingest.acted_listing(listing).select(
        "path", "clip_id", "speaker_id", "text", "prosody_sentiment", "is_congruent", "reason"
    )


FOLDERS = ["Anna_2026", "Ben_2026", "Carla_2026", "Dora_2026"]
PREFIXES = {"Anna": "speaker1", "Ben": "corpus_ben", "Carla": "corpus_carla"}


@query(
    "corpus_metadata_ingest",
    f"""WITH m AS (SELECT ({_sql_list(FOLDERS)})[1+user_id%4] AS folder,
      md5(event_id::VARCHAR) AS rid, {label_at("event_id%3")} AS label,
      ({_sql_list(fixed.SENTENCE_VALENCE)})[1+event_id%35] AS sentence,
      (['train','validation','test'])[1+user_id%3] AS sp FROM events)
    SELECT 'e6_'||spk||'_'||rid[:8] AS clip_id, spk AS speaker_id, sentence AS text,
      tv AS text_sentiment, label AS prosody_sentiment, tv = label AS is_congruent,
      CASE sp WHEN 'validation' THEN 'val' ELSE sp END AS split, count(*) AS n
    FROM (SELECT *, (MAP {{'Anna_2026': 'speaker1', 'Ben_2026': 'corpus_ben',
        'Carla_2026': 'corpus_carla'}})[folder] AS spk,
      (MAP {{{", ".join(f"{const(k)}: {const(t)}" for k, t in fixed.SENTENCE_VALENCE.items())}}})
        [sentence] AS tv FROM m)
    WHERE spk IS NOT NULL GROUP BY ALL""",
)
def _(v):
    from tonemark.functions.labels import pick

    e, u = F.col("event_id"), F.col("user_id")
    metadata = v.table("events").select(
        F.concat(
            F.lit("data/sessions/"), pick(FOLDERS, u % 4), F.lit("/"), e.cast("string")
        ).alias("audio_path"),
        F.md5(e.cast("string")).alias("recording_id"),
        F.initcap(pick(LABELS, e % 3)).alias("sentiment"),
        pick(list(fixed.SENTENCE_VALENCE), e % 35).alias("sentence_text"),
        pick(["train", "validation", "test"], u % 3).alias("dataset_split"),
    )
    rows = ingest.recorded_metadata(metadata, PREFIXES, out_dir="data/corpus")
    return (
        ingest.accepted(rows)
        .groupBy(
            "clip_id", "speaker_id", "text", "text_sentiment", "prosody_sentiment",
            "is_congruent", "split",
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _probe_text_sql(emotion, condition, length):
    whens = " ".join(
        f"WHEN {emotion}={const(e)} AND {length}={const(n)} THEN {const(t)}"
        for e, by in fixed.PROBE_CONGRUENT_TEXT.items()
        for n, t in by.items()
    )
    neutral = " ".join(
        f"WHEN {condition}='neutral' AND {length}={const(n)} THEN {const(t)}"
        for n, t in fixed.PROBE_NEUTRAL_TEXT.items()
    )
    return f"CASE {neutral} {whens} END"


def _probe_sentiment_sql(emotion):
    return (
        f"CASE {emotion} WHEN 'happy' THEN 'positive' WHEN 'calm' THEN 'neutral' "
        "ELSE 'negative' END"
    )


@query(
    "corpus_nested_json_ingest",
    f"""WITH p AS (SELECT event_id,
      ({_sql_list(fixed.PROBE_EMOTIONS)})[1+event_id%5] AS emotion,
      (['neutral','congruent'])[1+user_id%2] AS cond, (['short','long'])[1+event_id%2] AS len,
      value > 30 AS described FROM events)
    SELECT 'hume_'||event_id AS clip_id, 'data/probes/hume/hume_'||event_id||'.wav' AS path,
      'hume_ava_song' AS speaker_id, 'hume' AS source,
      {_probe_text_sql("emotion", "cond", "len")} AS text,
      CASE WHEN cond='neutral' THEN 'neutral' ELSE {_probe_sentiment_sql("emotion")} END
        AS text_sentiment,
      {_probe_sentiment_sql("emotion")} AS prosody_sentiment, emotion AS emotion_tag,
      'Ava Song' AS voice_id,
      cond <> 'neutral' OR emotion = 'calm' AS is_congruent, '' AS split
    FROM p WHERE described""",
)
def _(v):
    from tonemark.functions.labels import pick

    e = F.col("event_id")
    clip = F.struct(
        F.concat(F.lit("hume_"), e.cast("string")).alias("clip_id"),
        pick(fixed.PROBE_EMOTIONS, e % 5).alias("emotion"),
        pick(["neutral", "congruent"], F.col("user_id") % 2).alias("text_condition"),
        pick(["short", "long"], e % 2).alias("length"),
        (F.col("value") > 30).alias("has_description"),
    )
    path = new_path(v.spark, "probe")
    v.table("events").select(F.array(clip).alias("per_clip")).write.json(path)
    return ingest.probe_manifest(v.spark.read.schema(ingest.PROBE_FILE).json(path))


def _wav_bytes(batches):
    for batch in batches:
        out = []
        for values in batch["features"]:
            x = np.asarray(values, dtype=np.float64)
            pcm16 = np.clip(np.round(x * 32767.0), -32768, 32767).astype("<i2")
            buffer = io.BytesIO()
            with wave.open(buffer, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(16_000)
                w.writeframes(pcm16.tobytes())
            out.append(buffer.getvalue())
        yield pd.DataFrame({"clip_id": batch["clip_id"], "path": batch["clip_id"], "content": out})


@query(
    "pcm_ingest",
    with_(FEATS)
    + """, q AS (SELECT clip_id, list_transform(features, lambda x:
        greatest(least(round_even(x*32767.0::DOUBLE, 0), 32767), -32768)::DOUBLE / 32768) AS s
      FROM feats)
    SELECT clip_id, len(s)::BIGINT AS n_samples,
      round(s[1] * (0.95::DOUBLE / list_max(list_transform(s, lambda x: abs(x)))), 6)
        AS first_sample,
      round(list_max(list_transform(s, lambda x: abs(x * (0.95::DOUBLE
        / list_max(list_transform(s, lambda y: abs(y))))))), 6) AS peak FROM q""",
)
def _(v):
    files = v.features.select("clip_id", "features").mapInPandas(
        _wav_bytes, "clip_id string, path string, content binary"
    )
    clips = pcm.decode(files).where(F.col("error").isNull())
    return tidy(
        clips.select(
            "clip_id",
            F.size("samples").alias("n_samples"),
            F.col("samples")[0].alias("first_sample"),
            F.array_max(F.transform("samples", lambda x: F.abs(x))).alias("peak"),
        )
    )


@query(
    "cache_or_compute",
    with_(FEATS)
    + """SELECT clip_id, split = 'train' AS hit, len(features)::BIGINT AS width,
      round(features[1], 6) AS first_value FROM feats""",
)
def _(v):
    store = v.features.where("split = 'train'").select(
        "clip_id", F.col("features").cast("array<float>").alias("features")
    )
    misses = joins.missing_features(v.features, store).withColumn("payload", F.col("features"))
    fresh = feature_store.extract(misses, _vector, 64)
    served = feature_store.served(v.features.drop("features"), store, fresh)
    return tidy(
        served.select(
            "clip_id",
            "hit",
            F.size("features").alias("width"),
            F.col("features")[0].cast("double").alias("first_value"),
        )
    )


@query(
    "embedder_udf",
    with_(FEATS) + f"SELECT {FIRST_LAST} FROM feats",
)
def _(v):
    vectors = feature_store.extract(
        v.features.withColumn("payload", F.col("features")), _vector, 64
    )
    return tidy(
        vectors.select(
            "clip_id",
            F.size("features").alias("width"),
            F.col("features")[0].cast("double").alias("first_value"),
            F.element_at("features", -1).cast("double").alias("last_value"),
        )
    )
