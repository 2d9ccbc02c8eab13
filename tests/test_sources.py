import io
import wave

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tonemark import fixed_values as fixed
from tonemark.functions.labels import map_emotion
from tonemark.operators import joins
from tonemark.schema import MANIFEST, MANIFEST_COLUMNS, ManifestError, SplitError
from tonemark.sources import feature_store, ingest, manifest, pcm, results


def rows(spark, **changes):
    base = {
        "clip_id": "c", "path": "a/b.wav", "speaker_id": "s", "source": "recorded", "text": "t",
        "text_sentiment": "neutral", "prosody_sentiment": "negative", "emotion_tag": "",
        "voice_id": "", "is_congruent": False, "split": "train",
    }
    out = []
    for i in range(3):
        row = dict(base, clip_id=f"c{i}", speaker_id=f"s{i}")
        if i == 1:
            row |= changes
        out.append(tuple(row[c] for c in MANIFEST_COLUMNS))
    return spark.createDataFrame(out, MANIFEST)


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"clip_id": "c0"}, "duplicate clip_id"),
        ({"speaker_id": "  "}, "blank speaker_id"),
        ({"speaker_id": None}, "blank speaker_id"),
        ({"text_sentiment": "glad"}, "text_sentiment outside domain"),
        ({"prosody_sentiment": None}, "prosody_sentiment outside domain"),
        ({"source": "web"}, "source outside domain"),
        ({"is_congruent": True}, "is_congruent inconsistent"),
    ],
)
def test_each_violation_raises(spark, change, message):
    with pytest.raises(ManifestError, match=message):
        manifest.validate_manifest(rows(spark, **change))


def test_valid_manifest_passes(spark):
    manifest.validate_manifest(rows(spark))


def test_missing_column_and_file(spark):
    with pytest.raises(ManifestError, match="missing columns"):
        manifest.validate_manifest(rows(spark).drop("split"))
    listing = spark.createDataFrame([("other.wav",)], "path string")
    with pytest.raises(ManifestError, match="missing files"):
        manifest.validate_manifest(rows(spark), listing)


def test_round_trip_keeps_string_ids(spark, tmp_path):
    df = rows(spark, clip_id="007", voice_id=None)
    df.write.option("header", True).csv(str(tmp_path / "m"))
    read = manifest.scan(spark, str(tmp_path / "m"))
    got = {r["clip_id"]: r for r in read.collect()}
    assert got["007"]["voice_id"] == "" and got["c0"]["is_congruent"] is False
    assert read.columns == list(MANIFEST_COLUMNS)


def test_sink_refuses_an_invalid_manifest(spark, tmp_path):
    with pytest.raises(ManifestError):
        manifest.sink(rows(spark, source="web"), str(tmp_path / "m"))
    assert not (tmp_path / "m").exists()


def test_emotion_mapping_never_defaults(spark):
    tags = spark.createDataFrame([("happy",), ("calm",), ("gleeful",), (None,)], "tag string")
    got = tags.select(map_emotion(F.col("tag"), "cartesia").alias("m")).select("m.*").collect()
    assert [tuple(r) for r in got] == [
        ("positive", "mapped"), (None, "ambiguous"), (None, "unknown"), (None, "unknown"),
    ]
    with pytest.raises(ValueError, match="no tag list"):
        map_emotion(F.col("tag"), "other")
    with pytest.raises(PySparkException, match="ambiguous emotion tag: calm"):
        strict = map_emotion(F.col("tag"), "cartesia", strict=True)["sentiment"]
        tags.where("tag = 'calm'").select(strict).collect()


def test_tag_lists(spark):
    tags = fixed.EMOTION_TAGS["cartesia"]
    flat = [t for ts in tags.values() for t in ts]
    assert len(flat) == len(set(flat)) == 44
    assert not set(flat) & set(fixed.AMBIGUOUS_TAGS)


def test_acted_listing(spark):
    names = ["1001_IEO_ANG_XX.wav", "1040_ITH_SAD_X.wav", "1001_ZZZ_HAP_XX.wav", "notes.wav"]
    parsed = ingest.acted_listing(spark.createDataFrame([(f"d/{n}",) for n in names], "path string"))
    good = {r["clip_id"]: r for r in ingest.accepted(parsed).collect()}
    assert set(good) == {"cremad_1001_IEO_ANG_XX", "cremad_1040_ITH_SAD_X"}
    assert good["cremad_1001_IEO_ANG_XX"]["prosody_sentiment"] == "negative"
    reasons = {r["path"]: r["reason"] for r in ingest.quarantined(parsed).collect()}
    assert reasons == {
        "d/1001_ZZZ_HAP_XX.wav": "unknown sentence code",
        "d/notes.wav": "unexpected file name",
    }
    with pytest.raises(ManifestError, match="unusable files"):
        ingest.require_all(parsed)
    with pytest.raises(ManifestError, match="expected"):
        ingest.require_counts(ingest.accepted(parsed))


def wav(samples, rate=16_000, channels=1):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, dtype="<i2").tobytes())
    return buffer.getvalue()


def test_wav_scan_reports_every_failure(spark, tmp_path):
    (tmp_path / "good.wav").write_bytes(wav([8192, -16384, 0]))
    (tmp_path / "stereo.wav").write_bytes(wav([8192, 0, -8192, 0], channels=2))
    (tmp_path / "rate.wav").write_bytes(wav([1, 2], rate=8_000))
    (tmp_path / "broken.wav").write_bytes(b"no audio")
    (tmp_path / "quiet.wav").write_bytes(wav([0, 0]))
    decoded = pcm.scan_wav(spark, str(tmp_path))
    got = {r["clip_id"]: r for r in decoded.collect()}
    assert got["good"]["samples"] == pytest.approx([0.475, -0.95, 0.0])
    assert got["stereo"]["samples"] == pytest.approx([0.95, -0.95])
    assert got["quiet"]["samples"] == [0.0, 0.0]
    assert got["rate"]["error"] and got["broken"]["error"]
    with pytest.raises(ValueError, match="2 file"):
        pcm.require_decoded(decoded)
    listing = manifest.list_files(spark, str(tmp_path))
    assert {r["path"] for r in listing.collect()} == {f"{n}.wav" for n in got}


def test_feature_store_resumes(spark, tmp_path):
    path = str(tmp_path / "store")
    clips = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", -1.0)], "clip_id string, payload double")

    def embed(x):
        if x < 0:
            raise ValueError("failed")
        return np.array([x, x], dtype=np.float32)

    feature_store.append(clips.where("clip_id = 'a'"), embed, 2, path)
    before = {r["clip_id"]: r["features"] for r in feature_store.scan(spark, path).collect()}
    store = feature_store.append(clips, embed, 2, path)
    got = {r["clip_id"]: r["features"] for r in store.collect()}
    assert set(before) == {"a"} and set(got) == {"a", "b", "c"}
    assert got["a"] == [1.0, 1.0] and all(np.isnan(got["c"]))
    assert feature_store.append(clips, embed, 2, path).count() == 3


def test_a_run_cut_off_midway_keeps_its_commits(spark, tmp_path):
    path = str(tmp_path / "store")
    clips = spark.range(200).selectExpr("concat('c', id) AS clip_id", "cast(id AS double) AS payload")

    def broken(x):
        return np.zeros(3 if x == 150 else 2, dtype=np.float32)

    with pytest.raises(PySparkException):
        feature_store.append(clips, broken, 2, path)
    kept = {r["clip_id"] for r in feature_store.scan(spark, path).collect()}
    assert kept and "c150" not in kept

    def fixed(x):
        # Stored clips are not extracted again.
        return np.full(2, 7.0, dtype=np.float32)

    store = {r["clip_id"]: r["features"][0] for r in feature_store.append(clips, fixed, 2, path).collect()}
    assert len(store) == 200 and {k for k, v in store.items() if v == 0.0} == kept


def test_an_append_reads_its_input_once_and_writes_a_file_a_bucket(spark, tmp_path):
    path = tmp_path / "store"
    read = spark.sparkContext.accumulator(0)

    def reading(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    clips = spark.range(300).selectExpr("concat('c', id) AS clip_id", "cast(id AS double) AS payload").repartition(8)
    counted = clips.mapInArrow(reading, clips.schema)
    feature_store.append(counted, lambda x: np.array([x, x]), 2, str(path))
    assert read.value == 300
    for folder in path.glob("bucket=*"):
        assert len(list(folder.glob("*.parquet"))) == 1
    assert feature_store.append(counted, lambda x: np.array([x, x]), 2, str(path)).count() == 300
    assert read.value == 600


def test_missing_features_raise(spark):
    m = rows(spark)
    store = m.where("clip_id = 'c0'").select("clip_id")
    with pytest.raises(KeyError, match="c1"):
        joins.require_features(m, store)


def test_alignment(spark):
    m = rows(spark)
    p = m.select("clip_id", F.lit("A").alias("solution")).where("clip_id <> 'c2'")
    with pytest.raises(ValueError, match="one to one"):
        joins.require_aligned(m, p)
    joins.require_aligned(m, m.select("clip_id", F.lit("A").alias("solution")))


def test_speaker_leak_raises(spark):
    joins.assert_speaker_disjoint(rows(spark))
    with pytest.raises(SplitError):
        joins.assert_speaker_disjoint(rows(spark, speaker_id="s0", split="test"))
    # Rows outside every split do not count.
    joins.assert_speaker_disjoint(rows(spark, speaker_id="s0", split=""))


def test_params_default_when_absent(spark, tmp_path):
    defaults = fixed.FUSION_DEFAULTS
    assert results.scan_params(spark, None, defaults).first().asDict() == defaults
    path = str(tmp_path / "p")
    results.sink_params(spark.createDataFrame([(0.2,)], "weight_lexical double"), path)
    got = results.scan_params(spark, path, defaults).first().asDict()
    assert got == {"weight_lexical": 0.2, "temperature": 1.0, "abstain_threshold": 0.0}


def test_results_round_trip(spark, tmp_path):
    from conftest import clip_rows

    from tonemark.operators import metrics

    rows = clip_rows(spark, [("neutral", "negative", "negative"), ("neutral", "neutral", "positive")])
    keyed = rows.select(
        "*",
        F.lit("B:acoustic(a/b)").alias("solution"),
        F.lit("d").alias("dataset"),
        F.lit("all").alias("split_type"),
        F.lit("said").alias("transcript"),
    )
    path = str(tmp_path / "results")
    results.sink_results(metrics.as_results(metrics.evaluate(keyed)), path)
    (tmp_path / "results" / "bad.json").write_text("{broken")
    (tmp_path / "results" / "part.json").write_text('{"solution": "A", "n_clips": 3}')
    read = results.scan_results(spark, path).collect()
    assert [(r["solution"], r["n_clips"], r["uar"]) for r in read] == [("B:acoustic(a/b)", 2, 0.5)]
    assert (tmp_path / "results" / "result_name=B_acoustic(a_b)__d__all").exists()
    results.sink_predictions(keyed, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("dataset = 'd'").count() == 2
    nested = results.nest_predictions(keyed, ["solution"])
    flat = results.explode_predictions(nested, ["solution"])
    assert {r["predicted_sentiment"] for r in flat.collect()} == {"negative", "positive"}
