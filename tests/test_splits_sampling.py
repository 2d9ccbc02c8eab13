import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tonemark.operators import sampling, splits
from tonemark.operators.grids import (
    comparison_grid, delivery_grid, described_grid, emotion_probe_grid, prompt_grid,
    prompt_manifest, synthetic_grid,
)
from tonemark.operators.joins import assert_speaker_disjoint, split_violations
from tonemark.schema import LABELS


@pytest.fixture(scope="module")
def speakers(spark):
    i = F.col("id")
    return spark.range(100).select(
        F.concat(F.lit("c"), i.cast("string")).alias("clip_id"),
        F.concat(F.lit("s"), F.floor(i / 5).cast("string")).alias("speaker_id"),
    )


def assignment(df):
    return {r["clip_id"]: r["split"] for r in df.collect()}


def test_speaker_split(speakers):
    out = splits.speaker_disjoint_split(speakers, seed=1)
    assert_speaker_disjoint(out)
    counts = {r[0]: r[1] for r in out.groupBy("split").count().collect()}
    assert counts == {"test": 20, "val": 10, "train": 70}
    assert assignment(out) == assignment(splits.speaker_disjoint_split(speakers.repartition(7), seed=1))
    assert assignment(out) != assignment(splits.speaker_disjoint_split(speakers, seed=2))


def test_too_few_speakers(speakers):
    two = speakers.where("speaker_id IN ('s0', 's1')")
    with pytest.raises(PySparkException, match="too few speakers"):
        splits.speaker_disjoint_split(two, test_frac=0.4, val_frac=0.4).collect()
    with pytest.raises(ValueError):
        splits.random_split(two, test_frac=0.8, val_frac=0.4)


def test_random_split_leaks(speakers):
    out = splits.random_split(speakers)
    counts = {r[0]: r[1] for r in out.groupBy("split").count().collect()}
    assert counts == {"test": 20, "val": 10, "train": 70}
    assert not split_violations(out).isEmpty()


@pytest.fixture(scope="module")
def balanced(spark):
    i = F.col("id")
    return spark.range(54).select(
        F.concat(F.lit("c"), i.cast("string")).alias("clip_id"),
        F.concat(F.lit("s"), (i % 2).cast("string")).alias("speaker_id"),
        F.element_at(
            F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")),
            (F.floor(i / 2) % 3 + 1).cast("int"),
        ).alias("prosody_sentiment"),
    )


def test_skew_holds_within_each_speaker(balanced):
    draws = sampling.skewed_draws(balanced, keep={"strong": 0.22}, seeds=2)
    one = draws.where("majority = 'negative' AND seed = 0")
    per = {
        (r["speaker_id"], r["prosody_sentiment"]): r["count"]
        for r in one.groupBy("speaker_id", "prosody_sentiment").count().collect()
    }
    assert sum(n for (_, c), n in per.items() if c == "negative") == 18
    for s in ("s0", "s1"):
        mine = {c: n for (x, c), n in per.items() if x == s}
        assert mine == {"negative": 9, "neutral": 2, "positive": 2}
        assert mine["negative"] / sum(mine.values()) > 0.6
    ids = [sorted(r[0] for r in draws.where(f"majority='negative' AND seed={s}").select("clip_id").collect()) for s in (0, 1)]
    assert ids[0] != ids[1]


def test_balanced_draw_keeps_everything(balanced):
    draws = sampling.skewed_draws(balanced, keep={"balanced": 1.0}, seeds=1)
    assert draws.count() == 3 * 54


def test_stratified_subset(balanced):
    skewed = balanced.where("prosody_sentiment = 'negative' OR clip_id IN ('c2', 'c4')")
    out = sampling.stratified_subset(skewed, 9)
    counts = {r[0]: r[1] for r in out.groupBy("prosody_sentiment").count().collect()}
    # 9 * 18 / 20 = 8.1, and 9 / 20 rounds to 0 but one row is kept.
    assert counts == {"negative": 8, "neutral": 1, "positive": 1}


def test_fill_takes_one_per_stratum_first(balanced):
    out = sampling.sample_with_fill(balanced, ["speaker_id"], "prosody_sentiment", 4)
    for s in ("s0", "s1"):
        mine = [r for r in out.collect() if r["speaker_id"] == s]
        assert len(mine) == 4
        assert {r["prosody_sentiment"] for r in mine if r["picked_as"] == "stratum"} == {
            "negative", "neutral", "positive",
        }


def test_dedupe_takes_the_first_by_priority(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "clip_id string, p int, v string")
    got = {r["clip_id"]: r["v"] for r in sampling.dedupe(df, "clip_id", ["p"]).collect()}
    assert got == {"a": "y", "b": "z"}


def test_grid_sizes(spark):
    voice = spark.createDataFrame([("Ava Song",)], "voice string")
    probe = emotion_probe_grid(voice)
    assert probe.count() == probe.select("clip_id").distinct().count() == 40
    assert probe.select("carrier_group").distinct().count() == 12
    assert probe.where("speed IS NULL").count() == 20
    assert probe.where("text IS NULL").isEmpty()
    assert described_grid(voice).count() == 40
    e5 = delivery_grid(voice)
    assert e5.count() == e5.select("clip_id").distinct().count() == 45
    assert e5.where("NOT is_congruent").count() == 30
    assert "e5_ava_song_positive0_negative" in {r[0] for r in e5.select("clip_id").collect()}
    assert synthetic_grid(voice).count() == 45
    cell = spark.createDataFrame([("neutral", "short", "adjusted")], "text_condition string, length string, speed_condition string")
    assert comparison_grid(cell).count() == 5


def test_prompts(spark):
    speaker = spark.createDataFrame([("speaker1",)], "speaker_id string")
    full = prompt_manifest(prompt_grid(speaker))
    assert full.count() == 30
    whisper = full.where(F.col("clip_id").contains("whisper"))
    assert whisper.count() == 3 and whisper.where("NOT is_congruent").isEmpty()
    assert prompt_grid(speaker, reduced=True).count() == 12


def test_combo_forces_extras_into_train(spark):
    base = spark.createDataFrame([("a", "test")], "clip_id string, split string")
    extra = spark.createDataFrame([("", "b")], "split string, clip_id string")
    got = {r["clip_id"]: r["split"] for r in sampling.combo_train_set(base, [extra]).collect()}
    assert got == {"a": "test", "b": "train"}


def draws_by_sorting(rows, keep, seeds, minimum=2):
    """(clip, level, majority, seed) of every draw by sorting the hashes of whole groups."""
    import hashlib

    groups = {}
    for clip, speaker, label in rows:
        groups.setdefault((speaker, label), []).append(clip)
    out = []
    for (_, label), clips in groups.items():
        for level, share in keep.items():
            for majority in LABELS:
                for seed in range(seeds):
                    key = f"{level}|{majority}|{seed}"
                    order = sorted(
                        clips, key=lambda c: (int(hashlib.md5((f"{key}|{c}" if c else key).encode()).hexdigest()[:15], 16), c is not None, c or "")
                    )
                    n = len(clips) if label == majority or share >= 1 else max(minimum, round(share * len(clips)))
                    if label in LABELS:
                        out += [(c, level, majority, seed) for c in order[:n]]
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_rows", [None, 40])
def test_skewed_draws_by_sorting(spark, slice_rows):
    """Small, hot, NULL and unknown groups; groups cut into slices give the same rows."""
    rows = [(f"h{k}", "hot", LABELS[k % 3]) for k in range(400)]
    rows += [(f"s{k}", f"small{k % 5}", LABELS[k % 2]) for k in range(21)] + [("one", "single", "neutral")]
    rows += [(f"n{k}", None, "negative") for k in range(30)] + [("x1", "hot", "other"), ("x2", "hot", None), (None, "hot", "positive")]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "clip_id string, speaker_id string, prosody_sentiment string, cuts double")
    keep = {"balanced": 1.0, "moderate": 0.45, "strong": 0.22}
    got = sampling.skewed_draws(df, keep=keep, seeds=2, slice_rows=slice_rows)
    assert got.columns == [*df.columns, "level", "majority", "seed"]
    found = [(r.clip_id, r.level, r.majority, r.seed) for r in got.collect()]
    assert sorted(found, key=str) == draws_by_sorting(rows, keep, 2)


def test_missed_cuts_are_looked_for_again(spark):
    """A part of the hash space far too narrow is widened until it holds every cut."""
    rows = [(f"h{k}", "hot", LABELS[k % 3]) for k in range(600)]
    df = spark.createDataFrame(rows, "clip_id string, speaker_id string, prosody_sentiment string")
    groups, draws = ["speaker_id", "prosody_sentiment"], sampling.draw_list(seeds=2)
    cuts = [
        sorted(map(str, sampling.cut_finder(df, groups, groups[1], draws, minimum=2, slice_rows=n, width=w).collect()))
        for n, w in ((None, 8.0), (30, 8.0), (30, 1e-4))
    ]
    assert cuts[0] == cuts[1] == cuts[2]


def test_no_rows_no_draws(spark):
    df = spark.createDataFrame([], "clip_id string, speaker_id string, prosody_sentiment string")
    assert sampling.skewed_draws(df).collect() == []
