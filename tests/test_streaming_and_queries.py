import glob
import os

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tonemark.plans.stream_queries import StreamViews, requests
from tonemark.plans.views import Views
from tonemark.streaming import feature_store, scoring
from tools.check import canonical, rows_of


def test_stream_equals_batch(spark, tmp_path):
    batch = scoring.score_requests(requests(Views(spark, SF)), weight=0.4, abstain_threshold=0.6)
    live = scoring.score_requests(
        requests(StreamViews(spark, SF)), weight=0.4, abstain_threshold=0.6
    )
    paths = str(tmp_path / "t"), str(tmp_path / "c")
    table = scoring.drain_to_table(live, *paths)
    assert sorted(map(str, table.collect())) == sorted(map(str, batch.collect()))
    # A restarted query finds nothing new.
    assert scoring.drain_to_table(live, *paths).count() == batch.count()


def test_refused_requests_keep_their_row(spark):
    scored = scoring.score_requests(requests(Views(spark, SF)))
    refused = scored.where("reason IS NOT NULL")
    assert not refused.isEmpty()
    assert refused.where("sentiment IS NOT NULL OR confidence IS NOT NULL").isEmpty()


def test_stream_store_is_idempotent(spark, tmp_path):
    clips = StreamViews(spark, SF).features.withColumn("payload", F.col("features"))

    def embed(x):
        return x

    store = str(tmp_path / "s")
    first = feature_store.run(clips, embed, 64, store, str(tmp_path / "c1")).count()
    # A second stream with a fresh checkpoint replays every clip.
    second = feature_store.run(clips, embed, 64, store, str(tmp_path / "c2")).count()
    assert first == second == Views(spark, SF).features.count()


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() == 8


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


CHECKED = [
    "evaluate_all", "manifest_scan", "corpus_listing_ingest", "map_emotion", "fuse_probs",
    "speaker_disjoint_assert", "factorial_grid", "combo_eval_matrix", "degeneracy",
    "majority_baseline", "cuts", "contour_features", "speaker_z_loo", "detection_ranking",
    "f0_rank_consistency", "dedupe_clips", "speaker_disjoint_split", "random_split",
    "stratified_subset", "skewed_draw", "fit_valence_thresholds", "impute_median",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[:-8]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, name):
    df = entry_point.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = db.execute(entry_point.oracle_sql()[name])
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    assert got and got == want
    assert canonical(-0.0) == canonical(0.0)
