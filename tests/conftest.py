import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the package too.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def views(spark):
    from tonemark.plans.views import Views

    return Views(spark, SF)


def clip_rows(spark, rows):
    """(clip_id, text label, prosody label[, predicted]) rows as a small clip table."""
    out = []
    for i, row in enumerate(rows):
        text, prosody = row[0], row[1]
        predicted = row[2] if len(row) > 2 else prosody
        out.append((f"c{i}", f"s{i % 3}", text, prosody, text == prosody, predicted, 0.9, False, 1.0))
    return spark.createDataFrame(
        out,
        "clip_id string, speaker_id string, text_sentiment string, prosody_sentiment string, "
        "is_congruent boolean, sentiment string, confidence double, abstained boolean, "
        "latency_ms double",
    )
