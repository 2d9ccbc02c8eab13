"""Columns of the table that are called like those of the operators keep their values."""

import pytest

from tonemark.llm import exact_dedup, latent_retrieval, lsh_forest, neighbour_quality
from tonemark.llm.common import fresh


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "name long, NAME_ long, other long")
    assert fresh(df, "name", "id", "id", "other") == ["name__", "id", "id_", "other_"]


@pytest.mark.parametrize("operator", ["exact", "near", "leaks", "quality"])
def test_all_columns_stay(spark, odd, operator):
    items = spark.createDataFrame([(1, "while seven grey wolves watch from a distant hill none of them")], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 15)], "doc_id long, quality int, toxic int")
    kept = {
        "exact": lambda: exact_dedup.keep(odd),
        "near": lambda: lsh_forest.keep(odd),
        "leaks": lambda: latent_retrieval.keep(odd, items),
        "quality": lambda: neighbour_quality.keep(odd, labels),
    }[operator]()
    assert kept.columns == odd.columns
    rows = set(map(tuple, odd.collect()))
    assert set(map(tuple, kept.collect())) <= rows and kept.count()
