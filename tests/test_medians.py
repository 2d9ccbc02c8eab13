import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tonemark.operators import calibration, medians


@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=30))
def test_integers_keep_the_order(values):
    x = np.array(values) + 0.0
    keys = medians.ordered(x)
    assert (medians.unordered(keys) == x).all()
    assert (np.argsort(keys, kind="stable") == np.argsort(x, kind="stable")).all()


def vectors(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 6)) * [1, 1e-300, 1e300, 1, 1, 1]
    x[:, 3] = rng.integers(-1, 2, n)
    x[:, 4] = np.nan
    x[rng.random((n, 6)) < 0.2] = np.nan
    rows = [([None if np.isnan(v) and i % 2 else float(v) for v in r],) for i, r in enumerate(x)]
    return x, spark.createDataFrame([*rows, (None,), ([],)], "features array<double>").repartition(5)


@pytest.mark.parametrize("gathered", [0, 40, 10**6])
@pytest.mark.parametrize("n", [1, 2, 41, 500])
def test_medians_equal_numpy(spark, gathered, n):
    x, df = vectors(spark, n, n)
    got = medians.vector_medians(df, 6, gathered=gathered, digit=16)
    for d in range(6):
        known = x[:, d][~np.isnan(x[:, d])]
        assert got[d] == (pytest.approx(np.median(known), rel=1e-12) if len(known) else None)


def test_no_rows_and_no_values(spark):
    _, df = vectors(spark, 10, 0)
    assert medians.vector_medians(df.limit(0), 3) == [None] * 3
    filled = calibration.impute(df.limit(0), calibration.median_vector(df, 6))
    assert filled.count() == 0
