"""Operator 12 against numpy's eigenvectors and plain integers."""

import numpy as np
import pytest

from tonemark.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, n double, vector string"


def plain(vectors):
    """x, deviations, eigenvalues and vectors of a list of equal-length vectors."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    sums = x.sum(axis=0)
    deviation = [sum((len(x) * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    centred = x - sums / len(x)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    return centred, deviation, values[::-1], vectors[:, ::-1]


def compare(rows, ids, vectors):
    centred, deviation, values, directions = plain(vectors)
    kept = min(32, centred.shape[1])
    assert len(rows) == len(ids) * kept
    by = {}
    for r in rows:
        by.setdefault((r.vec_id, r.component), r)
    assert {r.n for r in rows} == {len(ids)} and max(r.identity_error for r in rows) < 1e-9
    for c in range(1, kept + 1):
        line = np.array([by[i, c].whitened for i in ids])
        want = centred @ directions[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(line - want).max(), np.abs(line + want).max()) < 1e-6
        assert abs(by[ids[0], c].explained - values[c - 1] / values.sum()) < 1e-12
    assert [by[i, 1].deviation for i in ids] == deviation


@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_whitened_rows(spark, d):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(200, d)) @ rng.normal(size=(d, d)) * 3).astype(np.float32).tolist()
    bad = [None, [None] * d, [float("nan")] + [0.0] * (d - 1), [float("inf")] * d, [0.0] * (d + 1), [1e30] * d, []]
    rows = [(k, v, 1, "x", 0.0, "y") for k, v in enumerate(vectors)] + [(900 + k, v, None, None, None, None) for k, v in enumerate(bad)]
    got = whitening.rows(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    compare(got, list(range(200)), vectors)


def test_ties_repeats_and_null_ids(spark):
    rows = [(1, [1.0, 2.0, 2.0], 0, "", 0.0, "")] * 3 + [(None, [3.0, -1.0, 5.5], 0, "", 0.0, "")] * 2
    got = whitening.rows(spark.createDataFrame(rows, SCHEMA)).collect()
    # Two different rows span one direction only; the others have no variance.
    assert len(got) == 15 and all((r.whitened is None) == (r.component > 1) for r in got)
    assert all(r.explained == 0 for r in got if r.component > 1) and sum(r.vec_id is None for r in got) == 6
    alone = whitening.rows(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert len(alone) == 3 and all(r.whitened is None and r.deviation == 0 and r.identity_error is None for r in alone)


def test_large_entries_are_exact(spark):
    vectors = [[2.0**44, 1.0], [-(2.0**44), 3.5], [7.0, 2.0**43]]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    model = whitening.fit(frame)
    x = [[int(64 * c // 1) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    for r in whitening.whitened(frame, model).collect():
        want = sum((3 * v - s) ** 2 for v, s in zip(x[r.vec_id], sums))
        assert int(r.deviation_digits) == want and r.deviation == (want if want < 1 << 63 else None)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.rows(none).collect() == []
    assert whitening.rows(spark.createDataFrame([(1, None, 0, "", 0.0, ""), (2, [], 0, "", 0.0, "")], SCHEMA)).collect() == []


def test_counts_of_pivots():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 7, 20):
        for _ in range(40):
            a = rng.integers(-3, 4, (d, d))
            a, shift = (a + a.T).astype(float), rng.normal()
            assert whitening.above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()


def test_equal_and_near_eigenvalues():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(14, 14)))[0]
    held = [9, 9, 9, 4, 4 - 1e-7, 4 - 2e-7, 3, 2, 2, 2, 2, 1e-3, 0, 0]
    matrix = q @ np.diag(held) @ q.T
    matrix = (matrix + matrix.T) / 2
    found = whitening.leading(matrix, 14)
    vectors = np.array([v for _, v, *_ in found])
    assert np.allclose([e for e, *_ in found], held[:12], atol=1e-11)
    assert np.abs(vectors @ vectors.T - np.eye(12)).max() < 1e-12
    assert np.abs(matrix @ vectors.T - vectors.T * [e for e, *_ in found]).max() < 1e-10
    # The counts at both ends of an interval give the component's number.
    for k, (value, _, low, high) in enumerate(found, 1):
        assert low <= value <= high and whitening.above(matrix, high) < k <= whitening.above(matrix, low)


def test_op12_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = queries.QUERIES["op12_spectrum_whitening"](spark, sf).collect()
    compare(got, [r.vec_id for r in rows], [r.embedding for r in rows])
