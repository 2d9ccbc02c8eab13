"""Operator 12: whitening of vectors by slicing the covariance's spectrum.

Every entry c becomes the integer floor(64 c) + 1,000,000. One scan sums the integers of each
dimension exactly, a second one the products of what is left after the mean is taken off; tasks
send one row per pair of dimensions, whatever their rows. The covariance alone, whose size
depends on the dimensions only, is worked on in the driver:

1. The LDL' factors of the covariance less a shift have as many positive pivots as it has
   eigenvalues above the shift. Halving by such counts isolates each of the leading
   eigenvalues in an interval of its own.
2. Rayleigh quotient iteration from the interval's middle converges cubically. A result
   outside its interval is thrown away and the interval halved again, so the counts at the
   two ends certify the component's number.
3. Eigenvalues that differ by less than rounding are one cluster; it gets orthonormal
   vectors by block inverse iteration.

Two more scans take the covariance of the whitened rows, which shows how far it is from the
identity.

Defined results: rows whose vector is null or empty, or has an entry that is null, not finite or so
large that its integer is beyond 2**52, are in no result; nor are vectors of another length
than the most frequent one (of equally frequent ones, the longest). More than `DIMENSIONS`
dimensions are refused. Repeated rows and null ids count like others. `deviation` is null where
it exceeds a long (`deviation_digits` has it in full). Components without variance, as of fewer
rows than dimensions, have a null `whitened`. Tables without usable rows give no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
COMPONENTS = 32
SCALE, SHIFT, LARGEST = 64.0, 1_000_000, 2.0**52
_EPS = float(np.finfo(float).eps)
_LONG = 1 << 63


# --- vectors as integers ---------------------------------------------------------


def _usable(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places of the rows, integers) of the usable vectors, by length."""
    present = np.flatnonzero(np.asarray(column.is_valid()))
    lengths = np.asarray(column.drop_null().value_lengths()).astype(np.int64)
    # Null entries become NaN.
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float) * SCALE
    row = np.repeat(np.arange(len(lengths)), lengths)
    fine = (lengths > 0) & (np.bincount(row[~(np.abs(values) < LARGEST)], minlength=len(lengths)) == 0)
    out = []
    for length in np.unique(lengths[fine]):
        taken = fine & (lengths == length)
        x = np.floor(values[taken[row]]).astype(np.int64) + SHIFT
        out.append((int(length), present[taken], x.reshape(-1, length)))
    return out


def _vectors(df: DataFrame, column: str, *others: str) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) for c in others), F.col(column).cast("array<double>").alias("vector"))


@dataclass
class Sums:
    """The number of vectors and the exact sum of each dimension."""

    n: int
    sums: list[int]

    @property
    def middle(self) -> np.ndarray:
        """The integers nearest the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """sum - n * middle, at most n / 2."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.middle, strict=True)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over the dimensions of (n x - sum)**2, exact."""
        y, rest, n = x - self.middle, self.rest, self.n
        if y.size and float(np.abs(y).max()) * max(float(np.abs(y).max()), float(max(map(abs, rest))), 1.0) * y.shape[1] >= 2.0**62:
            y = y.astype(object)
        squares, across = (y * y).sum(axis=1).tolist(), (y * np.array(rest, y.dtype)).sum(axis=1).tolist()
        return [n * n * a - 2 * n * b + sum(r * r for r in rest) for a, b in zip(squares, across, strict=True)]


def sums(df: DataFrame, column: str = "embedding") -> Sums | None:
    """One scan; None without a usable vector."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for length, _, x in _usable(batch.column("vector")):
                mine = held.setdefault(length, [0, np.zeros(length, object)])
                mine[0] += len(x)
                if length <= DIMENSIONS:
                    # Halves of the bits, so that no sum leaves 64 bits.
                    mine[1] += (x >> 26).sum(axis=0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
        for length, (n, total) in held.items():
            known = list(enumerate(total.tolist())) if length <= DIMENSIONS else [(0, 0)]
            yield pa.record_batch(
                [
                    pa.array([length] * len(known), pa.int32()),
                    pa.array([k for k, _ in known], pa.int32()),
                    pa.array([n] * len(known), pa.int64()),
                    pa.array([Decimal(s) for _, s in known], pa.decimal128(38, 0)),
                ],
                ["length", "k", "n", "s"],
            )

    parts = _vectors(df, column).mapInArrow(run, "length int, k int, n long, s decimal(38,0)")
    total = parts.groupBy("length", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    # At most `DIMENSIONS` rows: those of the most frequent length.
    best = total.groupBy("length").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if best is None:
        return None
    if best["length"] > DIMENSIONS:
        raise ValueError(f"vectors of {best['length']} dimensions; at most {DIMENSIONS} are whitened")
    rows = total.filter(F.col("length") == best["length"]).orderBy("k").collect()
    return Sums(best["n"], [int(r["s"]) for r in rows])


def _matrix(parts: DataFrame, size: int) -> np.ndarray:
    """The symmetric matrix of the sums of (i, j, v); its size is that of the dimensions."""
    held = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size, size))
    i, j, v = (held.column(c).to_numpy() for c in ("i", "j", "v"))
    out[i, j] = out[j, i] = v
    return out


def _products(blocks: Iterator[np.ndarray], size: int) -> Iterator[pa.RecordBatch]:
    """Sums of products of all blocks, one row per pair of columns."""
    total = np.zeros((size, size))
    for block in blocks:
        total += block.T @ block
    i, j = np.triu_indices(size)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        yield pa.record_batch([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b])], ["i", "j", "v"])


def covariance(df: DataFrame, stats: Sums, column: str = "embedding") -> np.ndarray:
    """Divisor n, centred before multiplying."""
    size = len(stats.sums)

    def run(batches):
        yield from _products(
            (stats.centred(x) for batch in batches for length, _, x in _usable(batch.column("vector")) if length == size), size
        )

    return _matrix(_vectors(df, column).mapInArrow(run, "i int, j int, v double"), size) / stats.n


# --- the spectrum ----------------------------------------------------------------


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed the shift: positive pivots of LDL', diagonal pivoting."""
    left = matrix - shift * np.eye(len(matrix))
    grow, count = (1 + 17**0.5) / 8, 0
    while len(left):
        corner = abs(left[0, 0])
        off = np.abs(left[1:, 0])
        most = off.max() if len(off) else 0.0
        if not most:
            count += bool(left[0, 0] > 0)
            left = left[1:, 1:]
            continue
        size = 1
        if corner < grow * most:
            r = int(off.argmax()) + 1
            other = np.delete(np.abs(left[:, r]), r).max()
            if corner * other < grow * most * most:
                size = 1 if abs(left[r, r]) >= grow * other else 2
                order = np.arange(len(left))
                order[[size - 1, r]] = order[[r, size - 1]]
                left = left[np.ix_(order, order)]
        if size == 1:
            count += bool(left[0, 0] > 0)
            left = left[1:, 1:] - np.outer(left[1:, 0] / left[0, 0], left[1:, 0])
        else:
            # A two by two pivot has one eigenvalue of each sign.
            count += 1
            left = left[2:, 2:] - left[2:, :2] @ np.linalg.solve(left[:2, :2], left[:2, 2:])
        left = (left + left.T) / 2
    return count


def _solved(matrix: np.ndarray, shift: float, right: np.ndarray, nudge: float) -> np.ndarray:
    for k in range(8):
        try:
            out = np.linalg.solve(matrix - (shift + k * nudge) * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(out).all():
            return out
    raise ArithmeticError("shifted covariance stays singular")


def _apart(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """Orthogonal to the vectors found before."""
    if found:
        known = np.array(found)
        for _ in range(2):
            v = v - known.T @ (known @ v)
    return v / np.linalg.norm(v, axis=0)


def _iterated(matrix: np.ndarray, low: float, high: float, start: np.ndarray, size: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration; None if it ends outside the interval."""
    v = start
    for _ in range(2):
        v = _solved(matrix, (low + high) / 2, v, size * _EPS)
        v /= np.linalg.norm(v)
    for _ in range(12):
        value = float(v @ matrix @ v)
        if not low <= value <= high:
            return None
        if np.linalg.norm(matrix @ v - value * v) <= 4 * len(matrix) * _EPS * size:
            return value, v
        v = _solved(matrix, value, v, size * _EPS)
        v /= np.linalg.norm(v)
    return None


def leading(matrix: np.ndarray, wanted: int) -> list[tuple[float, np.ndarray, float, float]]:
    """(eigenvalue, unit eigenvector, low, high) of the leading positive ones, falling.

    The number of eigenvalues above `high` is less than the component's number, that above
    `low` is not: counts, not the iteration, give the number.
    """
    d = len(matrix)
    size = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0
    if not size:
        return []
    least = 16 * d * _EPS * size
    wanted = min(wanted, above(matrix, least))
    rng = np.random.default_rng(12)
    found: list[np.ndarray] = []
    out: list[tuple[float, np.ndarray, float, float]] = []
    # (low, high, eigenvalues above low, above high); the highest interval is last.
    slices = [(least, size * (1 + 4 * d * _EPS), above(matrix, least), 0)]
    while len(out) < wanted:
        low, high, n_low, n_high = slices.pop()
        if n_low == n_high:
            continue
        if n_low - n_high == 1:
            got = _iterated(matrix, low, high, rng.standard_normal(d), size)
            if got is not None:
                value, vector = got
                vector = _apart(vector, found)
                found.append(vector)
                out.append((value, vector, low, high))
                continue
        if high - low <= least:
            block = rng.standard_normal((d, n_low - n_high))
            for _ in range(4):
                block = np.linalg.qr(_apart(_solved(matrix, (low + high) / 2, block, size * _EPS), found))[0]
            pairs = sorted(((float(v @ matrix @ v), k) for k, v in enumerate(block.T)), reverse=True)
            found += [block[:, k] for _, k in pairs]
            out += [(value, block[:, k], low, high) for value, k in pairs]
            continue
        middle = (low + high) / 2
        n_middle = min(max(above(matrix, middle), n_high), n_low)
        slices += [(low, middle, n_low, n_middle), (middle, high, n_middle, n_high)]
    signed = [(e, v * (1 if v[np.abs(v).argmax()] > 0 else -1), a, b) for e, v, a, b in out]
    return signed[:wanted]


# --- whitening -------------------------------------------------------------------


@dataclass
class Whitening:
    """What `fit` learns. Its size depends on the dimensions only."""

    stats: Sums
    components: int
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    intervals: list[tuple[float, float]]

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.stats.centred(x) @ (self.vectors.T / np.sqrt(self.values))


def fit(df: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    stats = sums(df, column)
    if stats is None:
        return None
    matrix = covariance(df, stats, column)
    found = leading(matrix, min(components, len(matrix)))
    values = np.array([e for e, *_ in found])
    trace = float(np.trace(matrix))
    return Whitening(
        stats,
        min(components, len(matrix)),
        values,
        np.array([v for _, v, *_ in found]).reshape(len(found), len(matrix)),
        values / trace if trace else values,
        [(a, b) for *_, a, b in found],
    )


def whitened(df: DataFrame, model: Whitening, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The id, the whitened vector, the deviation and all its digits of every usable row."""
    size = len(model.stats.sums)

    def run(batches):
        for batch in batches:
            for length, rows, x in _usable(batch.column("vector")):
                if length != size:
                    continue
                deviations = model.stats.deviations(x)
                yield pa.record_batch(
                    [
                        batch.column(id_column).take(pa.array(rows)),
                        pa.array(list(model.of(x)), pa.list_(pa.float64())),
                        pa.array([v if v < _LONG else None for v in deviations], pa.int64()),
                        pa.array(list(map(str, deviations)), pa.string()),
                    ],
                    [id_column, "whitened", "deviation", "deviation_digits"],
                )

    schema = f"`{id_column}` long, whitened array<double>, deviation long, deviation_digits string"
    return _vectors(df, column, id_column).mapInArrow(run, schema)


def identity_error(df: DataFrame, model: Whitening, column: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    size, kept = len(model.stats.sums), len(model.values)
    if not kept:
        return None

    def blocks(batches):
        return (model.of(x) for batch in batches for length, _, x in _usable(batch.column("vector")) if length == size)

    def totals(batches):
        total = np.zeros(kept)
        for block in blocks(batches):
            total += block.sum(axis=0)
        yield pa.record_batch([pa.array(range(kept), pa.int32()), pa.array(total)], ["k", "s"])

    rows = _vectors(df, column).mapInArrow(totals, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    mean = np.zeros(kept)
    for r in rows:
        mean[r["k"]] = r["s"] / model.stats.n

    def run(batches):
        yield from _products((block - mean for block in blocks(batches)), kept)

    held = _matrix(_vectors(df, column).mapInArrow(run, "i int, j int, v double"), kept) / model.stats.n
    return float(np.abs(held - np.eye(kept)).max())


_ROWS = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double, eigenvalue double"
)


def rows(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component."""
    model = fit(df, column, components)
    if model is None:
        return df.sparkSession.createDataFrame([], _ROWS)
    error = identity_error(df, model, column)
    # Components without variance have a share of 0 and no whitened value.
    lacking = [0.0] * (model.components - len(model.values))
    shares, values = ([*map(float, held), *lacking] for held in (model.explained, model.values))
    part = F.struct(
        *(F.element_at(F.array(*map(F.lit, held)), F.col("component")).alias(name) for name, held in (("e", shares), ("v", values)))
    )
    long = whitened(df, model, id_column, column).select(
        F.col(id_column).alias("vec_id"),
        "deviation",
        "whitened",
        F.explode(F.sequence(F.lit(1), F.lit(model.components))).alias("component"),
    )
    return long.select(
        "vec_id",
        F.col("component").cast("int").alias("component"),
        F.lit(model.stats.n).cast("long").alias("n"),
        "deviation",
        F.get("whitened", F.col("component") - 1).alias("whitened"),
        part["e"].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
        part["v"].alias("eigenvalue"),
    )
