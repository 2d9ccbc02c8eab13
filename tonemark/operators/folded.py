"""Linear models on features normalised within draws, without a copy of a row per draw.

A z-score within a draw and speaker is an affine map, so a linear model after it is another
linear model on the raw features, with its own coefficients per draw and speaker. A row is
stored once, with the list of its draws: one product gives its scores in all of them, and
counts leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemark.operators.normalise import EPS, feature_stats
from tonemark.operators.sampling import partitions
from tonemark.operators.scale import lookup_join
from tonemark.schema import LABELS
from tonemark.sources.storage import new_path

# Bytes of vectors that one task of a speaker's slices holds at a time.
SLICE_BYTES = 16 << 20
# Scores held at a time while a slice is counted.
BLOCK_SCORES = 2_000_000
# Below this share of the raw second moment a centred one is computed again from the rows.
CANCELLED = 1e-6


@dataclass
class Linear:
    """Scores `x @ weights.T + bias` of raw features and what makes class scores of them.

    `head` takes scores of the shape (..., m) to (..., classes); classes are in canonical order.
    """

    weights: np.ndarray
    bias: np.ndarray
    head: Callable[[np.ndarray], np.ndarray]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as rows of a matrix; a missing entry is NaN."""
    values = pa.concat_arrays([chunk.flatten() for chunk in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _members(column: pa.ChunkedArray, draws: int) -> np.ndarray:
    """Rows by draws, true where the row is in the draw."""
    inside = np.zeros((len(column), draws), bool)
    for i, places in enumerate(column.to_pylist()):
        inside[i, places] = True
    return inside


def draw_moments(x: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per draw: its rows, the means of its rows and their squared deviations from those.

    Two products give all draws. Where the difference of two moments has cancelled, a
    dimension that hardly varies in a draw, the deviations are taken from the rows.
    """
    member = inside.T.astype(np.float64)
    n = member.sum(axis=1)
    missing = np.isnan(x)
    known = np.where(missing, 0.0, x)
    mean = member @ known / np.maximum(n, 1.0)[:, None]
    raw = member @ (known * known)
    spread = raw - n[:, None] * mean * mean
    doubtful = spread <= CANCELLED * raw
    for d in np.flatnonzero(doubtful.any(axis=1)):
        dims = np.flatnonzero(doubtful[d])
        if n[d]:
            rows = known[np.ix_(inside[:, d], dims)]
            mean[d, dims] = rows.mean(axis=0)
            spread[d, dims] = ((rows - mean[d, dims]) ** 2).sum(axis=0)
    if missing.any():
        gap = member @ missing > 0
        mean[gap] = spread[gap] = np.nan
    return n, mean, spread


def folded_cells(
    placed: DataFrame,
    draws: int,
    models: Mapping[str, Linear],
    width: int,
    *,
    group: str = "speaker_id",
    label: str = "prosody_sentiment",
    text: str = "text_sentiment",
    slice_rows: int | None = None,
) -> DataFrame:
    """Counts n of the predictions p per model and draw, true class t and text class x.

    `placed` has one row per clip with `features`, `_draws` (places below `draws`) and a class in
    `label`. Features are standardised within the group and draw; a dimension that is constant
    there is 0. Groups are dealt in slices of about SLICE_BYTES of vectors, so a hot group
    is many tasks; what moves is each row once a pass and, per slice, the moments of its draws.
    A NULL group is a group like others. No rows give no counts.
    """
    spark = placed.sparkSession
    per_slice = slice_rows or max(1, SLICE_BYTES // (8 * width))
    names = list(models)
    whole_path = new_path(spark, "group_means")
    # The group's mean over all its rows is the origin: draws differ from it by little.
    feature_stats(placed, [group], width).select(group, F.col("_n").alias("group_n"), F.col("_mean").alias("origin")).write.parquet(whole_path)
    origins = spark.read.parquet(whole_path)
    slices = F.greatest(F.ceil(F.col("group_n") / F.lit(per_slice)), F.lit(1)).cast("int")
    sized = lookup_join(
        placed.select(group, "clip_id", label, text, "features", "_draws"),
        origins.select(group, "group_n"),
        [group],
        count_col="group_n",
        spread_by="clip_id",
        row_bytes=100 + 8 * width,
    )
    # Rows of equal id may lie in one slice; a draw list tells nothing about the slice.
    dealt = sized.withColumn("_slice", F.pmod(F.xxhash64("clip_id"), slices).cast("int")).drop("group_n")
    per_group_slice = origins.withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    keys = [group, "_slice"]
    kind = dict(placed.dtypes)[group]
    spread = dealt.repartition(partitions(spark), *keys)

    def moments(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({group: found.column(group).slice(0, 0), "d": pa.array([], pa.int32()), "n": pa.array([], pa.float64()), "m": pa.array([], pa.list_(pa.float64()))})
        origin = np.nan_to_num(_matrix(found.column("origin"), width)[0])
        n, mean, squares = draw_moments(_matrix(rows.column("features"), width) - origin, _members(rows.column("_draws"), draws))
        held = np.flatnonzero(n)
        # Sums add up over slices: of values, of deviations in a slice, and of n * mean^2.
        sums = np.concatenate([n[:, None] * mean, squares, n[:, None] * mean * mean], axis=1)[held]
        return pa.table(
            {
                group: rows.column(group).take(pa.array(np.zeros(len(held), np.int64))),
                "d": pa.array(held.astype(np.int32)),
                "n": pa.array(n[held]),
                "m": pa.array(list(sums), pa.list_(pa.float64())),
            }
        )

    parts = spread.groupBy(*keys).cogroup(per_group_slice.groupBy(*keys)).applyInArrow(moments, f"`{group}` {kind}, d int, n double, m array<double>")
    added = parts.groupBy(group, "d").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), vector_to_array(Summarizer.sum(array_to_vector("m"))).alias("m")
    )
    path = new_path(spark, "draw_moments")
    added.write.parquet(path)
    # One row a group: its draws' figures, bounded by the number of draws.
    listed = spark.read.parquet(path).groupBy(group).agg(F.collect_list(F.struct("d", "n", "parts", "m")).alias("draws"))
    figures = lookup_join(per_group_slice, listed.withColumn("_one", F.lit(1)), [group], count_col="_one", spread_by="_slice").drop("_one")

    def counts(rows: pa.Table, found: pa.Table) -> pa.Table:
        columns: dict[str, list] = {c: [] for c in ("model", "d", "t", "x", "p", "n")}
        listed = found.column("draws")[0] if rows.num_rows and found.num_rows else None
        if listed is not None and listed.is_valid:
            origin = np.nan_to_num(_matrix(found.column("origin"), width)[0])
            entries = listed.values
            at = entries.field("d").to_numpy()
            n = entries.field("n").to_numpy()[:, None]
            m = entries.field("m").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3 * width)
            mean = m[:, :width] / n
            # One slice has its deviations; several add those between their means.
            between = np.where(entries.field("parts").to_numpy()[:, None] > 1, m[:, 2 * width :] - n * mean * mean, 0.0)
            std = np.sqrt(np.maximum(m[:, width : 2 * width] + between, 0.0) / n)
            scale = np.where(std < EPS, 0.0, 1.0 / np.where(std < EPS, 1.0, std))
            x = _matrix(rows.column("features"), width) - origin
            inside = _members(rows.column("_draws"), draws)[:, at]
            truth = np.array([LABELS.index(c) for c in rows.column(label).to_pylist()])
            codes, texts = pd.factorize(rows.column(text).to_pandas(), use_na_sentinel=False)
            for name in names:
                model = models[name]
                # (draws, scores, width): the coefficients of every draw on the raw features.
                fold = scale[:, None, :] * model.weights[None]
                bias = model.bias[None] - np.einsum("dmw,dw->dm", fold, mean)
                flat = fold.reshape(-1, width)
                classes, tally = len(LABELS), None
                step = max(1, BLOCK_SCORES // len(flat))
                for start in range(0, len(x), step):
                    some = slice(start, start + step)
                    scores = (x[some] @ flat.T).reshape(-1, len(at), len(model.bias)) + bias
                    said = model.head(scores).argmax(axis=2)
                    i, d = np.nonzero(inside[some])
                    cell = ((d * classes + truth[some][i]) * len(texts) + codes[some][i]) * classes + said[i, d]
                    found_here = np.bincount(cell, minlength=len(at) * classes * len(texts) * classes)
                    tally = found_here if tally is None else tally + found_here
                full = np.flatnonzero(tally)
                d, t, x_code, p = np.unravel_index(full, (len(at), classes, len(texts), classes))
                columns["model"] += [name] * len(full)
                columns["d"] += at[d].tolist()
                columns["t"] += [LABELS[k] for k in t]
                columns["x"] += [None if pd.isna(texts[k]) else texts[k] for k in x_code]
                columns["p"] += [LABELS[k] for k in p]
                columns["n"] += tally[full].tolist()
        kinds = {"model": pa.string(), "d": pa.int32(), "t": pa.string(), "x": pa.string(), "p": pa.string(), "n": pa.int64()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in columns.items()})

    counted = spread.groupBy(*keys).cogroup(figures.groupBy(*keys)).applyInArrow(counts, "model string, d int, t string, x string, p string, n bigint")
    return counted.groupBy("model", "d", "t", "x", "p").agg(F.sum("n").alias("n"))
