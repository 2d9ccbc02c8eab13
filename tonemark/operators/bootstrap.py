"""Percentile bootstrap over clips.

Resampling n clips with replacement only changes how many clips fall in each
(true, predicted, text) cell, and those counts are multinomial. So rows are
reduced to at most 27 counts per group first, and each replicate is one draw of
those counts: the cost does not depend on the number of clips.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemark.schema import LABELS

# Replicates drawn by one row of the replicate table.
BATCH = 250


def bootstrap_replicates(
    rows: DataFrame, groups: Sequence[str], *, n_boot: int = 2000, seed: int = 0
) -> DataFrame:
    """(groups, replicate, uar, psi_contested), undefined values NULL."""
    groups = list(groups)
    cell = F.struct(
        F.col("prosody_sentiment").alias("t"),
        F.col("sentiment").alias("p"),
        F.col("text_sentiment").alias("x"),
        F.col("count").alias("n"),
    )
    counted = rows.groupBy(
        *groups, "prosody_sentiment", "sentiment", "text_sentiment"
    ).count()
    packed = counted.groupBy(*groups).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    batches = F.sequence(F.lit(0), F.lit((n_boot - 1) // BATCH))
    work = packed.select(*groups, "cells", F.explode(batches).alias("batch")).repartition(
        *groups, "batch"
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                cells = row["cells"]
                t = np.array([c["t"] for c in cells])
                p = np.array([c["p"] for c in cells])
                x = np.array([c["x"] for c in cells])
                n = np.array([c["n"] for c in cells], dtype=np.int64)
                first = row["batch"] * BATCH
                size = min(BATCH, n_boot - first)
                key = zlib.crc32("|".join(str(row[g]) for g in groups).encode())
                rng = np.random.default_rng([seed, key, int(row["batch"])])
                drawn = rng.multinomial(n.sum(), n / n.sum(), size=size).astype(np.float64)
                with np.errstate(invalid="ignore", divide="ignore"):
                    recalls = np.stack(
                        [
                            drawn[:, (t == c) & (p == c)].sum(1) / drawn[:, t == c].sum(1)
                            for c in LABELS
                        ]
                    )
                    tone = drawn[:, (t != x) & (p == t)].sum(1)
                    words = drawn[:, (t != x) & (p == x)].sum(1)
                    psi = tone / (tone + words)
                    present = np.isfinite(recalls)
                    uar = np.where(present, recalls, 0).sum(0) / present.sum(0)
                out = {g: [row[g]] * size for g in groups}
                out |= {"replicate": np.arange(first, first + size), "uar": uar, "psi": psi}
                yield pd.DataFrame(out)

    fields = ", ".join(f"{g} {packed.schema[g].dataType.simpleString()}" for g in groups)
    schema = (fields + ", " if fields else "") + "replicate bigint, uar double, psi double"
    drawn = work.mapInPandas(run, schema)
    return drawn.select(
        *groups,
        "replicate",
        F.when(~F.isnan("uar"), F.col("uar")).alias("uar"),
        F.when(~F.isnan("psi"), F.col("psi")).alias("psi_contested"),
    )


def bootstrap_ci(
    rows: DataFrame, groups: Sequence[str], *, n_boot: int = 2000, seed: int = 0
) -> DataFrame:
    """95 % intervals of UAR and PSI. A group has n_boot values, so `percentile` is bounded."""
    levels = F.array(F.lit(0.025), F.lit(0.975))
    replicates = bootstrap_replicates(rows, groups, n_boot=n_boot, seed=seed)
    summed = replicates.groupBy(*groups).agg(
        F.percentile("uar", levels).alias("u"),
        F.percentile("psi_contested", levels).alias("q"),
        F.count(F.lit(1)).alias("n_boot"),
    )
    return summed.select(
        *groups,
        F.col("u")[0].alias("uar_lo"),
        F.col("u")[1].alias("uar_hi"),
        F.col("q")[0].alias("psi_lo"),
        F.col("q")[1].alias("psi_hi"),
        "n_boot",
    )
