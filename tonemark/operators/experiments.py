"""Experiments: compositions of normalisation, fitting, scoring and metrics.

Conditions are columns. All conditions of an experiment are scored into one long
table and summarised by one aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemark.operators import joins, learn, metrics, scoring
from tonemark.operators.bootstrap import bootstrap_ci
from tonemark.operators.calibration import impute, median_vector
from tonemark.operators.folded import folded_cells
from tonemark.operators.joins import delta_vs_baseline
from tonemark.operators.normalise import SCHEMES, normalise
from tonemark.operators.sampling import combo_train_set, draw_copies, draw_list, draw_places, named_draw
from tonemark.operators.summaries import draw_aggregate
from tonemark.sources.storage import new_path

KEPT = ("clip_id", "speaker_id", "prosody_sentiment", "text_sentiment")


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def named_sets(sets: Mapping[str, DataFrame]) -> DataFrame:
    return _stack(
        [df.select(*KEPT, "features").withColumn("eval_set", F.lit(n)) for n, df in sets.items()]
    )


def imputed(train: DataFrame, evals: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with gaps filled by the training medians, where either has gaps."""
    if not (learn.has_gaps(train) or learn.has_gaps(evals)):
        return train, evals
    medians = median_vector(train, width)
    return impute(train, medians), impute(evals, medians)


def stored(rows: DataFrame) -> DataFrame:
    """Narrow scored rows, written once for the aggregates that follow."""
    path = new_path(rows.sparkSession, "scored")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def normalisation(
    train: DataFrame,
    eval_sets: Mapping[str, DataFrame],
    width: int,
    models: Sequence[str],
) -> DataFrame:
    """Scores of every scheme and model per set, with the change from raw features.

    Gaps are filled with the training medians before anything is normalised. Training rows
    never take the leave-one-out form: there it protects nothing. Scaling the training set as
    a whole is what every fit does anyway, so `dataset_z` has the models of `raw`.
    """
    train, evals = imputed(train, named_sets(eval_sets), width)
    apart = ["raw", "speaker_z"]
    jobs = [lambda s=s: learn.fit(normalise(train, s, width), width, models) for s in apart]
    fitted = dict(zip(apart, learn.in_parallel(jobs), strict=True))
    fitted["dataset_z"] = learn.standardised(fitted["raw"]) or learn.fit(
        normalise(train, "dataset_z", width), width, models
    )
    parts = []
    for scheme in SCHEMES:
        models_of = fitted["speaker_z" if scheme == "speaker_z_loo" else scheme]
        rows = normalise(evals, scheme, width, pool=["eval_set"])
        parts.append(learn.score_all(models_of, rows).withColumn("scheme", F.lit(scheme)))
    keys = ["scheme", "model", "eval_set"]
    rows = stored(_stack([p.select(*KEPT, "sentiment", *keys) for p in parts]))
    scores = metrics.summarise(
        rows, keys, ["n_clips", "uar", "macro_f1", "psi_contested", "psi_strict"]
    )
    collapsed = metrics.degeneracy(rows, keys).select(*keys, "top_class", "is_degenerate")
    changes = delta_vs_baseline(scores, ["model", "eval_set"]).select(*keys, "delta")
    return scores.join(collapsed, keys).join(changes, keys, "left")


def skew(
    train: DataFrame,
    evaluation: DataFrame,
    width: int,
    models: Sequence[str],
    *,
    schemes: Sequence[str] = ("raw", "speaker_z"),
    seeds: int = 20,
    fold: bool = True,
) -> DataFrame:
    """How scores hold up when each speaker's classes are unbalanced.

    Models are fitted once. Every draw is scored by every scheme and model, and
    statistics are taken within a draw. A clip is stored once with the list of its draws: raw
    scores do not depend on the draw, and linear models are folded into coefficients per draw
    and speaker. Other models score a copy of the vector per draw under `speaker_z`, as linear
    ones do without `fold`.
    """
    draw = ["level", "majority", "seed"]
    keys = ["scheme", "model", *draw]
    train, evaluation = imputed(train, evaluation.select(*KEPT, "features"), width)
    listed = draw_list(seeds=seeds)
    placed = stored(draw_places(evaluation, listed))
    cell = ["t", "x", "p", "n"]
    parts = []
    fits = learn.in_parallel([lambda s=s: learn.fit(normalise(train, s, width), width, models) for s in schemes])
    for scheme, fitted in zip(schemes, fits, strict=True):
        linear = {k: m.linear for k, m in fitted.items() if fold and m.linear and scheme == "speaker_z"}
        copied = {k: m for k, m in fitted.items() if k not in linear}
        counted = []
        if linear:
            folded = folded_cells(placed, len(listed), linear, width)
            named = folded.withColumn("_d", named_draw(listed, F.col("d")))
            counted.append(named.select("model", *[f"_d.{c}" for c in draw], *cell))
        if copied and scheme == "raw":
            once = learn.score_all(copied, placed).select(*KEPT, "sentiment", "model", "_draws")
            counted.append(metrics.cells(draw_copies(once, listed), ["model", *draw]).select("model", *draw, *cell))
        elif copied:
            rows = learn.score_all(copied, normalise(draw_copies(placed, listed), scheme, width, pool=draw))
            counted.append(metrics.cells(rows, ["model", *draw]).select("model", *draw, *cell))
        parts += [c.withColumn("scheme", F.lit(scheme)) for c in counted]
    counts = stored(_stack([p.select(*keys, *cell) for p in parts]))
    per_draw = metrics.summarise_cells(counts, keys, ["n_clips", "uar", "psi_contested"])
    level = ["scheme", "model", "level"]
    uar = draw_aggregate(per_draw, level, "uar").withColumnsRenamed(
        {"mean": "uar_mean", "std": "uar_std", "min": "uar_min", "max": "uar_max"}
    )
    psi = draw_aggregate(per_draw, level, "psi_contested").select(
        *level, F.col("mean").alias("psi_mean"), F.col("std").alias("psi_std")
    )
    collapsed = (
        metrics.degeneracy_of_cells(counts, keys)
        .groupBy(*level)
        .agg(F.avg(F.col("is_degenerate").cast("int").cast("double")).alias("degenerate_rate"))
    )
    return uar.join(psi, level).join(collapsed, level)


def combos(
    base: DataFrame, first: DataFrame, second: DataFrame, *, width: int, n_boot: int = 2000
) -> DataFrame:
    """Four training combinations scored on every set that shares no speaker with them."""
    extras = {
        "base_only": [],
        "base_first": [first],
        "base_first_second": [first, second],
        "base_second": [second],
    }
    train_sets = {
        name: combo_train_set(base, parts).where("split = 'train'")
        for name, parts in extras.items()
    }
    eval_sets = {"base_test": base.where("split = 'test'"), "first": first, "second": second}
    return training_matrix(train_sets, eval_sets, width=width, n_boot=n_boot)


def training_matrix(
    train_sets: Mapping[str, DataFrame],
    eval_sets: Mapping[str, DataFrame],
    *,
    width: int,
    exclude: Sequence[str] | None = None,
    n_boot: int = 2000,
) -> DataFrame:
    """Every training set scored on every evaluation set, with intervals.

    `in_domain` marks pairs with shared speakers. On the sets named in `exclude` (all, if
    none are named) such pairs are not scored; they stay listed with the reason.
    """
    members = _stack(
        [
            df.select("speaker_id").withColumn("train_set", F.lit(n))
            for n, df in train_sets.items()
        ]
    )
    evals = named_sets(eval_sets)
    matrix = joins.evaluation_matrix(members, evals).withColumn("in_domain", F.col("n_shared") > 0)
    if exclude is not None:
        strict = F.col("eval_set").isin(list(exclude))
        matrix = matrix.withColumn("excluded_reason", F.when(strict, F.col("excluded_reason")))
    fitted = learn.in_parallel(
        [lambda df=df: learn.fit(df, width)["logreg"] for df in train_sets.values()]
    )
    scored = _stack(
        [
            model.score(evals).withColumn("train_set", F.lit(name))
            for name, model in zip(train_sets, fitted, strict=True)
        ]
    ).select(*KEPT, "sentiment", "train_set", "eval_set")
    keys = ["train_set", "eval_set"]
    matrix = stored(matrix)
    honest = stored(
        scored.join(matrix.where(F.col("excluded_reason").isNull()).select(*keys), keys)
    )
    names = ["n_clips", "n_incongruent", "uar", "macro_f1", "psi_contested"]
    results = metrics.summarise(honest, keys, names)
    intervals = bootstrap_ci(honest, keys, n_boot=n_boot).select(*keys, "uar_lo", "uar_hi")
    collapsed = metrics.degeneracy(honest, keys).select(*keys, "is_degenerate")
    return (
        matrix.join(results, keys, "left")
        .join(intervals, keys, "left")
        .join(collapsed, keys, "left")
        .withColumn("suspicious", scoring.suspicious(F.col("uar")) & ~F.col("in_domain"))
    )


def zero_shot_vs_retrained(
    base: DataFrame, extra: DataFrame, *, width: int, n_boot: int = 2000
) -> DataFrame:
    """The shipped model on a new corpus against models retrained with it, with intervals.

    Only rows with split = 'train' are fitted. The set a combination selects its
    model on is not scored for that combination.
    """
    parts = {s: extra.where(F.col("split") == s) for s in ("train", "val", "test")}
    fit_on = {
        "zero_shot": base.where("split = 'train'"),
        "base_plus_extra": base.where("split = 'train'").unionByName(parts["train"]),
        "extra_only": parts["train"],
    }
    scored_on = {
        "zero_shot": {"extra_test": parts["test"], "extra_val": parts["val"], "extra_all": extra},
        "base_plus_extra": {"extra_test": parts["test"], "extra_val": parts["val"]},
        "extra_only": {"extra_test": parts["test"]},
    }
    fitted = learn.in_parallel(
        [lambda df=df: learn.fit(df, width)["logreg"] for df in fit_on.values()]
    )
    rows = _stack(
        [
            model.score(named_sets(scored_on[name])).withColumn("condition", F.lit(name))
            for name, model in zip(fit_on, fitted, strict=True)
        ]
    ).select(*KEPT, "sentiment", "condition", "eval_set")
    keys = ["condition", "eval_set"]
    names = ["n_clips", "uar", "macro_f1", "psi_contested", "psi_strict"]
    rows = stored(rows)
    scores = metrics.summarise(rows, keys, names)
    intervals = bootstrap_ci(rows, keys, n_boot=n_boot)
    return scores.join(
        intervals.select(*keys, "uar_lo", "uar_hi", "psi_lo", "psi_hi"), keys, "left"
    ).withColumn("suspicious", scoring.suspicious(F.col("uar")))
