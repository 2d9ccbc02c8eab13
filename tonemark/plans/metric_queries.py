"""Metric queries over the prediction view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonemark.operators import joins, metrics
from tonemark.plans.registry import query
from tonemark.plans.shape import tidy
from tonemark.plans.views import CLIPS, PREDS, with_

BASE = with_(CLIPS, PREDS)

# Per (group, class) recall parts as SQL, reused by several oracles.
RECALLS = """rec AS (
  SELECT solution, prosody_sentiment AS t,
    avg((sentiment = prosody_sentiment)::INT::DOUBLE) AS recall
  FROM preds GROUP BY ALL)"""
ECE = """ece AS (
  SELECT solution, sum(abs(right_n - conf)) / sum(n) AS ece FROM (
    SELECT solution, greatest(ceil(round(confidence*10, 9)), 1) AS bin, count(*) AS n,
      count(*) FILTER (WHERE sentiment = prosody_sentiment) AS right_n, sum(confidence) AS conf
    FROM preds GROUP BY ALL) GROUP BY solution)"""
F1 = """f1 AS (
  SELECT solution, avg(f) AS macro_f1 FROM (
    SELECT solution, c,
      coalesce(2.0::DOUBLE * count(*) FILTER (WHERE prosody_sentiment = c AND sentiment = c)
       / nullif(count(*) FILTER (WHERE prosody_sentiment = c)
                + count(*) FILTER (WHERE sentiment = c), 0), 0) AS f
    FROM preds, (VALUES ('negative'),('neutral'),('positive')) l(c) GROUP BY ALL)
  GROUP BY solution)"""
PSI_CONTESTED = """count(*) FILTER (WHERE NOT is_congruent AND sentiment = prosody_sentiment)
    ::DOUBLE / nullif(count(*) FILTER (WHERE NOT is_congruent
      AND sentiment IN (prosody_sentiment, text_sentiment)), 0)"""
PSI_STRICT = """count(*) FILTER (WHERE NOT is_congruent AND sentiment = prosody_sentiment)
    ::DOUBLE / nullif(count(*) FILTER (WHERE NOT is_congruent), 0)"""
MATRIX = ",\n    ".join(
    f"count(*) FILTER (WHERE prosody_sentiment='{a}' AND sentiment='{b}') AS c_{a[:3]}_{b[:3]}"
    for a in ("negative", "neutral", "positive")
    for b in ("negative", "neutral", "positive")
)


def joined(v):
    return joins.join_predictions(v.clips, v.predictions)


@query("confusion_matrix", BASE + f"SELECT solution, {MATRIX} FROM preds GROUP BY solution")
def _(v):
    counted = metrics.cells(joined(v), ["solution"])
    return counted.groupBy("solution").agg(
        *[c.alias(n) for n, c in metrics.matrix_columns().items()]
    )


@query(
    "uar",
    BASE + f", {RECALLS} SELECT solution, round(avg(recall), 6) AS uar FROM rec GROUP BY solution",
)
def _(v):
    return tidy(metrics.summarise(joined(v), ["solution"], ["uar"]))


@query("macro_f1", BASE + f", {F1} SELECT solution, round(macro_f1, 6) AS macro_f1 FROM f1")
def _(v):
    return tidy(metrics.summarise(joined(v), ["solution"], ["macro_f1"]))


@query(
    "accuracy",
    BASE
    + """SELECT solution, count(*) AS n_clips,
      round(avg((sentiment = prosody_sentiment)::INT::DOUBLE), 6) AS accuracy
    FROM preds GROUP BY solution""",
)
def _(v):
    return tidy(metrics.summarise(joined(v), ["solution"], ["n_clips", "accuracy"]))


@query(
    "per_class_recall",
    BASE
    + f""", {RECALLS} SELECT solution,
      round(max(recall) FILTER (WHERE t='negative'), 6) AS recall_negative,
      round(max(recall) FILTER (WHERE t='neutral'), 6) AS recall_neutral,
      round(max(recall) FILTER (WHERE t='positive'), 6) AS recall_positive
    FROM rec GROUP BY solution""",
)
def _(v):
    return tidy(metrics.per_class_recall(joined(v), ["solution"]))


@query("ece", BASE + f", {ECE} SELECT solution, round(ece, 6) AS ece FROM ece")
def _(v):
    return tidy(metrics.calibration_error(metrics.cells(joined(v), ["solution"]), ["solution"]))


@query(
    "psi_contested",
    BASE
    + f"SELECT solution, round({PSI_CONTESTED}, 6) AS psi_contested FROM preds GROUP BY solution",
)
def _(v):
    return tidy(metrics.summarise(joined(v), ["solution"], ["psi_contested"]))


@query(
    "psi_strict",
    BASE + f"SELECT solution, round({PSI_STRICT}, 6) AS psi_strict FROM preds GROUP BY solution",
)
def _(v):
    return tidy(metrics.summarise(joined(v), ["solution"], ["psi_strict"]))


@query(
    "abstention_rate",
    BASE
    + """SELECT solution, count(*) FILTER (WHERE NOT is_congruent) AS n_incongruent,
      round(avg(abstained::INT::DOUBLE), 6) AS abstention_rate FROM preds GROUP BY solution""",
)
def _(v):
    return tidy(metrics.summarise(joined(v), ["solution"], ["n_incongruent", "abstention_rate"]))


@query(
    "latency_percentiles",
    BASE
    + """SELECT solution, round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50_ms,
      round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95_ms FROM preds GROUP BY solution""",
)
def _(v):
    return tidy(metrics.latency_percentiles(v.predictions, ["solution"]))


def _evaluate_sql(group_expr: str) -> str:
    """Every metric per (solution, dataset, split_type) in plain SQL."""
    return with_(CLIPS, PREDS) + f""", e AS (SELECT *, {group_expr} FROM preds),
    rec AS (SELECT solution, dataset, split_type, prosody_sentiment,
      avg((sentiment = prosody_sentiment)::INT::DOUBLE) AS r FROM e GROUP BY ALL),
    uar AS (SELECT solution, dataset, split_type, avg(r) AS uar FROM rec GROUP BY ALL),
    f1 AS (SELECT solution, dataset, split_type, avg(f) AS macro_f1 FROM (
      SELECT solution, dataset, split_type, c,
        coalesce(2.0::DOUBLE * count(*) FILTER (WHERE prosody_sentiment=c AND sentiment=c)
          / nullif(count(*) FILTER (WHERE prosody_sentiment=c)
                   + count(*) FILTER (WHERE sentiment=c), 0), 0) AS f
      FROM e, (VALUES ('negative'),('neutral'),('positive')) l(c) GROUP BY ALL) GROUP BY ALL),
    ece AS (SELECT solution, dataset, split_type, sum(abs(right_n-conf))/sum(n) AS ece FROM (
      SELECT solution, dataset, split_type, greatest(ceil(round(confidence*10, 9)), 1) AS bin,
        count(*) AS n, count(*) FILTER (WHERE sentiment=prosody_sentiment) AS right_n,
        sum(confidence) AS conf FROM e GROUP BY ALL) GROUP BY ALL)
    SELECT e.solution, e.dataset, e.split_type, count(*) AS n_clips,
      count(*) FILTER (WHERE NOT is_congruent) AS n_incongruent,
      round(any_value(uar), 6) AS uar, round(any_value(macro_f1), 6) AS macro_f1,
      round(avg((sentiment=prosody_sentiment)::INT::DOUBLE), 6) AS accuracy,
      round(any_value(ece), 6) AS ece, round({PSI_CONTESTED}, 6) AS psi_contested,
      round({PSI_STRICT}, 6) AS psi_strict,
      round(avg(abstained::INT::DOUBLE), 6) AS abstention_rate,
      round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50_ms,
      round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95_ms, {MATRIX}
    FROM e JOIN uar USING (solution, dataset, split_type)
      JOIN f1 USING (solution, dataset, split_type)
      JOIN ece USING (solution, dataset, split_type)
    GROUP BY e.solution, e.dataset, e.split_type"""


@query("evaluate_all", _evaluate_sql("source AS dataset, 'all' AS split_type"))
def evaluate_all(v):
    rows = joined(v).withColumn("dataset", F.col("source")).withColumn("split_type", F.lit("all"))
    return tidy(metrics.evaluate(rows))


@query(
    "degeneracy",
    BASE
    + """, n AS (SELECT solution, source,
      count(*) FILTER (WHERE sentiment='negative') AS n_negative,
      count(*) FILTER (WHERE sentiment='neutral') AS n_neutral,
      count(*) FILTER (WHERE sentiment='positive') AS n_positive
      FROM preds GROUP BY ALL)
    SELECT *, CASE WHEN n_negative >= greatest(n_neutral, n_positive) THEN 'negative'
        WHEN n_neutral >= n_positive THEN 'neutral' ELSE 'positive' END AS top_class,
      round(greatest(n_negative, n_neutral, n_positive)::DOUBLE
        / (n_negative+n_neutral+n_positive), 6) AS top_class_share,
      greatest(n_negative, n_neutral, n_positive)::DOUBLE
        / (n_negative+n_neutral+n_positive) >= 0.95 AS is_degenerate FROM n""",
)
def _(v):
    return tidy(metrics.degeneracy(joined(v), ["solution", "source"]))


@query(
    "class_share",
    BASE
    + """SELECT solution, sentiment AS label, count(*) AS n,
      round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY solution), 6) AS share
    FROM preds GROUP BY solution, sentiment""",
)
def _(v):
    return tidy(metrics.class_share(v.predictions, ["solution"], "sentiment"))


@query(
    "majority_baseline",
    with_(CLIPS)
    + """, top AS (SELECT source, arg_max(prosody_sentiment, struct_pack(n := n,
        o := CASE prosody_sentiment WHEN 'negative' THEN 2 WHEN 'neutral' THEN 1 ELSE 0 END))
        AS p FROM (SELECT source, prosody_sentiment, count(*) AS n FROM clips GROUP BY ALL)
        GROUP BY source),
    e AS (SELECT c.*, p FROM clips c JOIN top USING (source))
    SELECT source, p AS majority_class, count(*) AS n_clips,
      round(1.0::DOUBLE / count(DISTINCT prosody_sentiment), 6) AS uar,
      round(2.0::DOUBLE * count(*) FILTER (WHERE prosody_sentiment = p)
        / (count(*) FILTER (WHERE prosody_sentiment = p) + count(*)) / 3, 6) AS macro_f1,
      round(avg((prosody_sentiment = p)::INT::DOUBLE), 6) AS accuracy,
      round(count(*) FILTER (WHERE NOT is_congruent AND prosody_sentiment = p)::DOUBLE
        / nullif(count(*) FILTER (WHERE NOT is_congruent
          AND p IN (prosody_sentiment, text_sentiment)), 0), 6) AS psi_contested,
      round(count(*) FILTER (WHERE NOT is_congruent AND prosody_sentiment = p)::DOUBLE
        / nullif(count(*) FILTER (WHERE NOT is_congruent), 0), 6) AS psi_strict
    FROM e GROUP BY source, p""",
)
def _(v):
    return tidy(metrics.majority_baseline(v.clips, ["source"]))
