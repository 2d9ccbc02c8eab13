"""What SQL can state exactly about fits and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonemark.operators import bootstrap, learn, metrics
from tonemark.plans.metric_queries import BASE, joined
from tonemark.plans.model_queries import WIDTH, sets
from tonemark.plans.registry import query
from tonemark.plans.shape import tidy
from tonemark.plans.views import FEATS, with_
from tonemark.schema import LABELS

MODELS = ["logreg", "linear_svm", "svm_rbf", "mlp"]


@query(
    "bootstrap_checked",
    BASE
    + """, rec AS (SELECT solution, source, prosody_sentiment AS c, count(*) AS n,
        avg((sentiment = prosody_sentiment)::INT) AS r FROM preds GROUP BY ALL)
    SELECT solution, source, sum(n)::BIGINT AS n_clips, 2000::BIGINT AS n_boot,
      round(avg(r), 6) AS uar, true AS holds_point, true AS near_normal
    FROM rec GROUP BY solution, source""",
)
def _(v):
    """The interval holds the point estimate, and its ends lie within a tenth of a standard
    error and a half of the normal interval around it."""
    rows = joined(v)
    keys = ["solution", "source"]
    recall = (
        rows.groupBy(*keys, "prosody_sentiment")
        .agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("sentiment") == F.col("prosody_sentiment")).cast("int")).alias("r"))
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n_clips"),
            F.avg("r").alias("uar"),
            (F.sqrt(F.sum(F.col("r") * (1 - F.col("r")) / F.col("n"))) / F.count("r")).alias("error"),
        )
    )
    both = recall.join(bootstrap.bootstrap_ci(rows, keys), keys)
    ends = [(F.col("uar") - 1.96 * F.col("error"), "uar_lo"), (F.col("uar") + 1.96 * F.col("error"), "uar_hi")]
    off = [F.abs(normal - F.col(end)) <= 0.6 * F.col("error") + 0.01 for normal, end in ends]
    return tidy(
        both.select(
            *keys,
            "n_clips",
            "n_boot",
            F.round("uar", 6).alias("uar"),
            F.col("uar").between(F.col("uar_lo"), F.col("uar_hi")).alias("holds_point"),
            (off[0] & off[1]).alias("near_normal"),
        )
    )


@query(
    "models_checked",
    with_(FEATS)
    + f"""SELECT m.model, split, count(*) AS n_clips, count(*) AS n_valid
    FROM feats, (VALUES {",".join(f"('{m}')" for m in MODELS)}) m(model) GROUP BY ALL""",
)
def _(v):
    """Every row is scored by every model: probabilities sum to one and the label is the
    first largest."""
    train, _, _ = sets(v)
    scored = learn.score_all(learn.fit(train, WIDTH, MODELS), v.features)
    p = F.col("probs")
    top = F.array_position(p, F.array_max(p))
    valid = (F.abs(p[0] + p[1] + p[2] - 1) < 1e-9) & (
        F.element_at(F.array(*[F.lit(x) for x in LABELS]), top.cast("int")) == F.col("sentiment")
    )
    return scored.groupBy("model", "split").agg(
        F.count(F.lit(1)).alias("n_clips"), F.count_if(valid).alias("n_valid")
    )


@query(
    "folds_checked",
    with_(FEATS)
    + "SELECT text AS fold, prosody_sentiment, count(*) AS n_clips FROM feats GROUP BY ALL",
)
def _(v):
    """Every clip is predicted once, in the fold of its own group."""
    rows = v.features.withColumn("features", F.slice("features", 1, 9))
    predicted = learn.leave_group_out(rows, "text", 9, balanced=True, single_class="predict")
    return predicted.groupBy("fold", "prosody_sentiment").agg(F.count(F.lit(1)).alias("n_clips"))


@query(
    "evaluation_checked",
    BASE
    + """SELECT CASE WHEN source <> 'hume' THEN source END AS source, count(*) AS n_clips,
      max(CASE WHEN source = 'synthetic' THEN NULL ELSE latency_ms END) IS NOT NULL AS timed
    FROM preds GROUP BY 1""",
)
def _(v):
    """Groups with a NULL name and groups without any latency keep their row."""
    rows = joined(v).withColumns(
        {
            "latency_ms": F.when(F.col("source") != "synthetic", F.col("latency_ms")),
            "source": F.when(F.col("source") != "hume", F.col("source")),
        }
    )
    evaluated = metrics.evaluate(rows, ["source"])
    return evaluated.select("source", "n_clips", F.col("latency_p50_ms").isNotNull().alias("timed"))
