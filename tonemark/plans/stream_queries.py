"""Streaming jobs, drained to a table so that batch SQL can check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonemark.functions.labels import literal_map
from tonemark.plans.label_queries import CONF, VAD, vad_view
from tonemark.plans.registry import query
from tonemark.plans.shape import tidy
from tonemark.plans.source_queries import FIRST_LAST, _vector
from tonemark.plans.views import CLIPS, FEATS, Views, with_
from tonemark.schema import LABELS
from tonemark.sources.storage import new_path
from tonemark.streaming import feature_store, scoring


class StreamViews(Views):
    """The same views over tables read as streams."""

    def table(self, name: str):
        static = super().table(name)
        # A pattern, as a stream takes no path of a single file; it fits a folder of files too.
        return self.spark.readStream.schema(static.schema).parquet(f"{self.sf_dir}/{name}.parque[t]")


def requests(v):
    """Clips as requests: a sample count, a rate, a valence and a lexical vector."""
    lexical = F.array(
        *[F.when(F.col("text_sentiment") == x, F.lit(0.8)).otherwise(F.lit(0.1)) for x in LABELS]
    )
    rate = literal_map({"crema_d": 16_000, "synthetic": 44_100, "recorded": 48_000})
    return vad_view(v).select(
        "clip_id",
        F.floor(F.col("value") * 20_000).alias("n_samples"),
        F.try_element_at(rate, F.col("source")).alias("sample_rate"),
        "valence",
        lexical.alias("lexical_probs"),
    )


@query(
    "stream_score",
    with_(CLIPS, VAD, CONF)
    + """, r AS (SELECT f.clip_id, f.sentiment, f.confidence, f.text_sentiment,
        CASE WHEN floor(c.value*20000) = 0 THEN 'no audio submitted'
          WHEN floor(c.value*20000) > 2880000 THEN 'clip too long'
          WHEN c.source = 'hume' THEN 'invalid sample rate' END AS reason
      FROM conf f JOIN clips c USING (clip_id)),
    l AS (SELECT clip_id, reason, """
    + ", ".join(
        f"""0.4::DOUBLE*ln(CASE WHEN text_sentiment='{x}' THEN 0.8 ELSE 0.1 END::DOUBLE)
        + 0.6::DOUBLE*ln(greatest(CASE WHEN sentiment='{x}' THEN confidence
          ELSE (1-confidence)/2 END, 1e-9)) AS l{i}"""
        for i, x in enumerate(LABELS)
    )
    + """ FROM r),
    e AS (SELECT *, exp(l0) AS e0, exp(l1) AS e1, exp(l2) AS e2 FROM l)
    SELECT clip_id, reason,
      CASE WHEN reason IS NULL THEN round(greatest(e0,e1,e2)/(e0+e1+e2), 6) END AS confidence,
      CASE WHEN reason IS NULL THEN greatest(e0,e1,e2)/(e0+e1+e2) < 0.6 END AS abstained FROM e""",
)
def _(v):
    live = StreamViews(v.spark, v.sf_dir)
    scored = scoring.score_requests(requests(live), weight=0.4, abstain_threshold=0.6)
    table = scoring.drain_to_table(
        scored, new_path(v.spark, "scored"), new_path(v.spark, "scored-checkpoint")
    )
    return tidy(table.select("clip_id", "reason", "confidence", "abstained"))


@query("stream_feature_store", with_(FEATS) + f"SELECT {FIRST_LAST} FROM feats")
def _(v):
    live = StreamViews(v.spark, v.sf_dir)
    clips = live.features.withColumn("payload", F.col("features"))
    store = feature_store.run(
        clips, _vector, 64, new_path(v.spark, "store"), new_path(v.spark, "store-checkpoint")
    )
    return tidy(
        store.select(
            "clip_id",
            F.size("features").alias("width"),
            F.col("features")[0].cast("double").alias("first_value"),
            F.element_at("features", -1).cast("double").alias("last_value"),
        )
    )
