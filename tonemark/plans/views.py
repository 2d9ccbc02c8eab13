"""The driver's tables seen as clips, predictions, features and frames.

Every view exists twice: as a DataFrame and as a SQL common table expression
with the same columns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemark.functions.hashing import stable_hash
from tonemark.functions.labels import congruent, pick
from tonemark.schema import LABELS, SOURCES
from tonemark.sources.tables import scan_parquet


def split_by_hash(bucket: Column) -> Column:
    return F.when(bucket < 2, "test").when(bucket < 3, "val").otherwise("train")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return scan_parquet(self.spark, f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def clips(self) -> DataFrame:
        e = F.col("event_id")
        clip_id = F.concat(F.lit("ev_"), e.cast("string"))
        speaker = F.concat(F.lit("u_"), F.col("user_id").cast("string"))
        kind = F.col("event_type")
        prosody = (
            F.when(kind == "error", "negative")
            .when(kind.isin("view", "click"), "neutral")
            .otherwise("positive")
        )
        seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2020-01-01 00:00:00', ts)")
        return self.table("events").select(
            clip_id.alias("clip_id"),
            F.concat(F.lit("audio/"), clip_id, F.lit(".wav")).alias("path"),
            speaker.alias("speaker_id"),
            pick(SOURCES, e % 4).alias("source"),
            F.concat(F.lit("carrier "), (e % 15).cast("string")).alias("text"),
            pick(LABELS, (e * 7 + F.col("user_id")) % 3).alias("text_sentiment"),
            prosody.alias("prosody_sentiment"),
            kind.alias("emotion_tag"),
            F.concat(F.lit("v"), (e % 2).cast("string")).alias("voice_id"),
            congruent(F.col("text_sentiment"), F.col("prosody_sentiment")).alias("is_congruent"),
            split_by_hash(stable_hash("split", speaker) % 10).alias("split"),
            e.alias("event_id"),
            F.col("user_id"),
            (seconds / F.lit(1e6)).alias("t"),
            F.col("value"),
        )

    @cached_property
    def manifest(self) -> DataFrame:
        from tonemark.schema import MANIFEST_COLUMNS

        return self.clips.select(*MANIFEST_COLUMNS)

    def scored(self, solutions=("A", "B")) -> DataFrame:
        """Clips with the prediction of every solution attached."""
        def draws(solution: str) -> Column:
            key = F.concat_ws("|", F.lit(solution), "clip_id")
            return F.struct(
                F.lit(solution).alias("solution"),
                stable_hash(key).alias("hv"),
                F.array(*[stable_hash(key, x) % 100 for x in LABELS]).alias("hw"),
            )

        # The hashes are made inside the exploded array, once per row.
        drawn = F.explode(F.array(*[draws(s) for s in solutions]))
        c = self.clips.withColumn("_d", drawn).select(*self.clips.columns, "_d.*")
        tenth = F.col("hv") % 10
        chosen = (
            F.when(tenth < 4, F.col("prosody_sentiment"))
            .when(tenth < 7, F.col("text_sentiment"))
            .otherwise(pick(LABELS, F.col("hv") % 3))
        )
        c = c.withColumn("sentiment", chosen)
        w = [
            F.lit(1)
            + F.col("hw")[i]
            + F.when(F.col("sentiment") == x, F.lit(150)).otherwise(F.lit(0))
            for i, x in enumerate(LABELS)
        ]
        total = (w[0] + w[1] + w[2]).cast("double")
        c = c.withColumn("probs", F.array(*[x.cast("double") / total for x in w]))
        confidence = F.array_max("probs")
        return c.withColumn("confidence", confidence).select(
            *self.clips.columns,
            "solution",
            "sentiment",
            "probs",
            "confidence",
            (F.lit(1) + F.col("hv") % 500).cast("double").alias("latency_ms"),
            (F.col("confidence") < 0.57).alias("abstained"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Predictions alone, to be joined back to the clips by id."""
        return self.scored().select(
            "clip_id", "solution", "sentiment", "probs", "confidence", "latency_ms", "abstained"
        )

    @cached_property
    def features(self) -> DataFrame:
        v, label = F.col("vec_id"), F.col("label")
        speaker = v % 20
        return self.table("embeddings").select(
            F.concat(F.lit("vec_"), v.cast("string")).alias("clip_id"),
            F.concat(F.lit("spk_"), speaker.cast("string")).alias("speaker_id"),
            F.concat(F.lit("carrier "), (v % 15).cast("string")).alias("text"),
            pick(LABELS, (v + label) % 3).alias("text_sentiment"),
            F.when(label < 4, "negative")
            .when(label < 7, "neutral")
            .otherwise("positive")
            .alias("prosody_sentiment"),
            (F.col("text_sentiment") == F.col("prosody_sentiment")).alias("is_congruent"),
            F.when(speaker < 4, "test").when(speaker < 6, "val").otherwise("train").alias("split"),
            F.col("embedding").cast("array<double>").alias("features"),
            v.alias("vec_id"),
            label.cast("bigint").alias("label"),
        )

    @cached_property
    def big_clips(self) -> DataFrame:
        flag = F.col("l_returnflag")
        keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        return self.table("lineitem").select(
            F.concat_ws("-", *[F.col(k).cast("string") for k in keys]).alias("clip_id"),
            F.concat(F.lit("s_"), F.col("l_suppkey").cast("string")).alias("speaker_id"),
            F.when(flag == "A", "negative")
            .when(flag == "N", "neutral")
            .otherwise("positive")
            .alias("prosody_sentiment"),
            pick(LABELS, (F.col("l_orderkey") + F.col("l_linenumber")) % 3).alias(
                "text_sentiment"
            ),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
        )

    @cached_property
    def texts(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "text", "lang", "source", "n_chars")
        labels = self.table("labels").select("doc_id", "quality", "toxic")
        return docs.join(labels, "doc_id", "left")


def h(expr: str) -> str:
    return f"('0x'||substr(md5({expr}),1,15))::BIGINT"


def label_at(expr: str) -> str:
    return f"(['negative','neutral','positive'])[1+({expr})]"


CLIPS = f"""clips AS (
  SELECT *, text_sentiment = prosody_sentiment AS is_congruent,
    CASE WHEN {h("'split|'||speaker_id")} % 10 < 2 THEN 'test'
         WHEN {h("'split|'||speaker_id")} % 10 < 3 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT 'ev_'||event_id AS clip_id, 'audio/ev_'||event_id||'.wav' AS path,
    'u_'||user_id AS speaker_id,
    (['crema_d','synthetic','recorded','hume'])[1+event_id%4] AS source,
    'carrier '||(event_id%15) AS text,
    {label_at("(event_id*7+user_id)%3")} AS text_sentiment,
    CASE WHEN event_type='error' THEN 'negative'
         WHEN event_type IN ('view','click') THEN 'neutral' ELSE 'positive' END
      AS prosody_sentiment,
    event_type AS emotion_tag, 'v'||(event_id%2) AS voice_id,
    event_id, user_id, epoch(ts) - epoch(TIMESTAMP '2020-01-01') AS t, value
  FROM events))"""

PREDS = f"""preds AS (
  SELECT * EXCLUDE (w0,w1,w2), greatest(p0,p1,p2) AS confidence,
    greatest(p0,p1,p2) < 0.57 AS abstained, (1 + hv % 500)::DOUBLE AS latency_ms
  FROM (SELECT *, w0::DOUBLE/(w0+w1+w2) AS p0, w1::DOUBLE/(w0+w1+w2) AS p1,
               w2::DOUBLE/(w0+w1+w2) AS p2
  FROM (SELECT *,
    1+{h("solution||'|'||clip_id||'|negative'")}%100
      + CASE WHEN sentiment='negative' THEN 150 ELSE 0 END AS w0,
    1+{h("solution||'|'||clip_id||'|neutral'")}%100
      + CASE WHEN sentiment='neutral' THEN 150 ELSE 0 END AS w1,
    1+{h("solution||'|'||clip_id||'|positive'")}%100
      + CASE WHEN sentiment='positive' THEN 150 ELSE 0 END AS w2
  FROM (SELECT *, CASE WHEN hv%10<4 THEN prosody_sentiment WHEN hv%10<7 THEN text_sentiment
                       ELSE {label_at("hv%3")} END AS sentiment
  FROM (SELECT c.*, s.solution, {h("s.solution||'|'||c.clip_id")} AS hv
        FROM clips c, (VALUES ('A'),('B')) s(solution))))))"""

FEATS = f"""feats AS (
  SELECT *, text_sentiment = prosody_sentiment AS is_congruent FROM (
  SELECT 'vec_'||vec_id AS clip_id, 'spk_'||(vec_id%20) AS speaker_id,
    'carrier '||(vec_id%15) AS text,
    {label_at("(vec_id+label)%3")} AS text_sentiment,
    CASE WHEN label<4 THEN 'negative' WHEN label<7 THEN 'neutral' ELSE 'positive' END
      AS prosody_sentiment,
    CASE WHEN vec_id%20<4 THEN 'test' WHEN vec_id%20<6 THEN 'val' ELSE 'train' END AS split,
    embedding::DOUBLE[] AS features, vec_id, label::BIGINT AS label FROM embeddings))"""

BIG = f"""big AS (
  SELECT l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey AS clip_id,
    's_'||l_suppkey AS speaker_id,
    CASE l_returnflag WHEN 'A' THEN 'negative' WHEN 'N' THEN 'neutral' ELSE 'positive' END
      AS prosody_sentiment,
    {label_at("(l_orderkey+l_linenumber)%3")} AS text_sentiment,
    l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax
  FROM lineitem)"""

TEXTS = """texts AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

# Descriptor columns per vector: the first nine dimensions of the embedding.
LONG = """long AS (
  SELECT clip_id, speaker_id, text, text_sentiment, prosody_sentiment, is_congruent, split,
    unnest(range(1, len(features)+1)) AS dim, unnest(features) AS x FROM feats)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def const(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"
