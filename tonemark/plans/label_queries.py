"""Projections, filters and joins over the clip, prediction and feature views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonemark import fixed_values as fixed
from tonemark.functions import arrays, labels, probs, voice
from tonemark.operators import filters, grids, joins, metrics
from tonemark.plans.metric_queries import joined
from tonemark.plans.registry import query
from tonemark.plans.shape import tidy
from tonemark.plans.source_queries import (
    _probe_text_sql,
    _sql_list,
)
from tonemark.plans.views import CLIPS, FEATS, PREDS, TEXTS, const, h, with_
from tonemark.schema import LABELS

ALL_TAGS = [t for ts in fixed.EMOTION_TAGS["cartesia"].values() for t in ts] + fixed.AMBIGUOUS_TAGS
PROBE_TAGS = [*ALL_TAGS, "gleeful"]


def probs_sql(prefix="p"):
    return ", ".join(
        f"round({prefix}{i}, 6) AS prob_{name[:3]}" for i, name in enumerate(LABELS)
    )


def split_probs(column, prefix="prob"):
    return [column[i].alias(f"{prefix}_{x[:3]}") for i, x in enumerate(LABELS)]


def _tag_case(expr):
    whens = []
    for label, tags in fixed.EMOTION_TAGS["cartesia"].items():
        whens.append(f"WHEN {expr} IN ({','.join(const(t) for t in tags)}) THEN '{label}'")
    return "CASE " + " ".join(whens) + " END"


AMBIGUOUS_SQL = "(" + ",".join(const(t) for t in fixed.AMBIGUOUS_TAGS) + ")"


@query(
    "map_emotion",
    f"""WITH t AS (SELECT event_id, ({_sql_list(PROBE_TAGS)})[1+(event_id*11+user_id)%59] AS tag
      FROM events)
    SELECT 'ev_'||event_id AS clip_id, tag,
      CASE WHEN tag IN {AMBIGUOUS_SQL} THEN NULL ELSE {_tag_case("tag")} END AS sentiment,
      CASE WHEN tag IN {AMBIGUOUS_SQL} THEN 'ambiguous'
        WHEN tag = 'gleeful' THEN 'unknown' ELSE 'mapped' END AS status FROM t""",
)
def _(v):
    tag = labels.pick(PROBE_TAGS, (F.col("event_id") * 11 + F.col("user_id")) % len(PROBE_TAGS))
    rows = v.clips.select("clip_id", tag.alias("tag"))
    mapped = labels.map_emotion(F.col("tag"), "cartesia")
    return rows.select("clip_id", "tag", mapped["sentiment"].alias("sentiment"),
                       mapped["status"].alias("status"))


@query("add_congruence", with_(CLIPS) + "SELECT clip_id, is_congruent FROM clips")
def _(v):
    from tonemark.sources.manifest import add_congruence

    return add_congruence(v.clips.drop("is_congruent")).select("clip_id", "is_congruent")


VAD = """vad AS (SELECT clip_id, source, emotion_tag, prosody_sentiment, text_sentiment,
    is_congruent, split, text, voice_id, event_id,
    least(value / 150, 1) AS valence, (event_id % 101) / 100.0::DOUBLE AS arousal
  FROM clips)"""


def vad_view(v):
    return v.clips.withColumn("valence", F.least(F.col("value") / 150, F.lit(1.0))).withColumn(
        "arousal", (F.col("event_id") % 101).cast("double") / F.lit(100.0)
    )


@query(
    "valence_to_sentiment",
    with_(CLIPS, VAD)
    + """SELECT clip_id, CASE WHEN valence <= 1.0::DOUBLE/3 THEN 'negative'
      WHEN valence >= 2.0::DOUBLE/3 THEN 'positive' ELSE 'neutral' END AS sentiment FROM vad""",
)
def _(v):
    return vad_view(v).select(
        "clip_id", labels.valence_to_sentiment(F.col("valence")).alias("sentiment")
    )


@query(
    "vad_quadrant",
    with_(CLIPS, VAD)
    + """SELECT clip_id, CASE WHEN valence >= 0.5 THEN 'fine' WHEN arousal >= 0.5 THEN 'agitated'
      ELSE 'withdrawn' END AS quadrant FROM vad""",
)
def _(v):
    return vad_view(v).select(
        "clip_id", labels.vad_quadrant(F.col("valence"), F.col("arousal")).alias("quadrant")
    )


@query(
    "vad_clip_reorder",
    with_(FEATS)
    + """SELECT clip_id, round(greatest(least(features[3]*4, 1), 0), 6) AS valence,
      round(greatest(least(features[1]*4, 1), 0), 6) AS arousal,
      round(greatest(least(features[2]*4, 1), 0), 6) AS dominance FROM feats""",
)
def _(v):
    raw = F.transform(F.slice("features", 1, 3), lambda x: x * 4)
    vad = labels.vad_from_model_output(raw)
    return tidy(v.features.select("clip_id", vad.alias("v")).select("clip_id", "v.*"))


CONF = """conf AS (SELECT *, CASE WHEN valence <= 1.0::DOUBLE/3 THEN 'negative'
      WHEN valence >= 2.0::DOUBLE/3 THEN 'positive' ELSE 'neutral' END AS sentiment,
    1.0::DOUBLE/3 + (2.0::DOUBLE/3) * least(1, CASE
      WHEN valence <= 1.0::DOUBLE/3 THEN (1.0::DOUBLE/3 - valence) / (1.0::DOUBLE/3)
      WHEN valence >= 2.0::DOUBLE/3 THEN (valence - 2.0::DOUBLE/3) / (1 - 2.0::DOUBLE/3)
      ELSE least(valence - 1.0::DOUBLE/3, 2.0::DOUBLE/3 - valence) / (1.0::DOUBLE/6) END)
      AS confidence FROM vad)"""


@query(
    "threshold_confidence",
    with_(CLIPS, VAD, CONF) + "SELECT clip_id, round(confidence, 6) AS confidence FROM conf",
)
def _(v):
    c = labels.threshold_confidence(F.col("valence"))
    return tidy(vad_view(v).select("clip_id", c.alias("confidence")))


@query(
    "soft_onehot",
    with_(CLIPS, VAD, CONF)
    + "SELECT clip_id, "
    + ", ".join(
        f"round(CASE WHEN sentiment='{x}' THEN confidence ELSE (1-confidence)/2 END, 6)"
        f" AS prob_{x[:3]}"
        for x in LABELS
    )
    + " FROM conf",
)
def _(v):
    vector = probs.soft_onehot(
        labels.valence_to_sentiment(F.col("valence")),
        labels.threshold_confidence(F.col("valence")),
    )
    rows = vad_view(v).select("clip_id", vector.alias("p"))
    return tidy(rows.select("clip_id", *split_probs(F.col("p"))))


DOC_SCORES = """sc AS (SELECT doc_id, text, (1 + n_chars % 7)::DOUBLE AS a,
    (1 + n_chars % 11)::DOUBLE AS b, (1 + n_chars % 13)::DOUBLE AS c FROM texts)"""


def doc_scores(v):
    """Raw label -> score maps of a text classifier, derived from the documents."""
    n = F.col("n_chars")
    pairs = [
        F.struct(F.lit(x), (F.lit(1) + n % m).cast("double"))
        for x, m in zip(LABELS, (7, 11, 13), strict=True)
    ]
    return v.texts.select(
        "doc_id", "text", F.map_from_entries(F.array(*pairs)).alias("raw")
    )


@query(
    "normalise_probs",
    with_(TEXTS, DOC_SCORES)
    + """SELECT doc_id, round(a/(a+b+c), 6) AS prob_neg, round(b/(a+b+c), 6) AS prob_neu,
      round(c/(a+b+c), 6) AS prob_pos FROM sc""",
)
def _(v):
    rows = doc_scores(v).select("doc_id", probs.normalise(F.col("raw")).alias("p"))
    return tidy(rows.select("doc_id", *split_probs(F.col("p"))))


@query(
    "abstain_uniform",
    with_(TEXTS, DOC_SCORES)
    + """, m AS (SELECT *, row_number() OVER (PARTITION BY doc_id) AS k,
        contains(text, 'the') AS heard FROM sc)
    SELECT doc_id, NOT heard AS abstained,
      CASE WHEN NOT heard THEN 'neutral' WHEN a >= b AND a >= c THEN 'negative'
        WHEN b >= c THEN 'neutral' ELSE 'positive' END AS sentiment,
      round(CASE WHEN heard THEN greatest(a,b,c)/(a+b+c) ELSE 1.0::DOUBLE/3 END, 6) AS confidence
    FROM m""",
)
def _(v):
    # A document without the word "the" stands for an empty transcript.
    heard = F.col("text").contains("the")
    rows = doc_scores(v).withColumn("transcript", F.when(heard, F.col("text")).otherwise("  "))
    silent = F.trim("transcript") == ""
    vector = F.when(silent, probs.uniform()).otherwise(probs.normalise(F.col("raw")))
    rows = rows.select("doc_id", silent.alias("abstained"), vector.alias("p"))
    return tidy(
        rows.select(
            "doc_id",
            "abstained",
            F.when(F.col("abstained"), "neutral")
            .otherwise(probs.argmax_label(F.col("p")))
            .alias("sentiment"),
            F.array_max("p").alias("confidence"),
        )
    )


@query(
    "argmax_label",
    with_(CLIPS, PREDS)
    + """SELECT clip_id, solution, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'negative'
      WHEN p1 >= p2 THEN 'neutral' ELSE 'positive' END AS sentiment FROM preds""",
)
def _(v):
    return v.predictions.select(
        "clip_id", "solution", probs.argmax_label(F.col("probs")).alias("sentiment")
    )


def fused_sql(w="0.5::DOUBLE", t="1.0::DOUBLE"):
    """Fused probabilities f0..f2 per clip from the preds CTE."""
    logit = [
        f"({w}*ln(least(greatest(a.p{i},1e-9),1)) + (1-{w})*ln(least(greatest(b.p{i},1e-9),1)))/{t}"
        for i in range(3)
    ]
    return f"""fl AS (SELECT a.clip_id, a.prosody_sentiment, a.text_sentiment, a.is_congruent,
        a.split, a.text AS transcript, {", ".join(f"{x} AS l{i}" for i, x in enumerate(logit))}
      FROM preds a JOIN preds b ON a.clip_id=b.clip_id AND a.solution='A' AND b.solution='B'),
    fe AS (SELECT *, exp(l0-greatest(l0,l1,l2)) AS e0, exp(l1-greatest(l0,l1,l2)) AS e1,
        exp(l2-greatest(l0,l1,l2)) AS e2 FROM fl),
    fused AS (SELECT *, e0/(e0+e1+e2) AS f0, e1/(e0+e1+e2) AS f1, e2/(e0+e1+e2) AS f2 FROM fe)"""


def solution_pair(v):
    """Vectors of both solutions side by side, one row per clip."""
    p = v.predictions
    a = p.where("solution = 'A'").select("clip_id", F.col("probs").alias("probs_a"))
    b = p.where("solution = 'B'").select("clip_id", F.col("probs").alias("probs_b"))
    return a.join(b, "clip_id")


@query(
    "fuse_probs",
    with_(CLIPS, PREDS, fused_sql("0.3::DOUBLE", "1.5::DOUBLE"))
    + f"SELECT clip_id, {probs_sql('f')} FROM fused",
)
def _(v):
    fused = probs.fuse(F.col("probs_a"), F.col("probs_b"), F.lit(0.3), F.lit(1.5))
    rows = solution_pair(v).select("clip_id", fused.alias("p"))
    return tidy(rows.select("clip_id", *split_probs(F.col("p"))))


@query(
    "abstain_flag",
    with_(CLIPS, PREDS)
    + "SELECT clip_id, solution, confidence < 0.6 AS abstained FROM preds",
)
def _(v):
    return v.predictions.select(
        "clip_id", "solution", (F.col("confidence") < 0.6).alias("abstained")
    )


@query(
    "prob_fill_missing",
    with_(CLIPS, PREDS)
    + """SELECT clip_id, solution, round(CASE WHEN p0 > 0.2 THEN p0 ELSE 0 END, 6) AS prob_neg,
      round(CASE WHEN p1 > 0.2 THEN p1 ELSE 0 END, 6) AS prob_neu,
      round(CASE WHEN p2 > 0.2 THEN p2 ELSE 0 END, 6) AS prob_pos FROM preds""",
)
def _(v):
    known = F.map_filter(probs.to_map(F.col("probs")), lambda _, p: p > 0.2)
    rows = v.predictions.select("clip_id", "solution", probs.from_map(known).alias("p"))
    return tidy(rows.select("clip_id", "solution", *split_probs(F.col("p"))))


@query(
    "valence_proxy",
    with_(CLIPS, PREDS) + "SELECT clip_id, solution, round(p2 - p0, 6) AS proxy FROM preds",
)
def _(v):
    return tidy(
        v.predictions.select(
            "clip_id", "solution", probs.valence_proxy(F.col("probs")).alias("proxy")
        )
    )


@query(
    "prediction_checks",
    with_(CLIPS, PREDS)
    + """SELECT solution, 0::BIGINT AS wrong_keys, 0::BIGINT AS bad_sum,
      count(*) FILTER (WHERE abs(confidence - greatest(p0,p1,p2)) > 1e-6) AS bad_confidence,
      count(*) FILTER (WHERE value/150 > 1) AS vad_outside FROM preds GROUP BY solution""",
)
def _(v):
    rows = joined(v).withColumn("vad_valence", F.col("value") / 150)
    return tidy(metrics_checks(rows))


def metrics_checks(rows):
    from tonemark.operators.scoring import prediction_checks

    return prediction_checks(
        rows.withColumn("probs", probs.to_map(F.col("probs"))), ["solution"], vad="vad_valence"
    )


@query(
    "avqi",
    with_(FEATS)
    + """SELECT clip_id, round(greatest(least((3.295::DOUBLE - 0.111::DOUBLE*features[1]
      - 0.073::DOUBLE*features[2] - 0.213::DOUBLE*features[3] + 2.789::DOUBLE*features[4]
      - 0.032::DOUBLE*CASE WHEN features[5] < 0 THEN NULL ELSE features[5] END
      + 0.077::DOUBLE*features[6]) * 2.571::DOUBLE + CASE WHEN features[5] < 0 THEN NULL
        ELSE 0 END, 10), 0), 6) AS avqi_raw FROM feats""".replace(
        "SELECT clip_id, round(", "SELECT clip_id, CASE WHEN features[5] < 0 THEN NULL ELSE round("
    ).replace(", 6) AS avqi_raw", ", 6) END AS avqi"),
)
def _(v):
    f = F.col("features")
    names = ("cpps", "hnr", "shimmer_local", "shimmer_local_db", "slope", "tilt")
    inputs = {n: f[i] for i, n in enumerate(names)}
    inputs["slope"] = F.when(f[4] >= 0, f[4])  # negative: the instrument failed
    return tidy(v.features.select("clip_id", voice.avqi(**inputs).alias("avqi")))


@query(
    "is_whispered",
    with_(CLIPS, VAD)
    + "SELECT clip_id, (valence*20 <= 5.0) AND (arousal*4 <= 2.0) AS whispered FROM vad",
)
def _(v):
    rows = vad_view(v)
    flag = voice.is_whispered(F.col("valence") * 20, F.col("arousal") * 4)
    return rows.select("clip_id", flag.alias("whispered"))


@query(
    "speech_rate",
    with_(CLIPS)
    + """SELECT clip_id, round(CASE WHEN floor(value/20) = 0 THEN 0
        ELSE length(text) / floor(value/20) END, 6) AS rate,
      round(length(text) / nullif(floor(value/20), 0), 6) AS rate_or_null FROM clips""",
)
def _(v):
    seconds = F.floor(F.col("value") / 20).cast("double")
    text = F.col("text")
    return tidy(
        v.clips.select(
            "clip_id",
            voice.speech_rate(text, seconds).alias("rate"),
            voice.speech_rate(text, seconds, default=None).alias("rate_or_null"),
        )
    )


@query(
    "rms",
    with_(FEATS)
    + """SELECT clip_id, round(sqrt(list_sum(list_transform(features, lambda x: x*x))
      / len(features)), 6) AS rms FROM feats""",
)
def _(v):
    return tidy(v.features.select("clip_id", arrays.rms(F.col("features")).alias("rms")))


@query(
    "to_mono",
    with_(FEATS)
    + """, m AS (SELECT clip_id, list_transform(range(1, 33), lambda i:
        (features[i*2-1] + features[i*2]) / 2) AS mono FROM feats)
    SELECT clip_id, len(mono)::BIGINT AS n_frames, round(list_sum(mono), 6) AS total,
      round(mono[1], 6) AS first_frame FROM m""",
)
def _(v):
    frames = F.transform(
        F.sequence(F.lit(0), F.lit(31)), lambda i: F.slice(F.col("features"), i * 2 + 1, 2)
    )
    rows = v.features.select("clip_id", arrays.to_mono(frames).alias("mono"))
    return tidy(
        rows.select(
            "clip_id",
            F.size("mono").alias("n_frames"),
            arrays.array_sum(F.col("mono")).alias("total"),
            F.col("mono")[0].alias("first_frame"),
        )
    )


@query(
    "peak_normalise",
    with_(FEATS)
    + """, p AS (SELECT clip_id, features, list_max(list_transform(features, lambda x: abs(x)))
        AS peak FROM feats)
    SELECT clip_id, round(features[1] * (0.95::DOUBLE/peak), 6) AS first_sample,
      round(list_sum(list_transform(features, lambda x: abs(x))) * (0.95::DOUBLE/peak), 6)
        AS total FROM p""",
)
def _(v):
    rows = v.features.select("clip_id", arrays.peak_normalise(F.col("features")).alias("s"))
    return tidy(
        rows.select(
            "clip_id",
            F.col("s")[0].alias("first_sample"),
            arrays.array_sum(F.transform("s", lambda x: F.abs(x))).alias("total"),
        )
    )


@query(
    "duration",
    with_(FEATS) + "SELECT clip_id, round(len(features) / 16000.0::DOUBLE, 6) AS seconds FROM feats",
)
def _(v):
    return tidy(v.features.select("clip_id", arrays.duration_s(F.col("features")).alias("seconds")))


@query(
    "meanstd_pool",
    with_(FEATS)
    + """, fr AS (SELECT clip_id, unnest(range(0, 64)) AS i, unnest(features) AS x FROM feats)
    SELECT clip_id, i // 16 AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std
    FROM fr GROUP BY ALL""",
)
def _(v):
    from tonemark.operators.frames import meanstd_pool

    # Sixteen frames of four dimensions per clip.
    frames = v.features.select(
        "clip_id",
        F.transform(
            F.sequence(F.lit(1), F.lit(16)),
            lambda t: F.transform(
                F.sequence(F.lit(0), F.lit(3)), lambda d: F.element_at("features", d * 16 + t)
            ),
        ).alias("frames"),
    )
    pooled = meanstd_pool(frames)
    return tidy(
        pooled.select("clip_id", F.posexplode(F.slice("features", 1, 4)), "features").select(
            "clip_id",
            F.col("pos").alias("dim"),
            F.col("col").alias("mean"),
            F.element_at("features", F.col("pos") + 5).alias("std"),
        )
    )


@query(
    "concat_features",
    with_(FEATS)
    + """SELECT clip_id, 128::BIGINT AS width, round(features[1], 6) AS first_value,
      round(features[64], 6) AS middle_value, round(features[1] * features[1], 6) AS next_value,
      round(features[64] * features[64], 6) AS last_value FROM feats""",
)
def _(v):
    left = v.features.select("clip_id", F.col("features").alias("a"))
    right = v.features.select("clip_id", F.transform("features", lambda x: x * x).alias("b"))
    both = left.join(right, "clip_id").select("clip_id", F.concat("a", "b").alias("f"))
    return tidy(
        both.select(
            "clip_id",
            F.size("f").alias("width"),
            F.col("f")[0].alias("first_value"),
            F.col("f")[63].alias("middle_value"),
            F.col("f")[64].alias("next_value"),
            F.element_at("f", -1).alias("last_value"),
        )
    )


@query(
    "describe_topk",
    with_(FEATS)
    + """, e AS (SELECT clip_id, unnest(range(0, 64)) AS i, unnest(features) AS x FROM feats),
    r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY abs(x) DESC, i) AS rank
      FROM e)
    SELECT clip_id, rank, 'f'||i AS name, round(x, 6) AS value FROM r WHERE rank <= 8""",
)
def _(v):
    names = F.array(*[F.lit(f"f{i}") for i in range(64)])
    top = arrays.describe_topk(F.col("features"), 8, names)
    return tidy(
        v.features.select("clip_id", F.posexplode(top)).select(
            "clip_id", (F.col("pos") + 1).alias("rank"), "col.name", "col.value"
        )
    )


@query(
    "semitones",
    with_(CLIPS)
    + "SELECT clip_id, round(12 * log2(greatest(value, 1e-6) / 100), 6) AS st FROM clips",
)
def _(v):
    return tidy(v.clips.select("clip_id", arrays.semitones(F.col("value")).alias("st")))


@query(
    "clip_id_build",
    with_(CLIPS)
    + """SELECT clip_id, 'e5_'||replace(lower(text), ' ', '_')||'_'||text_sentiment
        ||(event_id%5)||'_'||prosody_sentiment AS built, replace(lower(text), ' ', '_') AS slug
    FROM clips""",
)
def _(v):
    slug = labels.slug(F.col("text"))
    return v.clips.select(
        "clip_id",
        F.concat_ws(
            "_",
            F.lit("e5"),
            slug,
            F.concat("text_sentiment", (F.col("event_id") % 5).cast("string")),
            "prosody_sentiment",
        ).alias("built"),
        slug.alias("slug"),
    )


@query(
    "carrier_group",
    with_(CLIPS)
    + """SELECT clip_id, CASE WHEN source IN ('hume','synthetic') THEN 'neutral_'||voice_id
      ELSE 'congruent_'||emotion_tag||'_'||voice_id END AS carrier_group FROM clips""",
)
def _(v):
    condition = F.when(F.col("source").isin("hume", "synthetic"), "neutral").otherwise("congruent")
    group = labels.carrier_group(F.col("emotion_tag"), condition, F.col("voice_id"))
    return v.clips.select("clip_id", group.alias("carrier_group"))


@query(
    "original_name",
    with_(CLIPS)
    + "SELECT clip_id, 'e3_'||split_part(clip_id, '_', 2) AS original FROM clips",
)
def _(v):
    return v.clips.select("clip_id", labels.original_name(F.col("clip_id")).alias("original"))


FAMILY_SQL = """fam AS (SELECT clip_id, solution, confidence,
    CASE WHEN solution = 'A' THEN 'A:lexical(small)'
      WHEN source IN ('hume', 'crema_d') THEN 'B:acoustic(permissive/logreg)'
      WHEN source = 'synthetic' THEN 'B:acoustic(research/vad)' ELSE 'D:prosodic(svm)' END AS name
  FROM preds)"""


@query(
    "solution_family",
    with_(CLIPS, PREDS, FAMILY_SQL)
    + """SELECT name, split_part(name, ':', 1) AS letter,
      CASE WHEN name LIKE 'A:%' THEN 'A - lexical'
        WHEN name LIKE 'B:%permissive%' THEN 'B - acoustic (permissive)'
        WHEN name LIKE 'B:%' THEN 'B - acoustic (research)' WHEN name LIKE 'C:%' THEN 'C - fusion'
        ELSE 'D - prosodic' END AS label, count(*) AS n FROM fam GROUP BY name""",
)
def _(v):
    source = F.col("source")
    name = (
        F.when(F.col("solution") == "A", "A:lexical(small)")
        .when(source.isin("hume", "crema_d"), "B:acoustic(permissive/logreg)")
        .when(source == "synthetic", "B:acoustic(research/vad)")
        .otherwise("D:prosodic(svm)")
    )
    counted = joined(v).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "name",
        labels.solution_letter(F.col("name")).alias("letter"),
        labels.solution_label(F.col("name")).alias("label"),
        "n",
    )


@query(
    "suspicious_flag",
    with_(CLIPS, PREDS)
    + """, r AS (SELECT solution, emotion_tag, avg((sentiment = prosody_sentiment)::INT::DOUBLE)
        AS u FROM preds GROUP BY ALL)
    SELECT solution, emotion_tag, round(u, 6) AS uar, u > 0.9 AS suspicious FROM r""",
)
def _(v):
    from tonemark.operators.scoring import suspicious

    scored = metrics.summarise(joined(v), ["solution", "emotion_tag"], ["uar"])
    return tidy(scored.withColumn("suspicious", suspicious(F.col("uar"))))


@query(
    "coalesce_label",
    with_(TEXTS)
    + """SELECT doc_id, lang AS text_label, coalesce(CASE quality WHEN 1 THEN 'en' WHEN 0 THEN 'xx'
        END, lang) AS prosody_label,
      lang = coalesce(CASE quality WHEN 1 THEN 'en' WHEN 0 THEN 'xx' END, lang) AS is_congruent
    FROM texts""",
)
def _(v):
    delivered = F.when(F.col("quality") == 1, "en").when(F.col("quality") == 0, "xx")
    prompts = v.texts.select(
        "doc_id", F.col("lang").alias("text_sentiment"), delivered.alias("prosody_sentiment")
    )
    return grids.prompt_manifest(prompts).select(
        "doc_id",
        F.col("text_sentiment").alias("text_label"),
        F.col("prosody_sentiment").alias("prosody_label"),
        "is_congruent",
    )


# --- filters -----------------------------------------------------------------


@query("filter_split", with_(CLIPS) + "SELECT clip_id, speaker_id FROM clips WHERE split='val'")
def _(v):
    return filters.by_split(v.clips, "val").select("clip_id", "speaker_id")


@query(
    "filter_whisper",
    with_(CLIPS)
    + """SELECT CASE WHEN emotion_tag = 'error' THEN clip_id||'_whisper' ELSE clip_id END
      AS clip_id, text FROM clips WHERE emotion_tag <> 'error'""",
)
def _(v):
    whisper = F.col("emotion_tag") == "error"
    named = v.clips.withColumn(
        "clip_id", F.when(whisper, F.concat("clip_id", F.lit("_whisper"))).otherwise(F.col("clip_id"))
    )
    return filters.without_whisper(named).select("clip_id", "text")


@query(
    "filter_incongruent",
    with_(CLIPS) + "SELECT clip_id FROM clips WHERE NOT is_congruent",
)
def _(v):
    return v.clips.where(~F.col("is_congruent")).select("clip_id")


@query(
    "dropna_features",
    with_(TEXTS)
    + """SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality IS NOT NULL AND
      toxic IS NOT NULL) AS n_kept, count(*) FILTER (WHERE quality IS NULL OR toxic IS NULL)
      AS n_dropped FROM texts GROUP BY lang""",
)
def _(v):
    return filters.completeness(v.texts, ["quality", "toxic"], ["lang"])


@query(
    "filter_voice",
    with_(CLIPS) + "SELECT clip_id, voice_id FROM clips WHERE voice_id = 'v1'",
)
def _(v):
    return v.clips.where(F.col("voice_id") == "v1").select("clip_id", "voice_id")


@query(
    "request_guard",
    """SELECT doc_id, CASE WHEN n_chars*1000 = 0 THEN 'no audio submitted'
        WHEN n_chars*1000 > 2880000 THEN 'clip too long'
        WHEN quality IS NULL THEN 'invalid sample rate' END AS reason
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(v):
    rate = F.when(F.col("quality").isNotNull(), F.lit(16_000))
    reason = filters.request_problem(F.col("n_chars") * 1000, rate)
    return v.texts.select("doc_id", reason.alias("reason"))


@query(
    "eval_cuts",
    with_(CLIPS, PREDS)
    + """, c AS (SELECT *, unnest(list_filter([CASE WHEN split='test' THEN 'test' END,
        CASE WHEN split='val' THEN 'val' END, 'all'], lambda x: x IS NOT NULL)) AS cut FROM preds),
    r AS (SELECT solution, cut, prosody_sentiment, count(*) AS n,
      avg((sentiment=prosody_sentiment)::INT::DOUBLE) AS r FROM c GROUP BY ALL)
    SELECT solution, cut, sum(n)::BIGINT AS n_clips, round(avg(r), 6) AS uar FROM r
    GROUP BY solution, cut""",
)
def _(v):
    split = F.col("split")
    cuts = {"test": split == "test", "val": split == "val", "all": F.lit(True)}
    rows = filters.named_cuts(joined(v), cuts)
    return tidy(metrics.summarise(rows, ["solution", "cut"], ["n_clips", "uar"]))


# --- joins -------------------------------------------------------------------


@query(
    "join_predictions",
    with_(CLIPS, PREDS)
    + """SELECT clip_id, solution, prosody_sentiment, sentiment,
      sentiment = prosody_sentiment AS correct FROM preds""",
)
def _(v):
    return joined(v).select(
        "clip_id",
        "solution",
        "prosody_sentiment",
        "sentiment",
        (F.col("sentiment") == F.col("prosody_sentiment")).alias("correct"),
    )


@query(
    "prediction_alignment",
    with_(CLIPS, PREDS)
    + """, p AS (SELECT * FROM preds WHERE confidence > 0.5),
    c AS (SELECT * FROM clips WHERE split <> 'val')
    SELECT s.solution, (SELECT count(*) FROM c) AS n_clips,
      (SELECT count(*) FROM p WHERE p.solution=s.solution) AS n_predictions,
      (SELECT count(*) FROM c WHERE clip_id NOT IN
        (SELECT clip_id FROM p WHERE p.solution='A')) * (s.solution='A')::INT
      + (SELECT count(*) FROM c WHERE clip_id NOT IN
        (SELECT clip_id FROM p WHERE p.solution='B')) * (s.solution='B')::INT AS n_missing,
      (SELECT count(*) FROM p WHERE p.solution=s.solution AND split='val') AS n_unknown
    FROM (VALUES ('A'),('B')) s(solution)""",
)
def _(v):
    return joins.prediction_alignment(
        v.clips.where("split <> 'val'"), v.predictions.where("confidence > 0.5")
    )


@query(
    "join_features",
    with_(FEATS)
    + """SELECT clip_id, prosody_sentiment, round(list_sum(features), 6) AS total FROM feats""",
)
def _(v):
    store = v.features.select("clip_id", "features")
    rows = joins.require_features(v.features.drop("features"), store)
    return tidy(
        rows.select(
            "clip_id", "prosody_sentiment", arrays.array_sum(F.col("features")).alias("total")
        )
    )


@query("anti_uncached", with_(FEATS) + "SELECT clip_id, split FROM feats WHERE split = 'val'")
def _(v):
    store = v.features.where("split <> 'val'")
    return joins.missing_features(v.features, store).select("clip_id", "split")


@query(
    "speaker_overlap",
    with_(CLIPS)
    + """SELECT DISTINCT speaker_id FROM clips WHERE source='crema_d' AND speaker_id IN
      (SELECT speaker_id FROM clips WHERE emotion_tag='error')""",
)
def _(v):
    return joins.speaker_overlap(
        v.clips.where("source = 'crema_d'"), v.clips.where("emotion_tag = 'error'")
    )


LEAKY = f"""leaky AS (SELECT * EXCLUDE (split), CASE WHEN {h("clip_id")} % 10 = 0 THEN 'test'
    WHEN {h("clip_id")} % 10 = 1 THEN 'val' WHEN {h("clip_id")} % 10 = 2 THEN ''
    ELSE 'train' END AS split FROM clips)"""


def leaky_clips(v):
    from tonemark.functions.hashing import stable_hash

    tenth = stable_hash(F.col("clip_id")) % 10
    split = F.when(tenth == 0, "test").when(tenth == 1, "val").when(tenth == 2, "")
    return v.clips.withColumn("split", split.otherwise("train"))


@query(
    "speaker_disjoint_assert",
    with_(CLIPS, LEAKY)
    + """SELECT speaker_id, bool_or(split='train') AS in_train, bool_or(split='val') AS in_val,
      bool_or(split='test') AS in_test FROM leaky WHERE split <> '' GROUP BY speaker_id
    HAVING count(DISTINCT split) > 1""",
)
def _(v):
    joins.assert_speaker_disjoint(v.clips)
    return joins.split_violations(leaky_clips(v))


@query(
    "split_intersections",
    with_(CLIPS, LEAKY)
    + """, s AS (SELECT DISTINCT speaker_id, split FROM leaky)
    SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM s a JOIN s b
      USING (speaker_id) WHERE (a.split, b.split) IN
        (('train','test'),('train','val'),('val','test')) GROUP BY ALL""",
)
def _(v):
    return joins.split_intersections(leaky_clips(v))


@query(
    "factorial_grid",
    with_(CLIPS)
    + f""", f AS (SELECT speaker_id, e.emotion, t.tc, n.len, s.sc FROM
      (SELECT DISTINCT speaker_id FROM clips),
      (VALUES {",".join(f"('{e}')" for e in fixed.PROBE_EMOTIONS)}) e(emotion),
      (VALUES ('neutral'),('congruent')) t(tc), (VALUES ('short'),('long')) n(len),
      (VALUES ('default'),('adjusted')) s(sc))
    SELECT speaker_id, 'd1_'||emotion||'_'||tc||'_'||len||'_'||sc||'_'||speaker_id AS clip_id, emotion,
      tc AS text_condition, len AS length, sc AS speed_condition,
      {_probe_text_sql("emotion", "tc", "len")} AS text,
      CASE WHEN sc='adjusted' THEN CASE WHEN emotion IN ('happy','angry') THEN 1.15
        WHEN emotion='frustrated' THEN 1.10 ELSE 0.85 END END::DOUBLE AS speed,
      'sonic-3' AS model_id, CASE WHEN tc='neutral' THEN 'neutral_'||len
        ELSE 'congruent_'||emotion||'_'||len END AS carrier_group FROM f""",
)
def _(v):
    return grids.emotion_probe_grid(v.clips.select("speaker_id").distinct())


@query(
    "described_grid",
    with_(CLIPS)
    + f"""SELECT speaker_id, 'hume_'||emotion||'_'||tc||'_'||len||'_'
        ||CASE WHEN d THEN 'desc' ELSE 'nodesc' END||'_'||speaker_id AS clip_id, emotion,
      tc AS text_condition, len AS length, d AS has_description,
      {_probe_text_sql("emotion", "tc", "len")} AS text,
      CASE WHEN tc='neutral' THEN 'neutral_'||len ELSE 'congruent_'||emotion||'_'||len END
        AS carrier_group
    FROM (SELECT DISTINCT speaker_id FROM clips),
      (VALUES {",".join(f"('{e}')" for e in fixed.PROBE_EMOTIONS)}) e(emotion),
      (VALUES ('neutral'),('congruent')) t(tc), (VALUES ('short'),('long')) n(len),
      (VALUES (true),(false)) s(d)""",
)
def _(v):
    return grids.described_grid(v.clips.select("speaker_id").distinct())


CARRIER_ROWS = "(VALUES " + ",".join(
    f"('{s}',{i}::BIGINT,{const(t)})" for s, ts in fixed.CARRIERS.items() for i, t in enumerate(ts)
) + ") c(ts, ci, text)"


@query(
    "delivery_grid",
    with_(CLIPS)
    + f"""SELECT speaker_id AS voice, ts AS text_sentiment, ci AS carrier_index, text,
      p AS prosody_sentiment, ts = p AS is_congruent,
      'e5_'||lower(speaker_id)||'_'||ts||ci||'_'||p AS clip_id
    FROM (SELECT DISTINCT speaker_id FROM clips), {CARRIER_ROWS},
      (VALUES ('positive'),('neutral'),('negative')) d(p)""",
)
def _(v):
    return grids.delivery_grid(v.clips.select(F.col("speaker_id").alias("voice")).distinct())


@query(
    "synthetic_grid",
    with_(CLIPS)
    + f"""SELECT 'e2_'||ts||'_'||ci||'_'||p||'_'||speaker_id AS clip_id,
      'cartesia_'||speaker_id AS speaker_id, text, ts AS text_sentiment, p AS prosody_sentiment,
      CASE p WHEN 'positive' THEN 'content' WHEN 'neutral' THEN 'neutral' ELSE 'angry' END
        AS emotion_tag, ts = p AS is_congruent
    FROM (SELECT DISTINCT speaker_id FROM clips), {CARRIER_ROWS},
      (VALUES ('positive'),('neutral'),('negative')) d(p)""",
)
def _(v):
    return grids.synthetic_grid(v.clips.select(F.col("speaker_id").alias("voice")).distinct())


@query(
    "prompt_grid",
    with_(CLIPS)
    + f""", s AS (SELECT DISTINCT speaker_id FROM clips), p AS (
      SELECT 'e3_'||speaker_id||'_'||ts||'_'||ci||'_'||d.p AS clip_id, speaker_id, text,
        ts AS text_sentiment, d.p AS prosody_sentiment
      FROM s, {CARRIER_ROWS}, (VALUES ('positive'),('neutral'),('negative')) d(p) WHERE ci < 3
      UNION ALL SELECT 'e3_'||speaker_id||'_whisper_'||i, speaker_id, t, 'neutral', 'neutral'
      FROM s, (VALUES {",".join(f"({i},{const(t)})" for i, t in enumerate(fixed.WHISPER_PROMPTS))})
        w(i, t))
    SELECT *, text_sentiment = prosody_sentiment AS is_congruent FROM p""",
)
def _(v):
    prompts = grids.prompt_grid(v.clips.select("speaker_id").distinct())
    return grids.prompt_manifest(prompts)


@query(
    "tag_grid",
    with_(CLIPS)
    + f"""SELECT DISTINCT c.text AS carrier, t.tag, 'd0_'||t.tag||'_'||c.text AS clip_id
    FROM clips c, (VALUES {",".join(f"('{t}')" for t in ALL_TAGS)}) t(tag)""",
)
def _(v):
    return grids.tag_grid(v.clips.select(F.col("text").alias("carrier")).distinct())


@query(
    "test_retest_join",
    with_(CLIPS)
    + """, m AS (SELECT voice_id, speaker_id, text, avg(value) AS value FROM clips GROUP BY ALL)
    SELECT a.speaker_id, a.text, round(a.value, 6) AS value_a, round(b.value, 6) AS value_b
    FROM m a JOIN m b USING (speaker_id, text) WHERE a.voice_id='v0' AND b.voice_id='v1'""",
)
def _(v):
    means = v.clips.groupBy("voice_id", "speaker_id", "text").agg(F.avg("value").alias("value"))
    a, b = (means.where(F.col("voice_id") == x) for x in ("v0", "v1"))
    return tidy(joins.paired_takes(a, b, ["speaker_id", "text"], ["value"]))


@query(
    "model_pair_join",
    with_(CLIPS, PREDS)
    + """SELECT clip_id, a.sentiment AS sentiment_a, b.sentiment AS sentiment_b,
      round(a.confidence, 6) AS confidence_a, round(b.confidence, 6) AS confidence_b
    FROM preds a JOIN preds b USING (clip_id) WHERE a.solution='A' AND b.solution='B'""",
)
def _(v):
    p = v.predictions
    a, b = (p.where(F.col("solution") == x) for x in ("A", "B"))
    return tidy(joins.paired_takes(a, b, ["clip_id"], ["sentiment", "confidence"]))


@query(
    "delta_vs_baseline",
    with_(CLIPS, PREDS)
    + """, r AS (SELECT source, solution, prosody_sentiment,
        avg((sentiment=prosody_sentiment)::INT::DOUBLE) AS r FROM preds GROUP BY ALL),
    u AS (SELECT source, solution, avg(r) AS uar FROM r GROUP BY ALL)
    SELECT b.source, b.solution AS scheme, round(b.uar, 6) AS uar, round(a.uar, 6) AS raw_uar,
      round(b.uar - a.uar, 6) AS delta FROM u a JOIN u b USING (source)
    WHERE a.solution='A' AND b.solution='B'""",
)
def _(v):
    scores = metrics.summarise(joined(v), ["source", "solution"], ["uar"]).select(
        "source",
        F.when(F.col("solution") == "A", "raw").otherwise(F.col("solution")).alias("scheme"),
        "uar",
    )
    return tidy(joins.delta_vs_baseline(scores, ["source"]))


@query(
    "combo_eval_matrix",
    with_(CLIPS)
    + """, tr AS (SELECT DISTINCT source AS train_set, speaker_id FROM clips WHERE split='train'),
    ev AS (SELECT DISTINCT emotion_tag||'_'||split AS eval_set, speaker_id FROM clips)
    SELECT t.train_set, e.eval_set,
      (SELECT count(*) FROM tr JOIN ev USING (speaker_id) WHERE tr.train_set=t.train_set
        AND ev.eval_set=e.eval_set) AS n_shared,
      CASE WHEN (SELECT count(*) FROM tr JOIN ev USING (speaker_id) WHERE
        tr.train_set=t.train_set AND ev.eval_set=e.eval_set) > 0
        THEN 'speakers on both sides' END AS excluded_reason
    FROM (SELECT DISTINCT train_set FROM tr) t, (SELECT DISTINCT eval_set FROM ev) e""",
)
def _(v):
    train = v.clips.where("split = 'train'").withColumn("train_set", F.col("source"))
    evals = v.clips.withColumn("eval_set", F.concat_ws("_", "emotion_tag", "split"))
    return joins.evaluation_matrix(train, evals)


@query(
    "existing_clips_only",
    with_(CLIPS)
    + """SELECT source, count(*) AS n, count(*) FILTER (WHERE value >= 20) AS n_present,
      count(*) FILTER (WHERE value < 20) AS n_missing FROM clips GROUP BY source""",
)
def _(v):
    listing = v.clips.where("value >= 20").select("path")
    present = joins.existing_only(v.clips, listing).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_present")
    )
    total = v.clips.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return total.join(present, "source", "left").select(
        "source",
        "n",
        F.coalesce("n_present", F.lit(0)).alias("n_present"),
        (F.col("n") - F.coalesce("n_present", F.lit(0))).alias("n_missing"),
    )


@query(
    "leakage_gap",
    with_(CLIPS, PREDS)
    + """, r AS (SELECT solution, split, prosody_sentiment,
        avg((sentiment=prosody_sentiment)::INT::DOUBLE) AS r FROM preds GROUP BY ALL),
    u AS (SELECT solution, split, avg(r) AS uar FROM r GROUP BY ALL)
    SELECT a.solution, round(a.uar, 6) AS leaky_uar, round(b.uar, 6) AS disjoint_uar,
      round(a.uar - b.uar, 6) AS gap FROM u a JOIN u b USING (solution)
    WHERE a.split='train' AND b.split='test'""",
)
def _(v):
    rows = joined(v).withColumn("split_type", F.col("split"))
    scores = metrics.summarise(rows, ["solution", "split_type"], ["uar"])
    return tidy(joins.leakage_gap(scores, "train", "test"))
