"""The manifest table: typed scan, validation rules, validated sink, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemark.functions.labels import congruent
from tonemark.operators.scale import one_row
from tonemark.schema import LABELS, MANIFEST, MANIFEST_COLUMNS, SOURCES, ManifestError

OPTIONAL_TEXT = ["voice_id", "emotion_tag", "split"]


def scan(spark: SparkSession, path: str, *, validate: bool = False) -> DataFrame:
    """CSV manifest with declared types; NULL in the optional columns becomes ''."""
    df = (
        spark.read.schema(MANIFEST)
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
        .na.fill("", OPTIONAL_TEXT)
    )
    if validate:
        validate_manifest(df)
    return df


def sink(df: DataFrame, path: str, *, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Validate, then write in the declared column order."""
    validate_manifest(df)
    ordered = df.select(*MANIFEST_COLUMNS)
    if fmt == "csv":
        ordered.write.mode(mode).option("header", True).csv(path)
    else:
        ordered.write.mode(mode).partitionBy("split").format(fmt).save(path)


def add_congruence(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "is_congruent", congruent(F.col("text_sentiment"), F.col("prosody_sentiment"))
    )


def column_report(df: DataFrame) -> DataFrame:
    """Per declared column: is it there, and how many of its values are NULL."""
    have = set(df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in MANIFEST_COLUMNS if c in have],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(c in have).alias("present"),
            (F.col(c) if c in have else F.col("_rows")).alias("n_null"),
        )
        for c in MANIFEST_COLUMNS
    ]
    return counts.select(F.inline(F.array(*entries)))


def duplicates(df: DataFrame, key: str = "clip_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def outside_domain(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Distinct values outside the domain; NULL counts as outside."""
    c = F.col(column)
    return (
        df.where(c.isNull() | ~c.isin(*domain))
        .groupBy(c.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def incongruence_errors(df: DataFrame) -> Column:
    same = F.col("text_sentiment").eqNullSafe(F.col("prosody_sentiment"))
    return F.count_if(~F.col("is_congruent").eqNullSafe(same))


def missing_files(df: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows whose path is not among the listed files."""
    return df.join(listing.select("path").distinct(), "path", "left_anti")


def list_files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """Paths below `root`, relative to it; file contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(root)
    )
    base = root.rstrip("/") + "/"
    relative = F.regexp_replace("path", "^.*?" + base.replace("file:", ""), "")
    return files.select(relative.alias("path"), "length")


def violations(df: DataFrame) -> DataFrame:
    """One row per rule with its violation count: two passes over the table."""
    bad_label = {
        c: F.count_if(F.col(c).isNull() | ~F.col(c).isin(*LABELS))
        for c in ("text_sentiment", "prosody_sentiment")
    }
    row_rules = df.agg(
        F.count_if(blank(F.col("speaker_id"))).alias("blank speaker_id"),
        bad_label["text_sentiment"].alias("text_sentiment outside domain"),
        bad_label["prosody_sentiment"].alias("prosody_sentiment outside domain"),
        F.count_if(F.col("source").isNull() | ~F.col("source").isin(*SOURCES)).alias(
            "source outside domain"
        ),
        incongruence_errors(df).alias("is_congruent inconsistent"),
    )
    repeated = one_row(duplicates(df).agg(F.count(F.lit(1)).alias("n"))).getField("n")
    report = row_rules.withColumn("duplicate clip_id", repeated)
    entries = [
        F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n_violations"))
        for c in report.columns
    ]
    return report.select(F.inline(F.array(*entries)))


def validate_manifest(df: DataFrame, listing: DataFrame | None = None) -> None:
    missing = sorted(set(MANIFEST_COLUMNS) - set(df.columns))
    if missing:
        raise ManifestError(f"missing columns: {missing}")
    broken = {r["rule"]: r["n_violations"] for r in violations(df).collect() if r["n_violations"]}
    if "duplicate clip_id" in broken:
        broken["examples"] = [r[0] for r in duplicates(df).limit(5).collect()]
    if listing is not None:
        absent = [r["path"] for r in missing_files(df, listing).limit(3).collect()]
        if absent:
            broken["missing files"] = absent
    if broken:
        raise ManifestError(f"invalid manifest: {broken}")


def summary(df: DataFrame) -> DataFrame:
    # Sources come from a closed domain, so the set stays tiny.
    return df.agg(
        F.count(F.lit(1)).alias("n_clips"),
        F.count_distinct("speaker_id").alias("n_speakers"),
        F.count_if(~F.col("is_congruent")).alias("n_incongruent"),
        F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"),
    )
