"""Seeded samples, skewed draws and training-set assembly."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonemark import fixed_values as fixed
from tonemark.functions.hashing import HASH_SPACE, stable_hash
from tonemark.functions.labels import pick
from tonemark.operators.scale import beside, lookup_join, one_row, take_by_hash
from tonemark.schema import LABELS
from tonemark.sources.storage import new_path

# Rows of a group whose hashes one task of the cut finder looks at.
SLICE_ROWS = 100_000
# Half the width, in standard deviations, of the part of the hash space that must hold a cut.
CUT_WIDTH = 8.0


def stratified_subset(
    df: DataFrame, n: int = 300, *, seed: int = 0, by: str = "prosody_sentiment"
) -> DataFrame:
    """About n rows, each class in proportion and at least one row of each."""
    total = one_row(df.agg(F.count(F.lit(1)).alias("n"))).getField("n")
    rows = df.withColumn("_h", stable_hash(str(seed), F.col("clip_id")))
    # The scalar is attached before the grouping so the quota sees a column.
    rows = rows.withColumn("_total", total)
    kept = take_by_hash(
        rows,
        [by, "_total"],
        "_h",
        lambda size: F.greatest(F.bround(size * F.lit(float(n)) / F.col("_total")), F.lit(1.0)),
    )
    return kept.drop("_h", "_total", "group_n", "quota_n")


def sample_per_group(df: DataFrame, groups: Sequence[str], k: int, *, seed: int = 0) -> DataFrame:
    """k rows of every group (all of them where there are fewer)."""
    rows = df.withColumn("_h", stable_hash(str(seed), F.col("clip_id")))
    return take_by_hash(rows, groups, "_h", lambda _: F.lit(k)).drop("_h", "group_n", "quota_n")


def sample_with_fill(
    df: DataFrame, groups: Sequence[str], stratum: str, k: int, *, seed: int = 0
) -> DataFrame:
    """One row per stratum of each group, then the group filled up to k rows.

    The fill can only come from the first k rows of each stratum, so the final
    ranking sees at most k rows per stratum.
    """
    rows = df.withColumn("_h", stable_hash(str(seed), F.col("clip_id")))
    pool = take_by_hash(rows, [*groups, stratum], "_h", lambda _: F.lit(k))
    first = F.row_number().over(
        Window.partitionBy(*groups, stratum).orderBy("_h", "clip_id")
    )
    order = Window.partitionBy(*groups).orderBy(F.col("_first") > 1, "_h", "clip_id")
    return (
        pool.withColumn("_first", first)
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= k)
        .withColumn("picked_as", F.when(F.col("_first") == 1, "stratum").otherwise("fill"))
        .drop("_h", "_first", "_rank", "group_n", "quota_n")
    )


@dataclass(frozen=True)
class Draw:
    """One class-imbalanced draw; `slots` are its places among the draws that thin a class."""

    level: str
    majority: str
    seed: int
    keep: float
    slots: tuple[int | None, ...]

    @property
    def prefix(self) -> str:
        return f"{self.level}|{self.majority}|{self.seed}"


def draw_list(
    keep: Mapping[str, float] = fixed.SKEW_KEEP,
    majorities: Sequence[str] = LABELS,
    seeds: int = 20,
) -> list[Draw]:
    """Every level with every majority and seed. A draw keeps its majority whole."""
    out, used = [], dict.fromkeys(LABELS, 0)
    for level, share in keep.items():
        for majority in majorities:
            for seed in range(seeds):
                slots = []
                for label in LABELS:
                    thinned = share < 1 and label != majority
                    slots.append(used[label] if thinned else None)
                    used[label] += thinned
                out.append(Draw(level, majority, seed, float(share), tuple(slots)))
    return out


def partitions(spark: SparkSession) -> int:
    """Tasks of work that grows by the number of draws: by bytes, Spark would plan too few."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _hashes(prefix: str, ids: Sequence[str | None]) -> np.ndarray:
    """`stable_hash` of the prefix and each id."""
    begun, begun_alone = hashlib.md5(f"{prefix}|".encode()), hashlib.md5(prefix.encode()).digest()
    out = []
    for x in ids:
        if x is None:
            out.append(begun_alone[:8])
        else:
            h = begun.copy()
            h.update(x.encode())
            out.append(h.digest()[:8])
    return np.frombuffer(b"".join(out), ">u8").astype(np.uint64) >> np.uint64(4)


def _by_id(x: str | None) -> tuple[bool, str]:
    return x is not None, x or ""


def slices_of(slice_rows: int | None = None) -> Column:
    """Slices of a group of `group_n` rows."""
    return F.greatest(F.ceil(F.col("group_n") / F.lit(slice_rows or SLICE_ROWS)), F.lit(1)).cast("int")


_TALLY = pa.list_(
    pa.struct(
        [
            ("slot", pa.int32()),
            ("need", pa.int64()),
            ("below", pa.int64()),
            ("near", pa.list_(pa.struct([("h", pa.int64()), ("id", pa.string())]))),
        ]
    )
)


def _tallies(ids: list[str | None], n: int, alone: bool, plan: Sequence[tuple[int, str, int]], width: float) -> list[dict]:
    """What one slice of a group knows of each draw's cut.

    `near` are its (hash, id) in the part of the hash space that must hold the cut of the whole
    group, `below` counts the rows under it. A slice that is the whole group has the cut.
    """
    out = []
    for slot, prefix, need in plan:
        h = _hashes(prefix, ids)
        if alone:
            at = need - 1
            value = np.partition(h, at)[at]
            below = int((h < value).sum())
            same = sorted((ids[k] for k in np.flatnonzero(h == value)), key=_by_id)
            near = [(int(value), same[at - below])]
            below = at
        else:
            share = need / n
            slack = width * (share * (1 - share) / n) ** 0.5 + 2 / n
            low, high = (int(min(max(x, 0.0), 1.0) * HASH_SPACE) for x in (share - slack, share + slack))
            below = int((h < low).sum())
            near = [(int(h[k]), ids[k]) for k in np.flatnonzero((h >= low) & (h <= high))]
        out.append({"slot": slot, "need": need, "below": below, "near": [{"h": a, "id": b} for a, b in near]})
    return out


def cut_finder(
    rows: DataFrame,
    groups: Sequence[str],
    label: str,
    draws: Sequence[Draw],
    *,
    minimum: int,
    slice_rows: int | None = None,
    width: float = CUT_WIDTH,
) -> DataFrame:
    """Per group (the last key is its class): `group_n` and `cuts`, the last (hash, id) of each thinning draw.

    Groups are dealt to tasks in slices of about `slice_rows` ids; ids move once and are hashed
    there for all draws, so nothing is multiplied by the draws before a shuffle. A large
    group's slices send counts and the few hashes around the wanted rank, which uniform hashes
    bound; a cut that they should miss is looked for again in a wider part. One row a draw and
    slice is merged.
    """
    groups = list(groups)
    spark = rows.sparkSession
    # One row a group, stored: it is joined to tables made from the same rows.
    sizes_path = new_path(spark, "sizes")
    rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("group_n")).write.parquet(sizes_path)
    sizes = spark.read.parquet(sizes_path)
    sized = lookup_join(rows.select(*groups, "clip_id"), sizes, groups, count_col="group_n", spread_by="clip_id")
    slices = slices_of(slice_rows)
    sliced = sized.withColumns({"_slices": slices, "_slice": F.pmod(F.xxhash64("clip_id"), slices)})

    def find(some: DataFrame, width: float) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            head = table.slice(0, 1)
            n, alone = head.column("group_n")[0].as_py(), head.column("_slices")[0].as_py() == 1
            at = LABELS.index(head.column(label)[0].as_py())
            plan = [
                (d.slots[at], d.prefix, min(n, max(minimum, round(d.keep * n)))) for d in draws if d.slots[at] is not None
            ]
            tallies = _tallies(table.column("clip_id").to_pylist(), n, alone, plan, width)
            return pa.table([*(head.column(c) for c in (*groups, "group_n")), pa.array([tallies], _TALLY)], [*groups, "group_n", "t"])

        kinds = {f.name: f.dataType.simpleString() for f in some.schema.fields}
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in groups)
        dealt = some.repartition(partitions(spark), *groups, "_slice")
        tallies = dealt.groupBy(*groups, "_slice").applyInArrow(
            run,
            f"{schema}, group_n bigint, t array<struct<slot: int, need: bigint, below: bigint, near: array<struct<h: bigint, id: string>>>>",
        )
        merged = (
            tallies.select(*groups, "group_n", F.inline("t"))
            .groupBy(*groups, "slot")
            .agg(
                F.max("group_n").alias("group_n"),
                (F.max("need") - F.sum("below")).cast("int").alias("at"),
                F.sort_array(F.flatten(F.collect_list("near"))).alias("near"),
            )
        )
        inside = F.col("at").between(1, F.size("near"))
        path = new_path(spark, "cuts")
        merged.select(*groups, "slot", "group_n", F.when(inside, F.get("near", F.col("at") - 1)).alias("cut")).write.parquet(path)
        return spark.read.parquet(path)

    found, left = [], sliced
    while True:
        cuts = find(left, width)
        missed = cuts.where("cut is null").select(*groups).distinct()
        if missed.isEmpty():
            break
        found.append(beside(cuts, missed.withColumn("_missed", F.lit(True)), groups).where("_missed is null").drop("_missed"))
        left = beside(sliced, missed.withColumn("_missed", F.lit(True)), groups, "inner").drop("_missed")
        width *= 8
    whole = reduce(DataFrame.unionByName, [*found, cuts])
    ordered = F.sort_array(F.collect_list(F.struct("slot", "cut")))
    cut_lists = whole.groupBy(*groups).agg(F.transform(ordered, lambda x: x["cut"]).alias("cuts"))
    # A class that no draw thins has no cuts, but rows.
    return beside(sizes, cut_lists, groups)


def _kept_whole(ids: list[str | None], at: int, draws: Sequence[Draw], minimum: int) -> np.ndarray:
    """Rows by draws, true where the draw keeps the row; `ids` are a whole group of class `at`."""
    n = len(ids)
    kept = np.ones((n, len(draws)), bool)
    by_need: dict[int, list[int]] = {}
    for k, d in enumerate(draws):
        if d.slots[at] is not None:
            by_need.setdefault(min(n, max(minimum, round(d.keep * n))), []).append(k)
    for need, places in by_need.items():
        h = np.stack([_hashes(draws[k].prefix, ids) for k in places])
        last = np.partition(h, need - 1, axis=1)[:, need - 1 : need]
        inside = h <= last
        for i in np.flatnonzero(inside.sum(axis=1) > need):
            # Equal hashes at the cut: the smaller ids, equal ids together.
            same = np.flatnonzero(h[i] == last[i])
            cut = sorted((_by_id(ids[k]) for k in same))[need - 1 - int((h[i] < last[i]).sum())]
            inside[i, same] = [_by_id(ids[k]) <= cut for k in same]
        kept[:, places] = inside.T
    return kept


def _kept_by_cuts(ids: list[str | None], at: int, draws: Sequence[Draw], cuts: Sequence[dict]) -> np.ndarray:
    """The same of a slice of a group, whose cuts are known."""
    kept = np.ones((len(ids), len(draws)), bool)
    for k, d in enumerate(draws):
        if d.slots[at] is not None:
            h, last = _hashes(d.prefix, ids), cuts[d.slots[at]]
            kept[:, k] = h <= last["h"]
            for i in np.flatnonzero(h == last["h"]):
                kept[i, k] = _by_id(ids[i]) <= _by_id(last["id"])
    return kept


def _drawn(
    df: DataFrame,
    draws: Sequence[Draw],
    emit: Callable[[pa.Table, np.ndarray], pa.Table],
    schema: str,
    *,
    minimum: int,
    label: str,
    slice_rows: int | None,
) -> tuple[DataFrame, DataFrame | None]:
    """What `emit` makes of the rows of a group and their places in the draws.

    A group of at most `slice_rows` rows is drawn whole in one task, its ids hashed once. The
    slices of larger groups, the second table, meet the cuts that `cut_finder` found.
    """
    groups, spark = ["speaker_id", label], df.sparkSession
    columns, known = df.columns, df.where(F.col(label).isin(*LABELS))
    path = new_path(spark, "large")
    sizes = known.groupBy(*groups).agg(F.count(F.lit(1)).alias("group_n"))
    # At most rows / slice_rows groups.
    sizes.where(F.col("group_n") > (slice_rows or SLICE_ROWS)).select(*groups, F.lit(True).alias("_large")).write.parquet(path)
    large = spark.read.schema(f"speaker_id {dict(df.dtypes)['speaker_id']}, `{label}` string, _large boolean").parquet(path)
    several = not large.isEmpty()
    marked = beside(known, F.broadcast(large), groups) if several else known

    def whole(rows: pa.Table) -> pa.Table:
        at, ids = LABELS.index(rows.column(label)[0].as_py()), rows.column("clip_id").cast(pa.string()).to_pylist()
        return emit(rows.select(columns), _kept_whole(ids, at, draws, minimum))

    small = marked.where("_large is null").drop("_large") if several else known
    out = small.repartition(partitions(spark), *groups).groupBy(*groups).applyInArrow(whole, schema)
    if not several:
        return out, None
    hot = marked.where("_large").drop("_large")
    cuts = cut_finder(hot, groups, label, draws, minimum=minimum, slice_rows=slice_rows)
    sized = lookup_join(hot, cuts.select(*groups, "group_n"), groups, count_col="group_n", spread_by="clip_id")
    slices = slices_of(slice_rows)
    dealt = sized.select(*columns, F.pmod(F.xxhash64("clip_id"), slices).cast("int").alias("_slice"))
    beside_slices = cuts.select(*groups, "cuts", F.explode(F.sequence(F.lit(0), slices - 1)).alias("_slice"))

    def pick(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return emit(rows.select(columns), np.ones((0, len(draws)), bool))
        at, ids = LABELS.index(rows.column(label)[0].as_py()), rows.column("clip_id").cast(pa.string()).to_pylist()
        return emit(rows.select(columns), _kept_by_cuts(ids, at, draws, found.column("cuts")[0].as_py()))

    spread = dealt.repartition(partitions(spark), *groups, "_slice")
    keys = [*groups, "_slice"]
    return out, spread.groupBy(*keys).cogroup(beside_slices.groupBy(*keys)).applyInArrow(pick, schema)


def draw_places(
    df: DataFrame,
    draws: Sequence[Draw],
    *,
    minimum: int = 2,
    label: str = "prosody_sentiment",
    slice_rows: int | None = None,
) -> DataFrame:
    """Rows of known classes with `_draws`, the places of their draws in the list of draws.

    The majority class keeps every row, another class the max(minimum, round(keep*n)) rows of
    the smallest hashes. Rows move once, with their group or a slice of it, and leave the task
    with the list of their draws. Rows of no known class are in no draw; rows of equal id go
    together.
    """

    def listed(rows: pa.Table, kept: np.ndarray) -> pa.Table:
        offsets = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(kept)[1].astype(np.int32)))
        return rows.append_column("_draws", places)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    whole, sliced = _drawn(df, draws, listed, f"{schema}, _draws array<int>", minimum=minimum, label=label, slice_rows=slice_rows)
    return whole if sliced is None else whole.unionByName(sliced)


def draw_totals(
    df: DataFrame,
    draws: Sequence[Draw],
    values: Sequence[str],
    *,
    minimum: int = 2,
    label: str = "prosody_sentiment",
    slice_rows: int | None = None,
) -> DataFrame:
    """Per draw (level, majority, seed), speaker and class: its rows n and sums of integer columns.

    Totals leave the task instead of copies. Only those of a large group's slices are added up.
    """
    keys = ["speaker_id", label]

    def added(rows: pa.Table, kept: np.ndarray) -> pa.Table:
        n = kept.sum(axis=0)
        at = np.flatnonzero(n)
        heads = pa.array(np.zeros(len(at), np.int64))
        columns = [rows.column(c).take(heads) for c in keys]
        columns += [pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))]
        for c in values:
            there = rows.column(c).is_valid().to_numpy().astype(np.int64)
            held = rows.column(c).fill_null(0).to_numpy().astype(np.int64)
            columns.append(pa.array(held @ kept[:, at], pa.int64(), mask=there @ kept[:, at] == 0))
        return pa.table(columns, [*keys, "d", "n", *values])

    schema = f"speaker_id {dict(df.dtypes)['speaker_id']}, `{label}` string, d int, n bigint"
    schema += "".join(f", `{c}` bigint" for c in values)
    whole, sliced = _drawn(
        df.select("clip_id", *keys, *values), draws, added, schema, minimum=minimum, label=label, slice_rows=slice_rows
    )
    if sliced is not None:
        merged = sliced.groupBy(*keys, "d").agg(*[F.sum(c).alias(c) for c in ("n", *values)])
        whole = whole.unionByName(merged)
    named = whole.withColumn("_d", named_draw(draws, F.col("d")))
    return named.select("_d.level", "_d.majority", "_d.seed", *keys, "n", *values)


def draw_sizes(
    df: DataFrame,
    *,
    keep: Mapping[str, float] = fixed.SKEW_KEEP,
    minimum: int = 2,
    label: str = "prosody_sentiment",
) -> DataFrame:
    """Per level, majority, speaker and class: its rows n in every draw, whatever the seed.

    A draw keeps a number of rows that the size of the group alone decides, so none is made.
    """
    sizes = df.where(F.col(label).isin(*LABELS)).groupBy("speaker_id", label).agg(F.count(F.lit(1)).alias("_n"))
    kinds = [F.struct(F.lit(k).alias("level"), F.lit(float(s)).alias("share"), F.lit(m).alias("majority")) for k, s in keep.items() for m in LABELS]
    each = sizes.withColumn("_k", F.explode(F.array(*kinds))).select("*", "_k.*")
    quota = F.greatest(F.bround(F.col("share") * F.col("_n")).cast("bigint"), F.lit(minimum).cast("bigint"))
    thinned = (F.col("share") < 1) & (F.col(label) != F.col("majority"))
    n = F.when(thinned, F.least(F.col("_n"), quota)).otherwise(F.col("_n"))
    return each.select("level", "majority", "speaker_id", label, n.alias("n"))


def named_draw(draws: Sequence[Draw], place: Column) -> Column:
    """Level, majority and seed of the draw at a place of the list."""
    # One literal; thousands of columns would take longer to plan than to run.
    named = json.dumps([{"level": d.level, "majority": d.majority, "seed": d.seed} for d in draws])
    listed = F.from_json(F.lit(named), "array<struct<level: string, majority: string, seed: bigint>>")
    return F.get(listed, place)


def draw_copies(placed: DataFrame, draws: Sequence[Draw]) -> DataFrame:
    """One copy of a placed row per draw."""
    columns = [c for c in placed.columns if c != "_draws"]
    copies = placed.select(*columns, F.explode("_draws").alias("_at")).withColumn("_d", named_draw(draws, F.col("_at")))
    return copies.select(*columns, "_d.level", "_d.majority", "_d.seed")


def skewed_draws(
    df: DataFrame,
    *,
    keep: Mapping[str, float] = fixed.SKEW_KEEP,
    seeds: int = 20,
    minimum: int = 2,
    label: str = "prosody_sentiment",
    slice_rows: int | None = None,
) -> DataFrame:
    """Class-imbalanced draws within each speaker, one copy of a row per draw (`draw_places`)."""
    draws = draw_list(keep, LABELS, seeds)
    return draw_copies(draw_places(df, draws, minimum=minimum, label=label, slice_rows=slice_rows), draws)


def augment_draw(index: DataFrame, *, seed: int = 0, i: str = "i") -> DataFrame:
    """One congruent training row per index and sentiment with a drawn tag, text and voice."""
    tags = {
        label: sorted(set(fixed.EMOTION_TAGS["cartesia"][label]) - set(fixed.AMBIGUOUS_TAGS))
        for label in LABELS
    }
    rows = index.select(
        F.col(i).alias("i"), F.explode(F.array(*[F.lit(x) for x in LABELS])).alias("sentiment")
    )

    def drawn(kind: str):
        return stable_hash(str(seed), kind, F.col("sentiment"), F.col("i").cast("string"))

    def choose(kind: str, lists: Mapping[str, Sequence[str]]):
        return F.coalesce(
            *[
                F.when(
                    F.col("sentiment") == label,
                    pick(lists[label], drawn(kind) % len(lists[label])),
                )
                for label in LABELS
            ]
        )

    tag = choose("tag", tags)
    text = choose("text", fixed.CARRIERS)
    voice = pick(fixed.SYNTHETIC_VOICES, drawn("voice") % len(fixed.SYNTHETIC_VOICES))
    chosen = rows.select(
        "i", "sentiment", tag.alias("tag"), text.alias("text"), voice.alias("voice")
    )
    return chosen.select(
        F.concat_ws(
            "_", F.lit("e4"), "sentiment", F.col("i").cast("string"), "tag", "voice"
        ).alias("clip_id"),
        F.concat(F.lit("cartesia_"), "voice").alias("speaker_id"),
        F.lit("synthetic").alias("source"),
        "text",
        F.col("sentiment").alias("text_sentiment"),
        F.col("sentiment").alias("prosody_sentiment"),
        F.col("tag").alias("emotion_tag"),
        F.lit(True).alias("is_congruent"),
        F.lit("train").alias("split"),
    )


def combo_train_set(base: DataFrame, extras: Sequence[DataFrame]) -> DataFrame:
    """Base rows as they are, every extra row forced into the training split."""
    out = base
    for extra in extras:
        out = out.unionByName(extra.withColumn("split", F.lit("train")))
    return out


def dedupe(df: DataFrame, key: str, priority: Sequence[str]) -> DataFrame:
    """One row per key, the first by `priority`.

    An aggregate rather than a window: it combines map-side, so many copies of
    one key never meet in a task.
    """
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*priority)).alias("_r")
    return df.groupBy(key).agg(best).select(key, "_r.*")
