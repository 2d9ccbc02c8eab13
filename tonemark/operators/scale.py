"""Building blocks that keep every task bounded when one group holds most rows.

Three shapes recur in this package and all of them break on a hot group when
written the obvious way: joining per-group figures back to rows, ranking inside
a group, and exact percentiles. The versions here pre-aggregate, spread hot
groups over several tasks, and stay exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemark.functions.hashing import HASH_SPACE
from tonemark.sources.storage import new_path

# A key whose rows take more than this is spread over several join tasks.
HOT_BYTES = 1 << 30
# Rows ranked by one task.
RANK_ROWS = 500_000


def one_row(stats: DataFrame) -> Column:
    """A one-row aggregate as a struct column (scalar subquery, no join)."""
    return stats.select(F.struct(*stats.columns).alias("s")).scalar()


def beside(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join on keys where NULL equals NULL; the keys are the left table's."""
    keys = list(keys)
    renamed = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    on = reduce(lambda a, b: a & b, same) if same else F.lit(True)
    return left.join(renamed, on, how).drop(*[f"_of_{k}" for k in keys])


def lookup_join(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    *,
    count_col: str,
    spread_by: str,
    how: str = "inner",
    row_bytes: int = 100,
    hot_rows: int | None = None,
) -> DataFrame:
    """Join per-key figures (one row per key, with its row count) back to rows.

    A NULL key is a key like others. Keys of more than `hot_rows` rows (HOT_BYTES of
    rows of `row_bytes`) are replicated once per salt and their rows are scattered
    over the salts by `spread_by`, so no join task holds a hot key. At most
    total rows / hot_rows keys can qualify, which bounds the broadcast.
    """
    hot_rows = hot_rows or max(1, HOT_BYTES // row_bytes)
    keys = list(keys)
    salts = F.ceil(F.col(count_col) / F.lit(hot_rows)).cast("int")
    hot = stats.where(F.col(count_col) > hot_rows).select(*keys, salts.alias("_salts"))
    salted_rows = beside(rows, F.broadcast(hot), keys).withColumn(
        "_salt",
        F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_salts")), F.lit(0)).cast("int"),
    )
    salted_stats = stats.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts - 1, F.lit(0))))
    )
    return beside(salted_rows.drop("_salts"), salted_stats, [*keys, "_salt"], how).drop("_salt")


def hash_bucket(hash_col: str, n: Column, rank_rows: int) -> Column:
    """Slice of the hash space; a group of n rows gets about n / rank_rows slices."""
    slices = F.greatest(F.ceil(n / F.lit(rank_rows)), F.lit(1)).cast("bigint")
    slot = F.floor(F.col(hash_col) / F.lit(HASH_SPACE) * slices)
    return F.least(slot, slices - 1).cast("bigint")


def take_by_hash(
    rows: DataFrame,
    groups: Sequence[str],
    hash_col: str,
    quota: Callable[[Column], Column],
    *,
    tie: str = "clip_id",
    rank_rows: int | None = None,
    sized: bool = False,
) -> DataFrame:
    """Per group, keep the rows with the smallest hashes.

    `quota` maps the group's size to the number of rows kept; sizes are counted
    unless the rows carry them already (`sized`, column `group_n`). Every group is
    cut into slices of the hash space: slices below the cut-off are kept without
    ranking and only the cut-off slice is ranked, so the work per task does not
    grow with the group. Adds `group_n` and `quota_n`.
    """
    rank_rows = rank_rows or RANK_ROWS
    groups = list(groups)
    if not sized:
        sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("group_n"))
        rows = lookup_join(rows, sizes, groups, count_col="group_n", spread_by=hash_col)
    wanted = F.least(quota(F.col("group_n")), F.col("group_n")).cast("bigint")
    sliced = rows.withColumn("_slice", hash_bucket(hash_col, F.col("group_n"), rank_rows))
    filled = (
        sliced.groupBy(*groups, "_slice")
        .agg(F.count(F.lit(1)).alias("_in_slice"), F.max("group_n").alias("group_n"))
        .withColumn(
            "_upto",
            F.sum("_in_slice").over(
                Window.partitionBy(*groups).orderBy("_slice").rowsBetween(
                    Window.unboundedPreceding, 0
                )
            ),
        )
    )
    cut = filled.withColumn("quota_n", wanted).where(F.col("_upto") >= F.col("quota_n")).groupBy(*groups).agg(
        F.min("_slice").alias("_cut"),
        F.min_by(F.col("quota_n") - F.col("_upto") + F.col("_in_slice"), "_slice").alias("_need"),
        F.max("quota_n").alias("quota_n"),
        F.max("group_n").alias("_n"),
    )
    kept = lookup_join(sliced, cut, groups, count_col="_n", spread_by=hash_col).where(
        F.col("_slice") <= F.col("_cut")
    )
    within = Window.partitionBy(*groups, "_slice").orderBy(hash_col, tie)
    return (
        kept.withColumn("_rank", F.row_number().over(within))
        .where((F.col("_slice") < F.col("_cut")) | (F.col("_rank") <= F.col("_need")))
        .drop("_slice", "_cut", "_need", "_n", "_rank")
    )


def hash_cuts(
    rows: DataFrame,
    hash_col: str,
    tie: str,
    ranks: Sequence[Column],
    *,
    rank_rows: int | None = None,
) -> list[Column]:
    """For each rank k, the k-th smallest (hash, tie) of the table as a struct column.

    Only the slices of the hash space that hold a rank are sorted; rows are then
    compared with the results instead of being ranked.
    """
    rank_rows = rank_rows or RANK_ROWS
    total = one_row(rows.agg(F.count(F.lit(1)).alias("n"))).getField("n")
    sliced = rows.select(hash_col, tie, hash_bucket(hash_col, total, rank_rows).alias("_slice"))
    tally = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_c"))
    # One row per slice.
    running = tally.withColumn(
        "_upto",
        F.sum("_c").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)),
    )
    wanted = [f"_k{i}" for i in range(len(ranks))]
    spot = running.withColumns(dict(zip(wanted, ranks, strict=True))).agg(
        *[F.min(F.when(F.col("_upto") >= F.col(k), F.col("_slice"))).alias(f"s{k}") for k in wanted],
        *[
            F.min_by(F.col(k) - F.col("_upto") + F.col("_c"), F.when(F.col("_upto") >= F.col(k), F.col("_slice"))).alias(f"n{k}")
            for k in wanted
        ],
    )
    at = one_row(spot)
    inside = sliced.where(F.col("_slice").isin(*[at.getField(f"s{k}") for k in wanted]))
    ranked = inside.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_slice").orderBy(hash_col, tie))
    )
    hits = [
        (F.col("_slice") == at.getField(f"s{k}")) & (F.col("_rank") == at.getField(f"n{k}"))
        for k in wanted
    ]
    found = ranked.agg(
        *[F.min(F.when(hit, F.struct(hash_col, tie))).alias(k) for hit, k in zip(hits, wanted, strict=True)]
    )
    cuts = one_row(found)
    return [cuts.getField(k) for k in wanted]


def global_hash_order(rows: DataFrame, hash_col: str, *, tie: str) -> DataFrame:
    """Position (1-based) of every row in hash order over the whole table.

    Adds `position` and `total`.
    """
    total = one_row(rows.agg(F.count(F.lit(1)).alias("n"))).getField("n")
    return global_order(rows.withColumn("total", total), [F.col(hash_col), F.col(tie)])


def global_desc_order(rows: DataFrame, value: str, *, tie: str) -> DataFrame:
    """Position of every row in descending order of `value`, ties by `tie`, NULL last."""
    return global_order(rows, [F.desc_nulls_last(value), F.col(tie)])


def global_order(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds `position` (1-based): rows are dealt by range, sorted there and written once.

    The order ends in a tie column, so a heavy tie is cut like any other range. An id
    given after the sort holds the partition and the place in it; places are shifted by
    the rows of earlier partitions, a running sum over one row per partition. That is small
    but derived from the table, so its join would shuffle every read without the hint.
    """
    spark = rows.sparkSession
    path = new_path(spark, "ordered")
    placed = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed.write.parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)
    part = F.shiftright("_at", 33)
    offsets = (
        stored.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(
                    Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("position", (place + F.col("_before") + 1).cast("bigint"))
        .drop("_part", "_at", "_before")
    )


def exact_percentiles(
    rows: DataFrame,
    groups: Sequence[str],
    value: str,
    levels: dict[str, float],
) -> DataFrame:
    """Exact interpolated percentiles per group, one column per level.

    A mergeable sketch brackets each wanted rank first; values below a bracket are
    only counted, and only the values inside it are ordered. The sketch is off by at
    most 1/accuracy of the group, so a bracket a few times wider holds the rank once
    the group has `small` rows; smaller groups are ordered whole. Rows are counted
    per group and value before anything is joined, so a heavy value is one row.
    """
    accuracy, slack, small = 100_000, 4e-5, 200_000
    groups = list(groups)
    present = rows.where(F.col(value).isNotNull()).select(*groups, value)
    counted = present.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_rows"))
    probes = []
    for q in levels.values():
        probes += [max(q - slack, 0.0), min(q + slack, 1.0)]
    brackets = present.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx(value, probes, accuracy).alias("_b"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
    )
    if groups:
        joined = lookup_join(counted, brackets, groups, count_col="_n", spread_by=value)
    else:
        s = one_row(brackets)
        joined = counted.select(
            value, "_rows", *[s.getField(c).alias(c) for c in ("_n", "_b", "_min", "_max")]
        )
    # A value outside every bracket is folded onto the nearest bracket end below
    # it, which keeps all running counts inside the brackets right.
    v = F.col(value)
    inside, floor_ends = F.col("_n") <= small, []
    for i, q in enumerate(levels.values()):
        lo = F.col("_min") if q <= slack else F.col("_b")[2 * i]
        hi = F.col("_max") if q >= 1 - slack else F.col("_b")[2 * i + 1]
        inside = inside | v.between(lo, hi)
        floor_ends.append(F.when(hi < v, hi))
    below = F.greatest(*floor_ends) if len(floor_ends) > 1 else floor_ends[0]
    tallies = (
        joined.select(*groups, "_n", "_rows", F.when(inside, v).otherwise(below).alias("_v"))
        .groupBy(*groups, "_v")
        .agg(F.sum("_rows").alias("_c"), F.max("_n").alias("_n"))
    )
    running = F.sum("_c").over(
        Window.partitionBy(*groups)
        .orderBy(F.asc_nulls_first("_v"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = tallies.select(*groups, "_v", "_n", running.alias("_upto"))
    columns = []
    for name, q in levels.items():
        spot = F.lit(float(q)) * (F.col("_n") - 1)
        lower = F.min(F.when(F.col("_upto") > F.floor(spot), F.col("_v")))
        upper = F.min(F.when(F.col("_upto") > F.ceil(spot), F.col("_v")))
        frac = F.max(spot - F.floor(spot))
        columns.append((lower + (upper - lower) * frac).alias(name))
    return ranked.groupBy(*groups).agg(*columns)
