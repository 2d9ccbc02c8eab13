"""Operator 7: exact duplicates through a minimal perfect hash over historical digests.

The distinct SHA-256 digests of the history are dealt by hash into buckets of bounded
size. Each bucket gets a minimal perfect hash: bit arrays, level by level, in which a
digest owns a bit that no other digest of its level hits; the rank of the bit is its
slot. Slots hold the whole digest, the winner's locator and the number of copies. A
lookup computes the slot and compares all 32 bytes, so a digest outside the history can
never pass for a member. Lookups meet their bucket in a sorted, streamed partition;
buckets with many lookups are split over salts, each with its own copy of the bucket.

Defined results: a null text equals an empty one; of equal texts the row with the largest
doc_id stays, null being the smallest; rows equal in text and doc_id are told apart by
their place in the table, so that exactly one stays; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemark.llm.common import among, doc_rows, staged

BUCKET_DIGESTS = 20_000
HOT_LOOKUPS = 100_000
GAMMA = 2.0
_INDEX = "bucket int, levels array<int>, bits binary, digests binary, winners array<long>, rows array<long>, sizes array<long>"
_FOUND = "doc_id long, row long, digest binary, winner long, winner_row long, size long"


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where digests, as four 64-bit words each, fall in the bit array of a level."""
    mixed = words[:, 0] ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    for k in range(1, 4):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + words[:, k]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def build(words: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and all their bits, for distinct digests."""
    sizes, bits = [], [np.zeros(0, bool)]
    rest = words
    while len(rest):
        size = max(64, int(GAMMA * len(rest)))
        at = _places(rest, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        rest = rest[~alone[at]]
    return sizes, np.concatenate(bits)


def slots(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each digest, -1 where no level has a bit for it."""
    ranks = np.cumsum(bits)
    found = np.full(len(words), -1)
    rest, base = np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = base + _places(words[rest], level, size)
        hit = bits[at]
        found[rest[hit]] = ranks[at[hit]] - 1
        rest, base = rest[~hit], base + size
    return found


def _words(digests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 32)
    return raw, np.ascontiguousarray(raw).view("<u8")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the digest of the whole text and the row's place, written once."""
    hashed = doc_rows(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    return staged(hashed.withColumn("row", F.monotonically_increasing_id()), "digests")


def build_index(history: DataFrame) -> DataFrame:
    """One row per bucket of the history's distinct digests. `history`: rows of `digests`."""
    distinct = staged(
        history.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row")).alias("winner"), F.count("*").alias("size")
        ),
        "distinct-digests",
    )
    buckets = -(-distinct.count() // BUCKET_DIGESTS) or 1

    def bucket_row(group: pa.Table) -> pa.Table:
        raw, words = _words(group.column("digest").combine_chunks())
        sizes, bits = build(words)
        order = np.argsort(slots(words, sizes, bits))
        taken = group.take(pa.array(order))
        columns = {
            "bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()),
            "levels": pa.array([sizes], pa.list_(pa.int32())),
            "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
            "digests": pa.array([raw[order].tobytes()], pa.binary()),
            "winners": pa.array([taken.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            "rows": pa.array([taken.column("row").to_pylist()], pa.list_(pa.int64())),
            "sizes": pa.array([taken.column("size").to_pylist()], pa.list_(pa.int64())),
        }
        return pa.table(columns)

    keyed = distinct.select(_bucket(buckets), "digest", "winner.doc_id", "winner.row", "size")
    built = staged(keyed.groupBy("bucket").applyInArrow(bucket_row, _INDEX), "digest-index")
    return built.withColumn("buckets", F.lit(buckets))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


def find(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of `digests` with winner, winner_row and size; these are null for nonmembers."""
    first = index.select("buckets").first()
    buckets = first.buckets if first else 1
    asked = rows.select("doc_id", "row", "digest", _bucket(buckets))
    # At most one entry per HOT_LOOKUPS rows, so small enough to send to every task.
    hot = (
        asked.groupBy("bucket")
        .count()
        .filter(F.col("count") > HOT_LOOKUPS)
        .select("bucket", F.ceil(F.col("count") / HOT_LOOKUPS).cast("int").alias("salts"))
    )
    asked = asked.join(F.broadcast(hot), "bucket", "left").withColumn(
        "salt", F.pmod(F.hash("row"), F.coalesce("salts", F.lit(1)))
    )
    copies = index.join(F.broadcast(hot), "bucket", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    )
    both = copies.select(
        "bucket", "salt", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("long").alias("row"), F.lit(None).cast("binary").alias("digest"),
        "levels", "bits", "digests", "winners", "rows", "sizes",
    ).unionByName(
        asked.select("bucket", "salt", F.lit(1).alias("kind"), "doc_id", "row", "digest"),
        allowMissingColumns=True,
    )
    dealt = both.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "kind")
    return dealt.mapInArrow(_looked_up, _FOUND)


def _looked_up(batches):
    bucket = None
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        edges = [*np.flatnonzero(np.diff(np.stack([batch.column(c).to_numpy() for c in ("bucket", "salt", "kind")])).any(axis=0)) + 1, len(kinds)]
        begin = 0
        for end in map(int, edges):
            part = batch.slice(begin, end - begin)
            if kinds[begin] == 0:
                row = part.slice(len(part) - 1).to_pylist()[0]
                sizes = row["levels"]
                bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
                known = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
                values = [pa.array(row[c], pa.int64()) for c in ("winners", "rows", "sizes")]
                bucket = part.column("bucket")[0].as_py()
            else:
                found = np.full(len(part), -1)
                if bucket == part.column("bucket")[0].as_py():
                    raw, words = _words(part.column("digest"))
                    found = slots(words, sizes, bits)
                    hit = np.flatnonzero(found >= 0)
                    found[hit[(known[found[hit]] != raw[hit]).any(axis=1)]] = -1
                    taken = pa.array(found, mask=found < 0)
                    extra = [v.take(taken) for v in values]
                else:
                    extra = [pa.nulls(len(part), pa.int64())] * 3
                yield pa.record_batch(
                    [*(part.column(c) for c in ("doc_id", "row", "digest")), *extra],
                    ["doc_id", "row", "digest", "winner", "winner_row", "size"],
                )
            begin = end


def dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per document: keep_id, group_size, kept and text_sha256.

    Without a history the table is its own: the index holds every digest, and its winners
    stay. With one, copies of historical texts go (keep_id is the historical winner and
    group_size counts the historical copies), and other texts are grouped among themselves.
    """
    rows = digests(docs)
    found = find(build_index(rows if history is None else digests(history)), rows)
    if history is not None:
        found = staged(found, "looked-up")
        rest = found.filter("winner_row is null").drop("winner", "winner_row", "size")
        groups = rest.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("size")
        )
        alone = rest.join(groups, "digest").select(
            "doc_id", "row", "digest", F.col("top.doc_id").alias("winner"), F.col("top.row").alias("winner_row"), "size"
        )
        gone = found.filter("winner_row is not null").withColumn("winner_row", F.lit(-1).cast("long"))
        found = gone.unionByName(alone)
    return found.select(
        "doc_id",
        F.col("winner").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("winner_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    stay = dedup(docs).filter("kept").select("doc_id", "text_sha256")
    matched, named = among(docs, stay, "left_semi", F.sha2(F.coalesce("text", F.lit("")), 256))
    # Rows equal in doc_id and text: one of them.
    return matched.dropDuplicates(["doc_id", named]).drop(named)
