"""Operator 2: bytes of repeated strings, by ranks of sampled suffixes.

Sampled strings and names of blocks take the place of prefix doubling.

A byte goes if it lies in a string of `LENGTH` bytes that also starts anywhere else.
Sorting all suffixes would move every byte many times, so suffixes are sampled first:
every window of `LENGTH` bytes is stood for by the leftmost of its `GRAM`-byte strings
with the smallest hash. Equal windows have equal samples at equal places, and consecutive
windows mostly share theirs: a run of windows, about 69 of them, has one sampled suffix.

Ranks start from the first GRAM bytes of the sampled suffix and are refined with names of
ever longer strings around it, until they are unique or reach LENGTH bytes:

1. Ranks of the first bytes; unique ones are done, no window of their run can repeat.
2. Names of whole runs (all bytes of their windows). If one repeats, all its windows do.
   A unique run may still share windows with runs of other ends under the same rank; one
   run of each name speaks for its copies from here on.
3. Runs are cut into blocks of 32, then 8, then single windows, by the place of the
   sample in the window. What all windows of a block have in common (169, 193, then 200
   bytes) is the next name: Spark ranks the pairs of old rank and name, and a unique pair
   ends its block. What the block's windows cover together decides the other way: if that
   repeats, the whole block does. Only blocks with an end of a match go to the next round.

Every round counts in map-side aggregates and joins the counts back, so a rank that a
third of all positions share is split over tasks. The text moves once: compressed, dealt by
document and cached, from where all rounds read it.

Ranks and names pair up to 128 bits: a name of 64 bits is only compared within a rank.

Defined results: null texts count as empty; matches never cross documents; texts of fewer
than LENGTH bytes lose nothing; rows equal in doc_id and text are copies of each other and
lose all that lies in strings of LENGTH bytes; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemark.llm import words
from tonemark.llm.common import KEY, dealt_texts, staged, texts_of

LENGTH = 200
GRAM = 64
BLOCKS = (32, 8, 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Grams:
    """Hashes of all GRAM-byte strings of a text."""

    def __init__(self, gram: int) -> None:
        self.gram = gram
        self.power = self.inverse = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n > len(self.power):
            size = max(n, 1 << 17)
            self.power, self.inverse = (np.full(size, b, np.uint64) for b in (_BASE, _INVERSE))
            for x in (self.power, self.inverse):
                x[0] = 1
                np.multiply.accumulate(x, out=x)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words._BYTE[data] * self.power[:n], out=sums[1:])
        return words.mixed((sums[self.gram :] - sums[: n + 1 - self.gram]) * self.inverse[: n + 1 - self.gram])


def samples(grams: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` hashes, the place of its leftmost smallest one."""
    n = len(grams)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, 0xFFFFFFFFFFFFFFFF, np.uint64)
    padded[:n] = keys
    square = padded.reshape(blocks, width)
    before = np.minimum.accumulate(square, axis=1).ravel()
    after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - width + 1
    return (np.minimum(after[:last], before[width - 1 : width - 1 + last]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


_RUNS = "d long, th long, i0 int, i1 int, m int, core long, e long"


def _runs(length: int, gram: int):
    """Runs of windows: first and last start, the sample's place, its rank and the run's name."""

    def run(batches):
        hashed = Grams(gram)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            keys = (batch.column(c).to_pylist() for c in KEY)
            for d, th, data in zip(*keys, texts_of(batch), strict=True):
                if len(data) < length:
                    continue
                grams = hashed(np.frombuffer(data, np.uint8))
                at = samples(grams, length - gram + 1)
                starts = np.flatnonzero(np.diff(at, prepend=-1))
                first, last = starts.tolist(), (np.append(starts[1:], len(at)) - 1).tolist()
                names = [xxhash.xxh3_64_intdigest(data[a : b + length]) for a, b in zip(first, last, strict=True)]
                own = ([d] * len(first), [th] * len(first), first, last, at[starts].tolist(),
                       grams[at[starts]].view(np.int64).tolist(), np.array(names, np.uint64).view(np.int64).tolist())
                for column, values in zip(out, own, strict=True):
                    column += values
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [*KEY, "i0", "i1", "m", "core", "e"]
            )

    return run


_BYTES = "d long, th long, m int, lo int, hi int, rank long, target boolean, data binary"


def _cut_out(length: int):
    """The bytes of every open run, with the places of the sample in its windows, lo to hi."""

    def run(batches):
        for batch in batches:
            for d, th, data, runs in zip(*(batch.column(c).to_pylist() for c in KEY), texts_of(batch), batch.column("open").to_pylist(), strict=True):
                rows = [
                    (d, th, r["m"], r["m"] - r["i1"], r["m"] - r["i0"], r["core"], r["target"], data[r["i0"] : r["i1"] + length])
                    for r in runs
                ]
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.bool_(), pa.binary()]
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    [*KEY, "m", "lo", "hi", "rank", "target", "data"],
                )

    return run


_NAMES = "cid long, rank long, b0 int, b1 int, target boolean, inner long, outer long"


def _named(length: int, gram: int, size: int):
    """For each open block, its sub-blocks of `size` windows with the names of what their
    windows have in common and of what they cover together (null if the run lacks a part)."""
    places = length - gram + 1

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                data, lo, hi = r["data"], r["lo"], r["hi"]
                for part in r["open"]:
                    first = max(part["b0"], lo) // size * size
                    for b0 in range(first, min(part["b1"], hi) + 1, size):
                        b1 = min(b0 + size, places) - 1
                        # The sample lies hi bytes into the data.
                        inner = xxhash.xxh3_64_intdigest(data[hi - b0 : hi - b1 + length])
                        whole = b0 >= lo and b1 <= hi
                        outer = xxhash.xxh3_64_intdigest(data[hi - b1 : hi - b0 + length]) if whole else None
                        rows.append((r["cid"], part["rank"], b0, b1, part["target"], inner, outer))
                if len(rows) >= 20_000:
                    yield _name_batch(rows)
                    rows = []
            if rows:
                yield _name_batch(rows)

    return run


def _name_batch(rows):
    cid, rank, b0, b1, target, inner, outer = zip(*rows, strict=True)
    signed = [np.array([x or 0 for x in names], np.uint64).view(np.int64) for names in (inner, outer)]
    return pa.record_batch(
        [
            pa.array(cid, pa.int64()), pa.array(rank, pa.int64()), pa.array(b0, pa.int32()), pa.array(b1, pa.int32()),
            pa.array(target, pa.bool_()), pa.array(signed[0]), pa.array(signed[1], mask=np.array([x is None for x in outer])),
        ],
        ["cid", "rank", "b0", "b1", "target", "inner", "outer"],
    )


def _refined(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks that repeat as a whole, and those that go on, under their new rank."""
    whole = ["rank", "b0", "outer"]
    repeated = names.filter("outer is not null").groupBy(*whole).count().filter("count > 1").drop("count")
    repeated = staged(repeated.withColumn("again", F.lit(True)), "repeated-blocks")
    marked = names.join(repeated, whole, "left")
    settled = marked.filter("target and again").select("cid", "b0", "b1")
    going = marked.withColumn("target", F.col("target") & F.col("again").isNull())
    pair = ["rank", "b0", "inner"]
    # A rank needs to order the pairs and tell them apart: ids that ascend over sorted
    # partitions do.
    ranks = (
        going.groupBy(*pair)
        .agg(F.count("*").alias("n"), F.max("target").alias("wanted"))
        .filter("n > 1 and wanted")
        .select(*pair)
        .repartitionByRange(*pair)
        .sortWithinPartitions(*pair)
        .withColumn("next", F.monotonically_increasing_id())
    )
    ranks = staged(ranks, "ranks")
    going = going.join(ranks, pair).select("cid", "b0", "b1", F.col("next").alias("rank"), "target")
    return settled, going


def _shared_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Round 1: runs whose sample starts with bytes that are not unique."""
    runs = texts.select(*KEY, "packed").mapInArrow(_runs(length, gram), _RUNS)
    cores = staged(runs.groupBy("core").count().filter("count > 1").select("core"), "cores")
    return staged(runs.join(cores, "core"), "shared-runs")


def repeated_windows(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(d, th, i0, i1): starts of strings of `length` bytes that start anywhere else too."""
    if not gram <= length:
        raise ValueError("a sampled string must fit into the length")
    shared = _shared_runs(texts, length, gram)
    named = ["core", "e"]
    classes = staged(
        shared.groupBy(*named).agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "i0", "i1", "m")).alias("one")), "run-names"
    )
    found = shared.join(classes.filter("n > 1").select(*named), named).select(*KEY, "i0", "i1")
    # Ranks under which a run is unique, but not the only one.
    contested = (
        classes.groupBy("core")
        .agg(F.count("*").alias("k"), F.min("n").alias("least"))
        .filter("k > 1 and least = 1")
        .select("core")
    )
    speakers = classes.join(staged(contested, "contested"), "core").select("one.*", "core", (F.col("n") == 1).alias("target"))
    open_runs = speakers.groupBy(*KEY).agg(F.collect_list(F.struct("i0", "i1", "m", "core", "target")).alias("open"))
    cut = texts.select(*KEY, "packed").join(open_runs, KEY).mapInArrow(_cut_out(length), _BYTES)
    # A document that is there twice has its runs twice, which changes no count of theirs:
    # targets are in one document only.
    runs = staged(cut.withColumn("cid", F.monotonically_increasing_id()), "run-bytes")
    going = runs.select("cid", F.lit(0).alias("b0"), F.lit(length).alias("b1"), "rank", "target")
    settled = []
    for size in BLOCKS:
        blocks = going.groupBy("cid").agg(F.collect_list(F.struct("b0", "b1", "rank", "target")).alias("open"))
        joined = runs.select("cid", "lo", "hi", "data").join(blocks, "cid")
        names = staged(joined.mapInArrow(_named(length, gram, size), _NAMES), "block-names")
        done, going = _refined(names)
        settled.append(done)
        if size > 1:
            going = staged(going, "open-blocks")
    for done in settled:
        placed = done.join(runs.select("cid", *KEY, "m"), "cid")
        found = found.unionByName(
            placed.select(*KEY, (F.col("m") - F.col("b1")).alias("i0"), (F.col("m") - F.col("b0")).alias("i1"))
        )
    return found


def cut(data: bytes, spans, length: int = LENGTH) -> tuple[int, int, int, str, bytes]:
    """Counts of bytes and runs, the digest of what stays, and what stays."""
    edge = np.zeros(len(data) + 1, np.int64)
    for span in spans or ():
        edge[span["i0"]] += 1
        edge[span["i1"] + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
    runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1))
    return len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def clean(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = True) -> DataFrame:
    """One row per document: counts, the SHA-256 of the bytes that stay, and those bytes."""
    texts = dealt_texts(docs)
    found = repeated_windows(texts, length, gram)
    spans = found.groupBy(*KEY).agg(F.collect_list(F.struct("i0", "i1")).alias("spans"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [cut(text, s.as_py(), length) for text, s in zip(texts_of(part), part.column("spans"), strict=True)]
                numbers = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)]
                kept = pa.array([o[4] if with_bytes else None for o in out], pa.binary())
                yield pa.record_batch(
                    [part.column("doc_id"), *numbers, pa.array([o[3] for o in out], pa.string()), kept],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    out = texts.join(spans, KEY, "left").select("doc_id", "packed", "spans").mapInArrow(run, _CUT)
    done = staged(out if with_bytes else out.drop("kept"), "cleaned")
    texts.unpersist()
    return done
