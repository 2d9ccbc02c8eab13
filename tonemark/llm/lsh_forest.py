"""Operator 8: documents whose sets of five-word shingles have a Jaccard of 0.8 or more.

Texts of the same words are one class; only classes are compared. Every class has a
MinHash signature, read as the labels of a forest of prefix tries: `TREES` trees, and
level d of a tree joins classes that agree on its first d values. The search begins at
the longest prefixes and shortens them, level by level, until the share of links it can
have missed is below 1 - `RECALL`, by the worst case of a pair right at the threshold and
by what the similarities of the links found so far imply. Candidates are verified on
their whole shingle sets.

Work on a bucket never gathers it whole: buckets are cut into blocks of about `BLOCK`
classes and blocks meet in pairs. A pair is taken up in the first tree and at the deepest
level where it meets, so links are counted once, and nothing lists the pairs: each block
gives its classes' link counts and a spanning forest of its links. Shingle sets travel
only to blocks in which a class has a partner that it has not met before.

Defined results: texts without words (null and empty ones too) are linked to none and are
their own class; a text of one to four words has one shingle; rows equal in doc_id and
text get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemark.llm import components, words
from tonemark.llm.common import among, staged

THRESHOLD = 0.8
TREES = 16
LEVELS = (5, 3)
RECALL = 0.9999
BLOCK = 256
_SIGNED = "doc_id long, text_hash long, n_words long, high long, low long, signature binary"
_SETS = "node long, shingles binary"


def chance(similarity, depth: int, trees: int = TREES):
    """That a pair of this similarity shares a prefix of this length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def _factors(n: int) -> np.ndarray:
    return words.mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


def signatures(shingles: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) minimum hashes; texts without shingles are all ones."""
    out = np.full((len(counts), n), 0xFFFFFFFF, np.uint32)
    has = np.flatnonzero(counts)
    if len(has):
        starts = (np.cumsum(counts) - counts)[has]
        for k, factor in enumerate(_factors(n)):
            out[has, k] = np.minimum.reduceat(((shingles * factor) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _slices(batches, size: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _sign(batches):
    split = words.Words()
    for part in _slices(batches):
        hashes, counts = split(part.column("text").to_pylist())
        grams, n = words.shingles(hashes, counts)
        signed = signatures(grams, n, TREES * max(LEVELS))
        # 128 bits over the sequence of words: what makes texts one class.
        ends = np.concatenate([[0], np.cumsum(counts)])
        keys = []
        for factor in (np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)):
            place = words.mixed((np.arange(len(hashes)) - np.repeat(ends[:-1], counts)).astype(np.uint64) * factor)
            sums = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(words.mixed(hashes ^ place), out=sums[1:])
            keys.append(words.mixed(sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
        yield pa.record_batch(
            [
                part.column("doc_id"),
                part.column("text_hash"),
                pa.array(counts),
                pa.array(keys[0]),
                pa.array(keys[1]),
                pa.array([row.tobytes() for row in signed], pa.binary()),
            ],
            ["doc_id", "text_hash", "n_words", "high", "low", "signature"],
        )


def _shingle_sets(batches):
    split = words.Words()
    for part in _slices(batches):
        hashes, counts = split(part.column("text").to_pylist())
        grams, n = words.shingles(hashes, counts)
        ends = np.cumsum(n)
        sets = [np.unique(grams[e - k : e]).tobytes() for e, k in zip(ends, n, strict=True)]
        yield pa.record_batch([part.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])


def prefix_keys(signature: np.ndarray, depth: int) -> np.ndarray:
    """(classes, trees) keys of the first `depth` values of every tree."""
    values = signature.reshape(len(signature), TREES, -1)[:, :, :depth].astype(np.uint64)
    key = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), values.shape[:2])
    for k in range(depth):
        key = words.mixed(key * np.uint64(0xD6E8FEB86659FD93) + values[:, :, k] + np.uint64(1))
    return key


def _new_partners(keys: np.ndarray, older: list[np.ndarray], tree: int, row: int, others: np.ndarray) -> np.ndarray:
    """Of `others`, those which class `row` meets here for the first time."""
    new = np.ones(len(others), bool)
    for k in older:
        new &= ~(k[others] == k[row]).any(axis=1)
    if tree:
        new &= ~(keys[others, :tree] == keys[row, :tree]).any(axis=1)
    return others[new]


def _unpacked(table: pa.Table):
    node = table.column("node").to_numpy()
    _, first = np.unique(node, return_index=True)
    if len(first) < len(node):  # rows equal in doc_id and text
        table = table.take(pa.array(first))
    raw = b"".join(table.column("signature").to_pylist())
    return table, np.frombuffer(raw, np.uint32).reshape(table.num_rows, -1)


def _meetings(table: pa.Table, level: int):
    """(row, its new partners) of the block pair: within one block, or across two."""
    table, signature = _unpacked(table)
    tree = table.column("tree")[0].as_py()
    keys, older = prefix_keys(signature, LEVELS[level]), [prefix_keys(signature, d) for d in LEVELS[:level]]
    own = table.column("own").to_numpy()
    across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    rows = np.arange(table.num_rows)
    found = []
    for row in rows if not across else rows[own == own.min()]:
        others = rows[own != own.min()] if across else rows[row + 1 :]
        found.append((row, _new_partners(keys, older, tree, row, others)))
    return table, found


def _block_rows(nodes: DataFrame, level: int) -> DataFrame:
    """One row per class and block pair of every bucket with two classes or more."""

    def keyed(batches):
        for batch in batches:
            signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32)
            keys = prefix_keys(signature.reshape(batch.num_rows, -1), LEVELS[level])
            yield pa.record_batch(
                [
                    pa.array(np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows)),
                    pa.array(keys.ravel().view(np.int64)),
                    pa.array(np.repeat(batch.column("node").to_numpy(), TREES)),
                ],
                ["tree", "prefix", "node"],
            )

    leaves = nodes.select("node", "signature").mapInArrow(keyed, "tree int, prefix long, node long")
    sizes = leaves.groupBy("tree", "prefix").count().filter("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    shared = leaves.join(sizes, ["tree", "prefix"]).select(
        "tree", "prefix", "node", blocks.alias("blocks"), F.pmod(F.hash("node"), blocks).alias("own")
    )
    placed = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "tree", "prefix", "node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    return placed.join(nodes.select("node", "signature"), "node")


def _links(nodes: DataFrame, docs: DataFrame, level: int) -> DataFrame:
    """(u, v, links, inverse): link counts as (u, null) and forest edges as (u, v).

    inverse sums 1 / chance of each link at this level, for the estimate of the recall.
    """

    def wanted(table: pa.Table) -> pa.Table:
        table, found = _meetings(table, level)
        need = np.zeros(table.num_rows, bool)
        for row, partners in found:
            need[row] |= len(partners) > 0
            need[partners] = True
        return table.filter(pa.array(need))

    where = "tree int, prefix long, node long, own int, i int, j int, signature binary"
    pairs = _block_rows(nodes, level).select("tree", "prefix", "node", "own", "i", "j", "signature")
    needed = staged(pairs.groupBy("tree", "prefix", "i", "j").applyInArrow(wanted, where), "meetings")
    asked = needed.select("node").distinct().join(nodes.select("node", "rep"), "node")
    texts = _keyed(docs).join(
        asked.select("node", F.col("rep.doc_id").alias("_id"), F.col("rep.text_hash").alias("_hash")),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")),
    )
    sets = texts.select("node", "text").mapInArrow(_shingle_sets, _SETS)

    def verified(table: pa.Table) -> pa.Table:
        table, found = _meetings(table, level)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        starts = np.cumsum(sizes) - sizes
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        seen = np.zeros(int(ids.max()) + 1, bool)
        node = table.column("node").to_numpy()
        links, inverse = np.zeros(len(node), np.int64), np.zeros(len(node))
        root = np.arange(len(node))

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        edges = []
        for row, partners in found:
            low, high = np.minimum(sizes[partners], sizes[row]), np.maximum(sizes[partners], sizes[row])
            partners = partners[low >= THRESHOLD * high]
            if not len(partners):
                continue
            own = ids[starts[row] : starts[row] + sizes[row]]
            seen[own] = True
            common = np.array([np.count_nonzero(seen[ids[starts[p] : starts[p] + sizes[p]]]) for p in partners])
            seen[own] = False
            union = sizes[row] + sizes[partners] - common
            # In integers, so that a pair right at the threshold counts.
            linked = 10 * common >= round(10 * THRESHOLD) * union
            similarity = common[linked] / union[linked]
            partners = partners[linked]
            weight = 1 / chance(similarity, LEVELS[level])
            links[row] += len(partners)
            inverse[row] += weight.sum()
            links[partners] += 1
            inverse[partners] += weight
            for p in partners:
                a, b = top(row), top(p)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    edges.append((node[row], node[p]))
        has = np.flatnonzero(links)
        return pa.table(
            {
                "u": pa.array([*node[has], *(e[0] for e in edges)], pa.int64()),
                "v": pa.array([*[None] * len(has), *(e[1] for e in edges)], pa.int64()),
                "links": pa.array([*links[has], *[0] * len(edges)], pa.int64()),
                "inverse": pa.array([*inverse[has], *[0.0] * len(edges)], pa.float64()),
            }
        )

    full = needed.join(sets, "node")
    found = full.groupBy("tree", "prefix", "i", "j").applyInArrow(verified, "u long, v long, links long, inverse double")
    return staged(found, "links")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def join(docs: DataFrame) -> DataFrame:
    """One row per document: copy_of, class_id and n_links.

    copy_of is the smallest doc_id with the same words, class_id the smallest doc_id that
    links reach, n_links the number of other texts, copies counted once, at 0.8 or more.
    """
    signed = staged(_keyed(docs).mapInArrow(_sign, _SIGNED), "signatures")
    nodes = staged(
        signed.filter("n_words > 0")
        .groupBy("high", "low")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.any_value("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    found, links, inverse = [], 0, 0.0
    for level, depth in enumerate(LEVELS):
        found.append(_links(nodes, docs, level))
        n, w = found[-1].agg(F.coalesce(F.sum("links"), F.lit(0)), F.coalesce(F.sum("inverse"), F.lit(0.0))).first()
        links, inverse = links + n, inverse + w
        if chance(THRESHOLD, depth) >= RECALL and (not inverse or links / inverse >= RECALL):
            break
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    for more in found[2:]:
        every = every.unionByName(more)
    counts = every.filter("v is null").groupBy("u").agg(F.sum("links").alias("n_links"))
    roots = components.components(every.filter("v is not null").select("u", "v"))
    named = nodes.select("node", "high", "low", "rep").join(roots.withColumnRenamed("u", "node"), "node", "left")
    classed = named.withColumn("root", F.coalesce("root", "node"))
    least = classed.groupBy("root").agg(F.min("rep.doc_id").alias("class_id"))
    of_words = (
        classed.join(least, "root")
        .join(counts.withColumnRenamed("u", "node"), "node", "left")
        .select("high", "low", F.col("rep.doc_id").alias("copy_of"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    out = signed.drop("signature").join(of_words, ["high", "low"], "left")
    bare = F.col("n_words") == 0
    return out.select(
        "doc_id",
        "text_hash",
        F.when(bare, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.when(bare, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(bare, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        "n_words",
    )


def keep(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id; all its columns.

    Texts without words all stay. Of rows equal in doc_id and text, one stays.
    """
    stay = join(docs).filter("n_words = 0 or doc_id <=> class_id").select("doc_id", "text_hash")
    matched, named = among(docs, stay, "left_semi", F.xxhash64(F.coalesce("text", F.lit(""))))
    return matched.dropDuplicates(["doc_id", named]).drop(named)
