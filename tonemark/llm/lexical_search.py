"""Operator 13: the best documents of each benchmark item by dense matrix products.

1. Items are read in order and gathered in blocks of at most `MOST_ITEMS` whose distinct terms
   number at most `MOST_TERMS`; an item of more terms is a block of its own. A block's terms
   are its compact vocabulary, which every task gets.
2. One scan counts, over all documents, how many hold each of those terms, and once also the
   documents with a term and all terms. Tasks send one row a term.
3. A second scan lays tiles of `TILE_DOCUMENTS` documents out as dense matrices of impacts,
   `TILE_TERMS` terms at a time, and multiplies them by the items' weights in float64. An
   impact is below 10**6 and a weight below 44,362 for any 64-bit count, so a tile's partial
   sums stay below 2**53 and are exact; tiles are added as 64-bit integers.
4. Each task keeps, tile by tile, the `TOP` best of each item: those above the tile's cut and,
   of equal scores at the cut, the smallest doc_ids. Lists are merged in two steps, `MERGED`
   groups of lists first.

Defined results: a null text has no term, a null doc_id comes after all others of equal
score; repeated rows count and rank as documents of their own; each benchmark row is an item
of its own, and one without a term that any document holds has no rows; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 50
MOST_TERMS = 1 << 14
MOST_ITEMS = 1024
TILE_TERMS = 4096
TILE_DOCUMENTS = 512
TILE_ITEMS = 256
MERGED = 256
# Bytes between terms become spaces, A-Z are lower-cased; bytes of other letters stay.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_LAST = (1 << 63) - 1


def terms(text: str | None) -> list[bytes]:
    """The text's terms in UTF-8, in order."""
    return [] if text is None else text.encode("utf-8", "replace").translate(_PLAIN).split()


def weight(n_documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * holding + 1)))


def blocks(items: DataFrame, most_terms: int) -> Iterator[list[tuple[int | None, frozenset[bytes]]]]:
    """Blocks of (item_id, its distinct terms), read one partition at a time."""
    ordered = items.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text")
    block, words = [], set()
    for row in ordered.toLocalIterator():
        mine = frozenset(terms(row["text"]))
        if block and (len(block) == MOST_ITEMS or len(words | mine) > most_terms):
            yield block
            block, words = [], set()
        if mine:
            block.append((row["item_id"], mine))
            words |= mine
    if block:
        yield block


def _counts(docs: DataFrame, places: dict[bytes, int]) -> dict[int, int]:
    """Documents that hold each term; -1 documents with a term, -2 all terms."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                mine = terms(text)
                if mine:
                    held[-1] += 1
                    held[-2] += len(mine)
                    held.update([places[t] for t in places.keys() & set(mine)])
        yield pa.record_batch([pa.array(held.keys(), pa.int32()), pa.array(held.values(), pa.int64())], ["place", "n"])

    parts = docs.select("text").mapInArrow(run, "place int, n long")
    return {r["place"]: r["n"] for r in parts.groupBy("place").agg(F.sum("n").alias("n")).collect()}


class _Best:
    """The `top` best (score, id) of every item so far."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.lists = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * items
        # Scores below are of no use any more; only those above 0 count.
        self.cuts = np.ones(items, np.int64)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (items from `first`, documents) of one tile."""
        # A score equal to the cut may still win by its id.
        near = scores >= self.cuts[first : first + len(scores), None]
        for k in np.flatnonzero(near.any(axis=1)):
            old_scores, old_ids = self.lists[first + k]
            all_scores = np.concatenate([old_scores, scores[k, near[k]]])
            all_ids = np.concatenate([old_ids, ids[near[k]]])
            order = np.lexsort((all_ids, -all_scores))[: self.top]
            self.lists[first + k] = all_scores[order], all_ids[order]
            if len(order) == self.top:
                self.cuts[first + k] = all_scores[order[-1]]


def _ranked(docs: DataFrame, block, places, weights: np.ndarray, n_documents: int, n_terms: int, top: int) -> DataFrame:
    """item, doc_id and score: the best of each partition's documents."""
    # (item, term) places of the weights, tile by tile.
    pairs = [(k, places[t]) for k, (_, mine) in enumerate(block) for t in mine]
    item_of, term_of = (np.array(x, np.int64) for x in zip(*pairs, strict=True))

    def run(batches):
        best = _Best(len(block), top)
        tiles = []
        for first in range(0, len(block), TILE_ITEMS):
            inside = (item_of >= first) & (item_of < first + TILE_ITEMS)
            used = np.unique(term_of[inside])
            for at in range(0, len(used), TILE_TERMS):
                some = used[at : at + TILE_TERMS]
                taken = inside & np.isin(term_of, some)
                matrix = np.zeros((min(TILE_ITEMS, len(block) - first), len(some)))
                columns = np.searchsorted(some, term_of[taken])
                matrix[item_of[taken] - first, columns] = weights[term_of[taken]]
                tiles.append((first, some, matrix))

        def scored(row, place, impact, ids):
            sums: dict[int, np.ndarray] = {}
            for first, some, matrix in tiles:
                column = np.minimum(np.searchsorted(some, place), len(some) - 1)
                here = some[column] == place
                dense = np.zeros((len(ids), len(some)))
                dense[row[here], column[here]] = impact[here]
                product = (matrix @ dense.T).astype(np.int64)
                sums[first] = sums[first] + product if first in sums else product
            for first, scores in sums.items():
                best.add(first, scores, ids)

        for batch in batches:
            for at in range(0, batch.num_rows, TILE_DOCUMENTS):
                part = batch.slice(at, TILE_DOCUMENTS)
                row, place, tf, long = [], [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    mine = terms(text)
                    counted = Counter(mine)
                    shared = places.keys() & counted.keys()
                    row += [k] * len(shared)
                    place += [places[t] for t in shared]
                    tf += [counted[t] for t in shared]
                    long += [50 + 50 * len(mine) * n_documents // n_terms] * len(shared)
                if row:
                    tf, long = np.array(tf, np.int64), np.array(long, np.int64)
                    impact = 1_000_000_000 * tf // (1000 * tf + 20 * long)
                    scored(np.array(row), np.array(place), impact, part.column("doc_id").fill_null(_LAST).to_numpy())
        for k, (scores, ids) in enumerate(best.lists):
            if len(ids):
                yield pa.record_batch(
                    [
                        pa.array([k] * len(ids), pa.int32()),
                        pa.array([block[k][0]] * len(ids), pa.int64()),
                        pa.array(ids, pa.int64(), mask=ids == _LAST),
                        pa.array(scores, pa.int64()),
                    ],
                    ["item", "item_id", "doc_id", "score"],
                )

    lists = docs.mapInArrow(run, "item int, item_id long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    lists = lists.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    some = lists.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most_terms: int = MOST_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` best documents of each item."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for block in blocks(items, most_terms):
        places = {t: k for k, t in enumerate(sorted(set().union(*(mine for _, mine in block))))}
        held = _counts(docs, places)
        n_documents, n_terms = held.get(-1, 0), held.get(-2, 0)
        if n_documents:
            weights = np.array([weight(n_documents, held.get(k, 0)) for k in range(len(places))], float)
            parts.append(_ranked(docs, block, places, weights, n_documents, n_terms, top))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)
