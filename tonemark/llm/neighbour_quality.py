"""Operator 5: quality by the votes of labelled neighbours in a latent space.

A text is described by what its characters look like: runs of lower-case letters become
one symbol, other characters a class symbol or themselves, and all runs of `GRAM`
symbols are counted in `TERMS` hashed places, beside shares of repeated words and lines.
Weights are inverse document frequencies over the whole table. A truncated SVD of a
bounded sample of labelled rows (`SAMPLE`, the fit's only bound) gives the latent space;
the sample's vectors are sent to every task, cosine products with all of them are
computed in blocks for every document, and the `NEIGHBOURS` nearest vote with their
similarity to the power `SHARPNESS`. The vote is blended with the sample's share of good
rows so that a text near nothing gets that share.

Only the text is an input of a score. Defined results: null and empty texts have no terms
and get the share of good rows among the labelled sample (0.5 without labels); rows with
a null quality are not learned from; repeated label rows count as often as they occur; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark.llm import words
from tonemark.llm.common import fresh

SAMPLE = 4000
TERMS = 4096
GRAM = 4
SHARES = 24
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 8.0
PRIOR = 0.05

_SYMBOL = np.arange(256, dtype=np.uint8)
_SYMBOL[97:123] = 97
_SYMBOL[65:91] = 65
_SYMBOL[48:58] = 48
_SYMBOL[128:] = 97
_FEATURES = "doc_id long, quality int, places binary, counts binary"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _shares(text: str) -> list[float]:
    """Shares of words that repeat the one before, of repeated words and of repeated lines."""
    parts = text.split()
    lines = text.split("\n")
    n = max(1, len(parts))
    again = sum(map(str.__eq__, parts, parts[1:])) / n
    repeated = 1 - len(set(parts)) / n if parts else 0.0
    same = 1 - len(set(lines)) / len(lines)
    return [again, repeated * min(1.0, 100 / n), same]


def features(texts: list[str]) -> np.ndarray:
    """(texts, TERMS + SHARES) counts over whole texts; the rows of empty texts are zero."""
    out = np.zeros((len(texts), TERMS + SHARES), np.float32)
    for row, text in enumerate(texts):
        if not text:
            continue
        data = np.frombuffer(re.sub("[ß-öø-ÿ]", "a", re.sub("[À-ÖØ-Þ]", "A", text)).encode("utf-8", "replace"), np.uint8)
        symbols = _SYMBOL[data]
        run = (symbols[1:] == symbols[:-1]) & ((symbols[1:] == 97) | (symbols[1:] == 65))
        symbols = np.append(symbols[:1], symbols[1:][~run]).astype(np.uint64)
        padded = np.concatenate([symbols, np.full(GRAM - 1, 10, np.uint64)])
        code = np.zeros(len(symbols), np.uint64)
        for k in range(GRAM):
            code = code * np.uint64(257) + padded[k : k + len(symbols)]
        places = (words.mixed(code) % np.uint64(TERMS)).astype(np.int64)
        out[row, :TERMS] = np.bincount(places, minlength=TERMS)
        for k, share in enumerate(_shares(text)):
            # One place for each eighth of a share, so that shares are terms like others.
            out[row, TERMS + 8 * k + min(7, int(share * 8))] = 1
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts)  # float32 throughout
    x[:, :TERMS] /= np.maximum(np.linalg.norm(x[:, :TERMS], axis=1, keepdims=True), 1e-9)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x


def _slices(batches, size: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have each term, over the whole table."""

    def counted(batches):
        total, n = np.zeros(TERMS + SHARES, np.int64), 0
        for part in _slices(batches):
            found = features(part.column("text").to_pylist())
            total += (found > 0).sum(axis=0)
            n += len(found)
        yield pa.record_batch([pa.array([*range(TERMS + SHARES), -1]), pa.array([*total, n])], ["place", "df"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(counted, "place long, df long")
    held = dict(rows.groupBy("place").agg(F.sum("df").alias("df")).collect())  # one row per term
    return np.array([held.get(k, 0) for k in range(TERMS + SHARES)]), held.get(-1, 0)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and labels of at most `sample` labelled rows, by the hash of their id."""
    learned = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("_id"), "_id", "quality")
        .limit(sample)
    )
    # The label rows are at most `sample`; their texts are looked up in one scan.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.join(F.broadcast(learned), F.col("doc_id") == F.col("_id"))

    def sparse(batches):
        for part in _slices(batches):
            found = features(part.column("text").to_pylist())
            places = [np.flatnonzero(x) for x in found]
            yield pa.record_batch(
                [
                    part.column("doc_id"),
                    part.column("quality"),
                    pa.array([p.astype(np.int32).tobytes() for p in places], pa.binary()),
                    pa.array([x[p].tobytes() for x, p in zip(found, places, strict=True)], pa.binary()),
                ],
                ["doc_id", "quality", "places", "counts"],
            )

    # Repeated rows of a document could exceed the bound again.
    held = texts.select("doc_id", "text", "quality").mapInArrow(sparse, _FEATURES).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    counts = np.zeros((len(held), TERMS + SHARES), np.float32)
    for row, one in enumerate(held):
        counts[row, np.frombuffer(one["places"], np.int32)] = np.frombuffer(one["counts"], np.float32)
    return counts, np.array([one["quality"] for one in held], np.float32)


def directions(x: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of the sample, by a seeded randomised SVD."""
    if not len(x):
        return np.zeros((x.shape[1], 0), np.float32)
    wide = min(rank + 16, *x.shape)
    basis = np.random.default_rng(5).normal(size=(x.shape[1], wide)).astype(np.float32)
    for _ in range(3):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, values, rotation = np.linalg.svd(x @ basis, full_matrices=False)
    kept = values[:rank] > 1e-3
    return (basis @ rotation[:rank][kept].T).astype(np.float32)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return scored(docs.select("doc_id", "text"), docs, labels, sample).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def scored(rows: DataFrame, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, name: str = "_score") -> DataFrame:
    """`rows` with a column of scores called `name`; `docs` gives the statistics and the labelled texts."""
    df, n_docs = document_frequencies(docs)
    idf = (np.log((1 + n_docs) / (1 + df)) + 0.2).astype(np.float32)
    counts, quality = labelled_sample(docs, labels, sample)
    share = float((quality > 0).mean()) if len(quality) else 0.5
    x = _weighted(counts, idf)
    basis = directions(x, RANK)
    known = x @ basis
    known /= np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-9)
    good = (quality > 0).astype(np.float32)

    def votes(texts: list[str]) -> np.ndarray:
        if not len(known):
            return np.full(len(texts), share)
        latent = _weighted(features(texts), idf) @ basis
        length = np.linalg.norm(latent, axis=1, keepdims=True)
        cosine = (latent / np.maximum(length, 1e-9)) @ known.T
        k = min(NEIGHBOURS, len(known))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** SHARPNESS
        total = (weight * good[near]).sum(axis=1) + PRIOR * share
        return np.where(length[:, 0] > 1e-9, total / (weight.sum(axis=1) + PRIOR), share)

    @F.pandas_udf("double")
    def judged(texts):
        import pandas as pd

        held = texts.tolist()
        parts = [votes([t or "" for t in held[at : at + 256]]) for at in range(0, len(held), 256)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0)).clip(0.0, 1.0)

    return rows.withColumn(name, judged(F.coalesce("text", F.lit(""))))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of 0.5 or more, with all their columns."""
    (name,) = fresh(docs, "_score")
    return scored(docs, docs, labels, name=name).filter(F.col(name) >= 0.5).drop(name)
