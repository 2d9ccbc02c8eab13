"""Operator 9: language by error-correcting output codes.

Every language gets a codeword; one binary classifier per bit says on which side of that
bit's split of the languages a text lies. Up to seven languages use all splits, more use
random codewords of `CODE_BITS` bits per doubling, the widest apart of several draws.
Classifiers are logistic regressions on hashed byte n-grams of the lower-cased text,
fitted on at most about `PER_LANGUAGE` documents of each language. Decoding adds up each
bit's logistic loss against a codeword, weighted by the bit's accuracy on a part of the
sample that its fit has not seen, and takes the smallest sum; `ambiguous` marks texts
whose two best codewords lie within `MARGIN`.

Only the text is an input. Defined results: `und` with score 0 for null texts, texts
without a letter, and where no language could be learned; one learned language is always
predicted; rows with a null lang are not learned from; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark.llm import words

PER_LANGUAGE = 600
MOST_ROWS = 6000
TERMS = 4096
GRAMS = (1, 2, 3, 4)
CODE_BITS = 10
ROUNDS = 150
MARGIN = 0.1
_OUT = "lang_pred string, score double, ambiguous boolean"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def features(texts: list[str]) -> np.ndarray:
    """(texts, TERMS) unit rows of square-rooted n-gram counts over whole texts."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in enumerate(texts):
        data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint64)
        code = np.zeros(len(data), np.uint64)
        for k in range(max(GRAMS)):
            if len(data) <= k:
                break
            code = code[: len(data) - k] * np.uint64(257) + data[k:] + np.uint64(1)
            if k + 1 in GRAMS:
                places = (words.mixed(code) % np.uint64(TERMS)).astype(np.int64)
                out[row] += np.bincount(places, minlength=TERMS)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def codewords(languages: int) -> np.ndarray:
    """(languages, bits) of -1 and 1."""
    if languages <= 7:
        n = max(1, 2 ** (languages - 1) - 1)
        # The first language is always 1: a split and its opposite are one bit.
        rest = (np.arange(n)[None, :] >> np.arange(max(1, languages) - 1)[:, None]) & 1
        return np.vstack([np.ones((1, n), int), 2 * rest - 1])[:languages]
    rng = np.random.default_rng(7)
    bits = int(np.ceil(CODE_BITS * np.log2(languages)))
    drawn = [rng.choice([-1, 1], (languages, bits)) for _ in range(20)]
    return max(drawn, key=lambda c: np.min(bits - np.abs(c @ c.T) + 2 * bits * np.eye(languages)))


def fit_bits(x: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """(terms + 1, bits) weights of regularised logistic regressions, one per column."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros((x.shape[1], sides.shape[1]), np.float32)
    ahead, step, penalty = w.copy(), 4.0 * 0.9, 1e-5
    for k in range(ROUNDS):
        gradient = -x.T @ (sides / (1 + np.exp(sides * (x @ ahead)))) / len(x) + penalty * ahead
        new = ahead - 2 * step * gradient
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, list[str]]:
    """Features and languages of a sample by hash, the same number of rows of each language, all of a small one."""
    known = docs.select("text", F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    # The sample has no room for more languages than rows, which bounds what is broadcast.
    sizes = F.broadcast(known.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(MOST_ROWS))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # The rank within the language, so that the limit below takes the same number of each.
    place = place * F.col("rows")
    drawn = known.join(sizes, "lang").filter(place < per_language)

    def described(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = features(part.column("text").to_pylist())
                places = [np.flatnonzero(x).astype(np.int32) for x in found]
                yield pa.record_batch(
                    [
                        part.column("place"),
                        part.column("lang"),
                        pa.array([p.tobytes() for p in places], pa.binary()),
                        pa.array([x[p].tobytes() for x, p in zip(found, places, strict=True)], pa.binary()),
                    ],
                    ["place", "lang", "places", "terms"],
                )

    rows = drawn.select(place.alias("place"), "lang", "text").mapInArrow(described, "place double, lang string, places binary, terms binary")
    held = rows.orderBy("place", "lang").limit(MOST_ROWS).collect()
    x = np.zeros((len(held), TERMS), np.float32)
    for row, r in zip(x, held, strict=True):
        row[np.frombuffer(r["places"], np.int32)] = np.frombuffer(r["terms"], np.float32)
    return x, [r["lang"] for r in held]


def predict(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every document."""
    x, langs = sample(docs, per_language)
    names = sorted(set(langs))
    codes = codewords(len(names)).astype(np.float32)
    weights = bits = None
    if len(names) > 1:
        sides = codes[[names.index(lang) for lang in langs]]
        checked = np.arange(len(x)) % 5 == 0
        trial = fit_bits(x[~checked], sides[~checked])
        margins = np.hstack([x[checked], np.ones((checked.sum(), 1), np.float32)]) @ trial
        accuracy = np.maximum((margins * sides[checked] > 0).mean(axis=0), 0.05)
        bits = accuracy / accuracy.sum()
        weights = fit_bits(x, sides)

    def decoded(texts: list[str]):
        kinds = np.full(len(texts), "und", object)
        scores, unsure = np.zeros(len(texts)), np.zeros(len(texts), bool)
        has = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        if not names or not has:
            return kinds, scores, unsure
        if weights is None:
            kinds[has], scores[has] = names[0], 1.0
            return kinds, scores, unsure
        x = features([texts[i] for i in has])
        margins = x @ weights[:-1] + weights[-1]
        losses = np.stack([(np.logaddexp(0, -margins * code) * bits).sum(axis=1) for code in codes], axis=1)
        order = np.argsort(losses, axis=1, kind="stable")
        best, second = np.take_along_axis(losses, order[:, :2], axis=1).T
        share = np.exp(-losses)
        kinds[has] = np.array(names, object)[order[:, 0]]
        scores[has] = np.exp(-best) / share.sum(axis=1)
        unsure[has] = second - best < MARGIN
        return kinds, scores, unsure

    @F.pandas_udf(_OUT)
    def judged(texts):
        import pandas as pd

        held = texts.tolist()
        parts = [decoded(held[at : at + 256]) for at in range(0, len(held), 256)] or [decoded([])]
        return pd.DataFrame({c: np.concatenate([p[k] for p in parts]) for k, c in enumerate(("lang_pred", "score", "ambiguous"))})

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        judged("text").alias("judged"),
    ).select("doc_id", "held_out", "judged.*")
