"""Operator 3: repeated runs of sentences, removed everywhere but at their first place.

Words are what white space of ASCII separates. A text is cut after words that end in a
sentence mark and at line breaks; sentences of more than `LONGEST` words are cut further, so
one endless sentence is a run too: after each word whose hash with the next word is the
smallest among `NEAR` words to both sides. Those places depend on the words around them
alone, so a passage gets the same pieces wherever it stands in a sentence. A span is the
shortest run of at least `SENTENCES` pieces and `WORDS` words that starts at a piece. Every
span is hashed (128 bits over lower-cased words), hashes are joined over all documents, and
pieces that any non-first occurrence covers are removed. First is the smallest (doc_id, text
hash, place).

Whole batches of texts are cut and hashed at once: word hashes, cut places and span hashes
are sums and comparisons of arrays. Half a hash is counted first; only spans that share it
move whole. Counts are combined before the shuffle, and hashes are joined back to the spans
with a hot hash's spans spread over tasks. The text moves once: compressed, dealt by document
and cached.

Defined results: a null or empty text has no pieces, one of white space is one; texts with
fewer words than a span lose nothing; rows equal in doc_id and text count as one document and lose the
same pieces; a null doc_id sorts first; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemark.llm.common import KEY, dealt_texts, staged, texts_of
from tonemark.llm.words import mixed
from tonemark.operators.scale import lookup_join

SENTENCES = 3
WORDS = 20
LONGEST = 12
NEAR = 3
CHUNK_BYTES = 1 << 21
_SPANS = pa.schema(
    [(c, pa.int64()) for c in KEY] + [("at", pa.int32()), ("pieces", pa.int32()), ("high", pa.int64()), ("low", pa.int64())]
)
SPANS = "d long, th long, at int, pieces int, high long, low long"

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[0]))
_SPACE, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP[[ord(c) for c in ".!?"]] = True


class _Powers:
    """Powers of odd bases and of their inverses, for hashes of runs from running sums."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def upto(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 12)
            self.held = [tuple(self._powers(b) for b in (base, pow(base, -1, 1 << 64))) for base in _BASES]
        return self.held

    def _powers(self, base: int) -> np.ndarray:
        out = np.full(self.size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def _run_hashes(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, powers) -> np.ndarray:
    """Polynomial hashes of values[begin:end], the same wherever a run stands."""
    power, inverse = powers
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))


def _folded(text: bytes) -> bytes:
    """Lower-cased, as long as the text: of letters whose case changes their length, ASCII only."""
    low = text.decode("utf-8", "replace").lower().encode("utf-8", "replace")
    return low if len(low) == len(text) else text.lower()


class Pieces:
    """The pieces of some texts: `first` word and `offset` byte of each, `begin` and `end` of each text's."""

    def __init__(self, texts: list[bytes], powers: _Powers) -> None:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        folded = np.frombuffer(b"\n".join(map(_folded, texts)) + b"\n", np.uint8)
        held = powers.upto(len(data) + 1)
        edges = np.flatnonzero(np.diff((~_SPACE[data]).astype(np.int8), prepend=np.int8(0)))
        starts, ends = edges[::2], edges[1::2]
        self.hashes = _run_hashes(_BYTE[folded], starts, ends, held[0])
        bounds = np.cumsum([len(t) + 1 for t in texts])
        owner = np.searchsorted(bounds, starts, side="right")
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        # Texts are apart by a line break.
        broken = lines[np.append(starts[1:], len(data))] > lines[ends]
        last = np.flatnonzero(self._cuts(broken | _STOP[data[ends - 1]]))
        # One more than there are pieces: where the next would start.
        self.first = np.concatenate([[0], last + 1])
        begins = bounds - np.array([len(t) + 1 for t in texts])
        of_piece = owner[self.first[:-1]]
        self.offset = starts[self.first[:-1]] - begins[of_piece]
        self.end = np.searchsorted(of_piece, np.arange(len(texts)), side="right")
        self.begin = np.concatenate([[0], self.end[:-1]])
        self.of_piece, self.broken = of_piece, broken[last]
        self.powers = held

    def _cuts(self, closed: np.ndarray) -> np.ndarray:
        """Whether a piece ends after the word; `closed` says whether a sentence does."""
        if not len(closed):
            return closed
        sentence = np.concatenate([[0], np.cumsum(closed)[:-1]])
        long = np.bincount(sentence)[sentence] > LONGEST
        pair = np.full(len(closed), _FAR)
        pair[:-1] = mixed(self.hashes[:-1] * np.uint64(_BASES[1]) + self.hashes[1:])
        pair[closed] = _FAR
        least = pair.copy()
        for k in range(1, min(NEAR, len(pair) - 1) + 1):
            same = sentence[k:] == sentence[:-k]
            np.minimum(least[k:], pair[:-k], out=least[k:], where=same)
            np.minimum(least[:-k], pair[k:], out=least[:-k], where=same)
        return closed | (long & ~closed & (pair == least))

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first piece, piece after the last, high and low half of the hash) of every span."""
        at = np.arange(len(self.of_piece))
        end = np.maximum(at + SENTENCES, np.searchsorted(self.first, self.first[:-1] + WORDS))
        # Runs back from a line break, where they are not among the others.
        stop = np.flatnonzero(self.broken) + 1
        back = np.minimum(stop - SENTENCES, np.searchsorted(self.first, self.first[stop] - WORDS, side="right") - 1)
        inside = back >= self.begin[self.of_piece[stop - 1]]
        back, stop = back[inside], stop[inside]
        new = end[back] != stop
        fits = end <= self.end[self.of_piece]
        at, end = np.concatenate([at[fits], back[new]]), np.concatenate([end[fits], stop[new]])
        halves = []
        for words, powers in zip((self.hashes, mixed(self.hashes + np.uint64(_BASES[0]))), self.powers, strict=True):
            of_pieces = _run_hashes(words, self.first[:-1], self.first[1:], powers)
            halves.append(_run_hashes(of_pieces, at, end, powers).view(np.int64))
        return at, end, *halves


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of at most `CHUNK_BYTES`; a longer text is a run of its own."""
    begin = held = 0
    for k, text in enumerate(texts):
        if k > begin and held + len(text) + 1 > CHUNK_BYTES:
            yield begin, k
            begin, held = k, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def pieces(text: str) -> list[str]:
    """Pieces whose concatenation is the text."""
    raw = text.encode("utf-8", "replace")
    offsets = Pieces([raw], _Powers()).offset.tolist()[1:]
    return [raw[a:b].decode() for a, b in zip([0, *offsets], [*offsets, len(raw)], strict=True)] if raw else []


def _span_rows(batches):
    powers = _Powers()
    for batch in batches:
        texts, keys = texts_of(batch), [batch.column(c).to_numpy() for c in KEY]
        for begin, stop in chunks(texts):
            cut = Pieces(texts[begin:stop], powers)
            at, end, high, low = cut.spans()
            owner = cut.of_piece[at]
            columns = [*(k[begin + owner] for k in keys), at - cut.begin[owner], end - at, high, low]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SPANS, strict=True)], schema=_SPANS)


def removals(texts: DataFrame) -> DataFrame:
    """d, th and the list of (at, pieces) of repeated spans that go, for `dealt_texts`."""
    found = texts.select(*KEY, "packed").mapInArrow(_span_rows, SPANS)
    # Half a hash, and nothing else, tells which spans can be repeated; only those move whole.
    met = staged(found.groupBy("high").agg(F.count("*").alias("times")).filter("times > 1"), "met-hashes")
    spans = staged(lookup_join(found, met, ["high"], count_col="times", spread_by="d", row_bytes=48).select(*found.columns), "met-spans")
    place = F.struct(*KEY, "at")
    repeated = staged(
        spans.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1"),
        "repeated-spans",
    )
    later = lookup_join(spans, repeated, ["high", "low"], count_col="times", spread_by="d", row_bytes=48)
    return later.filter(place != F.col("first")).groupBy(*KEY).agg(F.collect_set(F.struct("at", "pieces")).alias("gone"))


_CUT = (
    "doc_id long, n_sentences long, n_removed long, n_spans long, n_words_removed long, "
    "kept_sha256 string, kept_text string"
)


def _kept(text: bytes, cut: Pieces, begin: int, end: int, gone) -> tuple[int, int, int, int, bytes]:
    """Pieces, removed pieces, removed runs and words, and what stays of one text."""
    if not gone:
        return max(end - begin, int(len(text) > 0)), 0, 0, 0, text
    drop = np.zeros(end - begin, bool)
    for span in gone:
        drop[span["at"] : span["at"] + span["pieces"]] = True
    edges = np.flatnonzero(np.diff(drop.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    offsets = [0, *cut.offset[begin + 1 : end].tolist(), len(text)]
    words = (cut.first[begin + 1 : end + 1] - cut.first[begin:end])[drop].sum()
    kept, at = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        kept.append(text[at : offsets[a]])
        at = offsets[b]
    return end - begin, int(drop.sum()), len(edges) // 2, int(words), b"".join([*kept, text[at:]])


def clean(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per document: counts, and the SHA-256 and the text of what stays."""
    texts = dealt_texts(docs)
    gone = removals(texts)

    def run(batches):
        powers = _Powers()
        for batch in batches:
            raw, out = texts_of(batch), []
            lost = batch.column("gone").to_pylist()
            for start, stop in chunks(raw):
                cut = Pieces(raw[start:stop], powers)
                bounds = zip(cut.begin.tolist(), cut.end.tolist(), strict=True)
                for k, (begin, end) in enumerate(bounds, start):
                    *counts, kept = _kept(raw[k], cut, begin, end, lost[k])
                    out.append((*counts, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            columns = list(zip(*out, strict=True))
            if columns:
                yield pa.record_batch(
                    [
                        batch.column("doc_id"),
                        *(pa.array(c, pa.int64()) for c in columns[:4]),
                        pa.array(columns[4], pa.string()),
                        pa.array(columns[5], pa.string()),
                    ],
                    ["doc_id", "n_sentences", "n_removed", "n_spans", "n_words_removed", "kept_sha256", "kept_text"],
                )

    out = texts.join(gone, KEY, "left").select("doc_id", "packed", "gone").mapInArrow(run, _CUT)
    try:
        return staged(out if with_text else out.drop("kept_text"), "cleaned-texts")
    finally:
        texts.unpersist()
