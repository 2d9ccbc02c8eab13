"""Operator 10: documents that hold benchmark items, also paraphrased.

1. Benchmark items are cut into passages of at most `PASSAGE` words. How many documents
   hold each of their words is counted over the whole corpus; that gives the weights.
2. Passages are dealt into blocks of about `BLOCK`. A randomised SVD of each block's TF-IDF
   matrix, made in one task, gives its words vectors: hashed Gaussian projections of the
   rows, one power iteration, an orthonormal basis and the rotation to singular directions.
   A block keeps its strongest directions, no more than are needed for `KEPT` of its passages'
   squared length and `LEAST` of each one's: what tells near-equal passages apart goes first,
   and words of passages that share others stand for each other.
3. Every window of the corpus, two blocks of `STEP` words that start at every block, is
   projected by the same vectors and compared with all passages, of which only the kept part
   counts. It is a candidate if it holds `SHARE` of the passage's squared length, whatever
   else it holds, or has a cosine of `COSINE`, its own length counting all its words. A passage
   touches at most five blocks of words, so three windows cover it, and what its words add
   comes to all of its kept part: in one of them they add a third if it is there word for word.
   Sums of each word's largest part in any passage, its own word or not, bound both figures
   from above; windows below the bounds are not projected.
4. Candidates are checked on words: the longest common subsequence of the passage and the
   text around the window must cover `COMMON` of the passage, or `LOOSE` of it if also the
   answer, its last quarter, is covered to `ANSWER`.

The vectors of the benchmark's words are sent to every task. Their number is bounded by
`MOST_WORDS`: the blocks of a larger benchmark are worked off in several passes.

Items of fewer than `SHORTEST` words have no paraphrase that could be told from chance. They
are found word for word: the hash of their whole run is looked up at every word of every text,
and the result says that they are short. `keep` takes those of `CONTAMINATING` words and more
for contamination; one to three words are common speech.

Defined results: null and empty texts hold nothing, nor do items without a word; equal items are found under each id; rows
equal in doc_id and text give one row an item; an empty corpus or benchmark gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemark.llm import words
from tonemark.llm.common import among, staged

PASSAGE = 64
SHORTEST = 8
STEP = 16
BLOCK = 128
KEPT = 0.95
LEAST = 0.4
COSINE = 0.25
SHARE = 0.2
COMMON = 0.8
LOOSE = 0.6
ANSWER = 0.8
MOST_WORDS = 150_000
CONTAMINATING = 4
FOUND = "doc_id long, text_hash long, item_id long, cosine double, common double, answer double"
_RUNS = "doc_id long, text_hash long, n_words int, run long"


def _slices(batches, size: int = 128):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def passages(benchmark: DataFrame) -> DataFrame:
    """item_id, part and word hashes of every passage."""

    def cut(batches):
        split = words.Words()
        for part in _slices(batches):
            hashes, counts = split(part.column("text").to_pylist())
            ends, rows = np.cumsum(counts), []
            for item, end, n in zip(part.column("item_id").to_pylist(), ends, counts, strict=True):
                if n < SHORTEST:
                    continue
                pieces = -(-int(n) // PASSAGE)
                for k, piece in enumerate(np.array_split(hashes[end - n : end].view(np.int64), pieces)):
                    rows.append((item, k, piece))
            yield pa.record_batch(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                ["item_id", "part", "words"],
            )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "item_id long, part int, words array<long>")


class Vocabulary:
    """Places of words in a sorted list, by tables in which each word owns a cell.

    Words that fall on a taken cell go to a next, smaller table.
    """

    def __init__(self, hashes: np.ndarray) -> None:
        self.words = np.unique(hashes)
        self.tables, rest = [], np.arange(len(self.words))
        while len(rest):
            bits = max(4, int(8 * len(rest)).bit_length())
            table = np.full(1 << bits, -1, np.int32)
            cell = self._cell(self.words[rest], bits)
            table[cell[::-1]] = rest[::-1]
            self.tables.append((bits, table))
            rest = rest[table[cell] != rest]

    def _cell(self, hashes: np.ndarray, bits: int) -> np.ndarray:
        return ((hashes << np.uint64(7 * len(self.tables))) >> np.uint64(64 - bits)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.words)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for others."""
        found = np.full(len(hashes), -1)
        for level, (bits, table) in enumerate(self.tables):
            at = table[((hashes << np.uint64(7 * level)) >> np.uint64(64 - bits)).astype(np.int64)]
            hit = (at >= 0) & (self.words[at] == hashes)
            found[hit] = at[hit]
        return found


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, df) of the vocabulary's words, and their documents under a null word."""

    def counted(batches):
        split, total, n_docs = words.Words(), np.zeros(len(vocabulary), np.int64), 0
        for part in _slices(batches):
            hashes, counts = split(part.column("text").to_pylist())
            at = vocabulary(hashes)
            doc = np.repeat(np.arange(len(counts)), counts)[at >= 0]
            pairs = np.unique(doc * len(vocabulary) + at[at >= 0])
            total += np.bincount(pairs % max(1, len(vocabulary)), minlength=len(vocabulary))
            n_docs += len(counts)
        has = np.flatnonzero(total)
        yield pa.record_batch(
            [pa.array([*vocabulary.words[has].view(np.int64).tolist(), None], pa.int64()), pa.array([*total[has].tolist(), n_docs], pa.int64())],
            ["word", "df"],
        )

    counts = _keyed(docs).select("text").mapInArrow(counted, "word long, df long")
    return counts.groupBy("word").agg(F.sum("df").alias("df"))


def _gaussian(hashes: np.ndarray, n: int) -> np.ndarray:
    """(words, n) normal numbers that only depend on the word."""
    columns = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a = words.mixed(hashes[:, None] ^ columns)
    b = words.mixed(a + np.uint64(0x632BE59BD9B4E019))
    u, v = (a >> np.uint64(11)) * 2.0**-53 + 2.0**-54, (b >> np.uint64(11)) * 2.0**-53
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


def word_vectors(rows: list[np.ndarray], vocabulary: Vocabulary, idf: np.ndarray) -> np.ndarray:
    """Right singular vectors of the rows' TF-IDF matrix, one vector per word.

    The strongest directions, until they hold `KEPT` of all squared length and `LEAST` of each row's.
    """
    wide = min(len(rows) + 8, len(vocabulary))
    x = np.zeros((len(rows), len(vocabulary)))
    for k, row in enumerate(rows):
        at, tf = np.unique(vocabulary(row), return_counts=True)
        x[k, at] = tf * idf[at]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    basis = np.linalg.qr(x.T @ (x @ _gaussian(vocabulary.words, wide)))[0]
    values, rotation = np.linalg.eigh((x @ basis).T @ (x @ basis))
    directions = basis @ rotation[:, np.argsort(-values)[: len(rows)]]
    held = np.cumsum((x @ directions) ** 2, axis=1)
    rank = 1 + max(np.searchsorted(held.mean(axis=0), KEPT), np.searchsorted(held.min(axis=0), LEAST))
    return directions[:, :rank].astype(np.float32)


def block_vectors(rows: DataFrame, vocabulary: Vocabulary, idf: np.ndarray) -> DataFrame:
    """(block, words, vectors): the words of each block in order and the rows of their vectors."""

    def made(group: pa.Table) -> pa.Table:
        held = [np.array(r, np.int64).view(np.uint64) for r in group.column("words").to_pylist()]
        own = Vocabulary(np.concatenate(held))
        vectors = word_vectors(held, own, idf[vocabulary(own.words)])
        return pa.table(
            {
                "block": group.column("block").slice(0, 1),
                "words": pa.array([own.words.view(np.int64)], pa.list_(pa.int64())),
                "vectors": pa.array([vectors.tobytes()], pa.binary()),
            }
        )

    return rows.groupBy("block").applyInArrow(made, "block long, words array<long>, vectors binary")


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, all of a's places in one integer."""
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        match = places.get(x)
        if match:
            kept = row & match
            row = ((row + kept) | (row - kept)) & full
    return len(a) - row.bit_count()


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item it holds, with the cosine and both shares."""
    spark = docs.sparkSession
    rows = staged(passages(benchmark), "passages")
    blocks = max(1, -(-rows.count() // BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)))
    slots = rows.select("block", F.explode("words").alias("word"))
    sizes = slots.groupBy("block").agg(F.count_distinct("word").alias("words")).orderBy("block")
    passes: list[list[int]] = [[]]
    left = MOST_WORDS
    for r in sizes.collect():  # one row per block of passages
        if r["words"] > left and passes[-1]:
            passes.append([])
            left = MOST_WORDS
        passes[-1].append(r["block"])
        left -= r["words"]
    found = spark.createDataFrame([], FOUND)
    for own in passes:
        if own:
            found = found.unionByName(_found(docs, rows.filter(F.col("block").between(own[0], own[-1]))))
    best = F.max(F.struct("common", "answer", "cosine")).alias("best")
    merged = found.groupBy("doc_id", "text_hash", "item_id").agg(best)
    flags = (F.lit(False).alias("short"), F.lit(None).cast("int").alias("n_words"))
    long = merged.select("doc_id", "text_hash", "item_id", "best.cosine", "best.common", "best.answer", *flags)
    return long.unionByName(short_found(docs, benchmark))


def short_items(benchmark: DataFrame) -> DataFrame:
    """item_id, n_words and the hash of the whole run of every short item."""

    def cut(batches):
        split = words.Words()
        for part in _slices(batches):
            hashes, counts = split(part.column("text").to_pylist())
            rows = []
            for item, end, n in zip(part.column("item_id").to_pylist(), np.cumsum(counts), counts, strict=True):
                if 0 < n < SHORTEST:
                    run, _ = words.shingles(hashes[end - n : end], np.array([n]), int(n))
                    rows.append((item, int(n), int(run.view(np.int64)[0])))
            yield pa.record_batch(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], ["item_id", "n_words", "run"]
            )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "item_id long, n_words int, run long")


def _runs(docs: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """The wanted runs, by their number of words, that each text holds."""

    def run(batches):
        split = words.Words()
        for part in _slices(batches):
            hashes, counts = split(part.column("text").to_pylist())
            for n, known in wanted.items():
                got, each = words.shingles(hashes, counts, n)
                doc = np.repeat(np.arange(len(each)), each)
                at = np.minimum(np.searchsorted(known, got), len(known) - 1)
                hit = (known[at] == got) & (counts[doc] >= n)
                pairs = np.unique(np.stack([doc[hit], at[hit]]), axis=1)
                rows = pa.array(pairs[0], pa.int32())
                yield pa.record_batch(
                    [
                        part.column("doc_id").take(rows),
                        part.column("text_hash").take(rows),
                        pa.array([n] * len(rows), pa.int32()),
                        pa.array(known[pairs[1]].view(np.int64)),
                    ],
                    ["doc_id", "text_hash", "n_words", "run"],
                )

    return _keyed(docs).mapInArrow(run, _RUNS)


def short_found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of `find` for items of fewer than `SHORTEST` words, word for word."""
    items = staged(short_items(benchmark), "short-items")
    held: list[dict[int, list[int]]] = [{}]
    size = 0
    # At most `MOST_WORDS` runs are sent to the tasks at a time.
    for r in items.select("n_words", "run").distinct().toLocalIterator():
        if size == MOST_WORDS:
            held, size = [*held, {}], 0
        held[-1].setdefault(r["n_words"], []).append(r["run"])
        size += 1
    runs = docs.sparkSession.createDataFrame([], _RUNS)
    for some in held:
        if some:
            runs = runs.unionByName(_runs(docs, {n: np.unique(np.array(v, np.int64).view(np.uint64)) for n, v in some.items()}))
    one = F.lit(1.0)
    return (
        runs.distinct()
        .join(items, ["n_words", "run"])
        .select(
            "doc_id", "text_hash", "item_id", one.alias("cosine"), one.alias("common"), one.alias("answer"), F.lit(True).alias("short"), "n_words"
        )
        .distinct()
    )


class Block:
    """Passages of one block, the vectors of their words, and bounds on what a word adds."""

    def __init__(self, numbers: list[int], passage: list[np.ndarray], own: np.ndarray, vectors: np.ndarray, vocabulary: Vocabulary, idf: np.ndarray) -> None:
        self.numbers = np.array(numbers)
        at = vocabulary(own)
        # Places of all words among the block's own; other words have the zero row at the end.
        self.place = np.full(len(vocabulary) + 1, len(own), np.int32)
        self.place[at] = np.arange(len(own))
        weighted = vectors.reshape(len(own), -1) * idf[at, None].astype(np.float32)
        self.vectors = np.vstack([weighted, np.zeros((1, weighted.shape[1]), np.float32)])
        held = [self.place[vocabulary(p)] for p in passage]
        self.target = np.stack([weighted[p].sum(axis=0) for p in held])
        self.lengths = np.linalg.norm(self.target, axis=1)
        self.share, self.cosine = (np.zeros(len(vocabulary) + 1) for _ in range(2))
        # What each word adds to each passage; a word that takes away adds nothing to a bound.
        adds = np.maximum(weighted @ self.target.T, 0.0)
        self.share[at] = (adds / self.lengths**2).max(axis=1)
        self.cosine[at] = (adds / self.lengths).max(axis=1)


def _found(docs: DataFrame, rows: DataFrame) -> DataFrame:
    held = rows.collect()  # passages of one pass, bounded by MOST_WORDS
    passage = [np.array(r["words"], np.int64).view(np.uint64) for r in held]
    items = [r["item_id"] for r in held]
    vocabulary = Vocabulary(np.concatenate(passage))
    counts = {r["word"]: r["df"] for r in document_frequencies(docs, vocabulary).toLocalIterator()}
    n_docs = counts.pop(None, 0)
    df = np.array([counts.get(int(w), 0) for w in vocabulary.words.view(np.int64)])
    idf = np.log((1 + n_docs) / (1 + df)) + 0.1
    numbers: dict[int, list[int]] = {}
    for k, r in enumerate(held):
        numbers.setdefault(r["block"], []).append(k)
    blocks = [
        Block(own := numbers[r["block"]], [passage[k] for k in own], np.array(r["words"], np.int64).view(np.uint64),
              np.frombuffer(r["vectors"], np.float32), vocabulary, idf)
        for r in block_vectors(rows, vocabulary, idf).collect()  # at most MOST_WORDS vectors
    ]
    alike = [frozenset(p.tolist()) for p in passage]
    # Windows at a time, so that their cosines take 64 MB at most.
    several = max(64, (1 << 24) // max(max(len(b.target), b.vectors.shape[1]) for b in blocks))
    # Words that no passage has come last; their weight counts in a window's length.
    squares = np.append(idf, np.log((1 + n_docs) / 2) + 0.1) ** 2
    share, cosine = (np.max([getattr(b, name) for b in blocks], axis=0) for name in ("share", "cosine"))

    def searched(batches):
        split = words.Words()
        for part in _slices(batches):
            hashes, n = split(part.column("text").to_pylist())
            ends = np.cumsum(n)
            begins = ends - n
            n_blocks = -(-n // STEP)
            doc = np.repeat(np.arange(len(n)), n_blocks)
            step = np.arange(len(doc)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
            starts = begins[doc] + step * STEP
            # A window: a block and, in the same document, the next one.
            stops = np.minimum(starts + 2 * STEP, ends[doc])
            at = vocabulary(hashes)

            def summed(values, windows):
                total = np.concatenate([[0.0], np.cumsum(values[at])])
                return total[stops[windows]] - total[starts[windows]]

            lengths = np.sqrt(np.maximum(summed(squares, slice(None)), 1e-12))

            def possible(shares, cosines, windows):
                """Windows that may hold a candidate, by bounds and room for rounding."""
                near = summed(shares, windows) >= 0.999 * SHARE
                near |= summed(cosines, windows) >= 0.999 * COSINE * lengths[windows]
                return windows[near]

            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            likely = possible(share, cosine, np.arange(len(starts)))
            for block in blocks if len(likely) else ():
                own_windows = possible(block.share, block.cosine, likely) if len(blocks) > 1 else likely
                for k in range(0, len(own_windows), several):
                    windows = own_windows[k : k + several]
                    sums = _window_sums(block.place[at], starts[windows], stops[windows], block.vectors)
                    products = sums @ block.target.T
                    length = lengths[windows].astype(np.float32)[:, None]
                    least = np.minimum(SHARE * block.lengths**2, COSINE * block.lengths * length)
                    for w, p in zip(*np.nonzero(products >= least), strict=True):
                        number, start = int(block.numbers[p]), starts[windows[w]]
                        d, own = int(doc[windows[w]]), passage[number]
                        lo = max(begins[d], start - len(own))
                        hi = min(ends[d], start + 2 * STEP + len(own))
                        found = checked(own, alike[number], hashes[lo:hi])
                        if found:
                            found = (*found, float(products[w, p] / (block.lengths[p] * length[w, 0])))
                            best[d, number] = max(best.get((d, number), found), found)
            yield _found_rows(part, best)

    def _found_rows(part, best):
        docs_at = pa.array([d for d, _ in best], pa.int32())
        values = list(best.values())
        return pa.record_batch(
            [
                part.column("doc_id").take(docs_at),
                part.column("text_hash").take(docs_at),
                pa.array([items[p] for _, p in best], pa.int64()),
                *(pa.array([v[k] for v in values], pa.float64()) for k in (2, 0, 1)),
            ],
            ["doc_id", "text_hash", "item_id", "cosine", "common", "answer"],
        )

    return _keyed(docs).mapInArrow(searched, FOUND)


def _window_sums(at: np.ndarray, starts: np.ndarray, stops: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sums of the vectors of the words from each start to its stop; the last row is zero."""
    out = np.zeros((len(starts), vectors.shape[1]), np.float32)
    for k in range(2 * STEP):
        place = starts + k
        out += vectors[np.where(place < stops, at[np.minimum(place, len(at) - 1)], -1)]
    return out


def checked(passage: np.ndarray, alike: frozenset, text: np.ndarray) -> tuple[float, float] | None:
    """Shares of the passage and of its answer that are in the text in order, if enough."""
    own, around = passage.tolist(), text.tolist()
    # No common subsequence is longer than the number of its words that occur at all.
    there = alike.intersection(around)
    if sum(w in there for w in own) < LOOSE * len(own):
        return None
    common = common_subsequence(own, around) / len(own)
    if common < LOOSE:
        return None
    last = own[-max(1, len(own) // 4) :]
    answer = common_subsequence(last, around) / len(last)
    return (common, answer) if common >= COMMON or answer >= ANSWER else None


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    found = find(docs, benchmark).filter(~F.col("short") | (F.col("n_words") >= CONTAMINATING))
    kept, named = among(docs, found.select("doc_id", "text_hash").distinct(), "left_anti", F.xxhash64(F.coalesce("text", F.lit(""))))
    return kept.drop(named)
