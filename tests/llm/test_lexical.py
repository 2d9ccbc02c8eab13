"""Operator 13 by plain loops over all documents and items."""

import math
import re

from tonemark.llm import lexical_search, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=50):
    held = [(d, split(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    total, length = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item_id, text in items:
        words = [w for w in set(split(text)) if w in df]
        scored = []
        for d, t in held:
            m = 50 + 50 * len(t) * total // length
            score = 0
            for w in words:
                tf = t.count(w)
                score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item_id, k, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top], 1)]
    return out


def same(frame, want):
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(want, key=str)


DOCS = [
    (1, None), (2, ""), (3, "  \n"), (4, "One two, two: THREE"), (5, "two two two"), (5, "two two two"), (6, "zweiÄä Ä İI one"),
    (None, "one one"), (7, "x " * 40_000 + "one"), (8, "a\0b\x7fc_d 9"), (9, "it's"), *[(100 + k, "tie of equal texts") for k in range(70)],
    *[(400 - k, "tie of equal texts too") for k in range(30)],
]
ITEMS = [
    (1, None), (2, ""), (3, "one TWO three"), (4, "Ä İi"), (5, "tie"), (5, "tie"), (None, "b c d"), (6, "nothing here matches?"), (7, "equal equal x"),
]


def frames(spark):
    docs = spark.createDataFrame([(*r, "t", 1) for r in DOCS], "doc_id long, text string, item string, score int").repartition(7)
    return docs, spark.createDataFrame([(*r, 2, 3) for r in ITEMS], "item_id long, text string, doc_id int, rank int")


def test_ranks(spark):
    docs, items = frames(spark)
    same(lexical_search.search(docs, items), plain(DOCS, ITEMS))
    same(lexical_search.search(docs, items, top=3), plain(DOCS, ITEMS, 3))


def test_blocks_and_tiles_change_nothing(spark, monkeypatch):
    docs, items = frames(spark)
    for name, value in {"TILE_TERMS": 2, "TILE_DOCUMENTS": 3, "TILE_ITEMS": 2, "MERGED": 2, "MOST_ITEMS": 4}.items():
        monkeypatch.setattr(lexical_search, name, value)
    same(lexical_search.search(docs, items, most_terms=4), plain(DOCS, ITEMS))


def test_partial_sums_are_exact():
    # The largest weight of any 64-bit count times the largest impact, over a whole tile.
    largest = lexical_search.weight((1 << 63) - 1, 0)
    assert largest < 44_362 and lexical_search.TILE_TERMS * largest * 10**6 < 1 << 53


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert lexical_search.search(docs.limit(0), items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []
    assert lexical_search.search(docs.filter("doc_id < 4"), items).collect() == []


def test_op13_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    same(queries.QUERIES["op13_lexical_search"](spark, sf), plain(docs, items))
