"""Operators 2, 3, 7 and 8 against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tonemark.llm import byte_repeats, components, exact_dedup, lsh_forest, queries, sentence_spans, words


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


# --- bytes -----------------------------------------------------------------


def brute_bytes(rows, length):
    raw = [text.encode() for _, text in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((doc_id, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return (row[0] is not None, row)


def null_first(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, str(r[1:])))


def test_bytes_of_the_query(spark, sf, small):
    got = queries.QUERIES["op2_byte_repeats"](spark, sf).collect()
    assert null_first(got) == null_first(brute_bytes(pairs(small), 200))


def test_bytes_of_odd_rows(odd, none):
    got = byte_repeats.clean(odd)
    assert null_first(got.drop("kept").collect()) == null_first(brute_bytes(pairs(odd), 200))
    for r in got.collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    assert byte_repeats.clean(none).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_bytes_of_repetitive_texts(spark, seed):
    # Few letters, so that windows repeat at every distance, within a text too.
    rng = np.random.default_rng(seed)
    base = "".join(rng.choice(list("ab"), 60))
    rows = []
    for k in range(40):
        parts = [base[rng.integers(0, 30) : rng.integers(31, 60)] if rng.random() < 0.7 else "".join(rng.choice(list("abc"), 20)) for _ in range(8)]
        rows.append((k, "".join(parts)))
    rows += [(90, "a" * 300), (91, "ab" * 100), (92, "x" + "ab" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = byte_repeats.clean(docs, length=20, gram=8, with_bytes=False).collect()
    assert null_first(got) == null_first(brute_bytes(rows, 20))


# --- sentences ---------------------------------------------------------------


def brute_sentences(rows):
    """Removed pieces by the definition, all spans in one dictionary."""
    cut = {(d, t): sentence_spans.pieces(t) for d, t in rows}
    places = defaultdict(set)
    for (d, t), parts in cut.items():
        words_of = [p.lower().split() for p in parts]
        for i in range(len(parts)):
            for j in range(i + sentence_spans.SENTENCES, len(parts) + 1):
                if sum(map(len, words_of[i:j])) >= sentence_spans.WORDS:
                    places[tuple(map(tuple, words_of[i:j]))].add((d is not None, d or 0, t, i, j))
                    break
        for j in range(1, len(parts) + 1):
            if j == len(parts) or "\n" in parts[j - 1][len(parts[j - 1].rstrip()) :]:
                for i in range(j - sentence_spans.SENTENCES, -1, -1):
                    if sum(map(len, words_of[i:j])) >= sentence_spans.WORDS:
                        places[tuple(map(tuple, words_of[i:j]))].add((d is not None, d or 0, t, i, j))
                        break
    # The order of texts with one doc_id is that of a hash; such ties are left out here.
    gone = defaultdict(set)
    for found in places.values():
        for _, d, t, i, j in sorted(found)[1:]:
            gone[d, t].update(range(i, j))
    return {(d, t): "".join(p for k, p in enumerate(parts) if k not in gone[d or 0, t]) for (d, t), parts in cut.items()}


def test_sentence_pieces_are_lossless(odd, small):
    for _, text in [*pairs(odd), *pairs(small)]:
        assert "".join(sentence_spans.pieces(text)) == text


def looped_pieces(text):
    """The pieces of an ASCII text, word by word; only the hash of two words is the module's."""
    found = [(m[0], m.start()) for m in re.finditer(r"[^ \t\n\r\f\v]+", text)]
    sentences, here = [], []
    for k, (word, at) in enumerate(found):
        here.append(k)
        rest = text[at + len(word) : found[k + 1][1]] if k + 1 < len(found) else "\n"
        if word[-1] in ".!?" or "\n" in rest:
            sentences.append(here)
            here = []
    ends = set()
    for sentence in sentences:
        ends.add(sentence[-1])
        if len(sentence) > sentence_spans.LONGEST:
            hashes = [pair_hash(found[k][0], found[k + 1][0]) for k in sentence[:-1]]
            for i, h in enumerate(hashes):
                if h == min(hashes[max(0, i - sentence_spans.NEAR) : i + sentence_spans.NEAR + 1]):
                    ends.add(sentence[i])
    cuts = [found[k + 1][1] for k in sorted(ends) if k + 1 < len(found)]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])] if text else []


def pair_hash(first, second):
    a, b = sentence_spans.Pieces([f"{first} {second}".encode()], sentence_spans._Powers()).hashes
    return int(words.mixed(np.array([a * np.uint64(sentence_spans._BASES[1]) + b]))[0])


def test_pieces_by_loops():
    rng = np.random.default_rng(8)
    vocabulary = ["one", "Two.", "three", "fo.ur", "five!", "six", "seven", "\n", "\n\n", "  ", "eight", "nine", "a", "a"]
    texts = [" ".join(rng.choice(vocabulary, n, p=[0.1, 0.03, *[0.1] * 2, 0.02, *[0.1] * 2, *[0.01] * 2, 0.03, *[0.1] * 4])) for n in [0, 1, 2, 5, 40, 200, 400] * 5]
    for text in [*texts, "", " ", "\n", " a", "a ", "a.", ". . .", *(f"w{k} " * k for k in range(30))]:
        assert sentence_spans.pieces(text) == looped_pieces(text)
    # Texts cut together are cut as they are alone.
    together = sentence_spans.Pieces([t.encode() for t in texts], sentence_spans._Powers())
    assert [b - a for a, b in zip(together.begin, together.end)] == [len(looped_pieces(t)) if t.strip() else 0 for t in texts]


def test_sentences(odd, none, small):
    for docs in (odd.filter("doc_id is not null"), small):
        want = {d: kept for (d, _), kept in brute_sentences(pairs(docs)).items()}
        got = sentence_spans.clean(docs).collect()
        assert len(got) == docs.count()
        for r in got:
            assert r.kept_text == want[r.doc_id], r.doc_id
            assert r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest()
    assert sentence_spans.clean(none).collect() == []
    assert sentence_spans.clean(odd).count() == odd.count()
    # The shared passage stays at its first place only.
    kept = {r.doc_id: r.kept_text for r in sentence_spans.clean(odd.filter("doc_id > 6 and doc_id < 11")).collect()}
    assert "wolves watch" in kept[7] and "wolves watch" not in kept[8] and kept[10] == ""


@pytest.mark.parametrize("marks", [False, True])
def test_passages_inside_sentences(spark, marks):
    """A passage in the middle of a sentence of two documents goes from the second, at any offset."""
    rng = np.random.default_rng(4)
    rows, passages, number = [], {}, iter(range(10**6))
    for offset in range(30):
        passage = [f"w{next(number)}{'.' if marks and k % 9 == 5 else ''}" for k in range(60)]
        for doc, before in ((offset, 20), (1000 + offset, 20 + offset)):
            around = [[f"w{next(number)}" for _ in range(n)] for n in (before, 25)]
            rows.append((doc, " ".join([*around[0], *passage, *around[1]])))
        passages[1000 + offset] = passage
    docs = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "doc_id long, text string")
    texts = dict(rows)
    for r in sentence_spans.clean(docs).collect():
        kept, own = r.kept_text.split(), passages.get(r.doc_id, [])
        assert set(texts[r.doc_id].split()) - set(kept) <= set(own)
        assert len(set(own) & set(kept)) <= 0.5 * len(own), r.doc_id


def test_op3_query(spark, sf, small):
    want = {d: hashlib.sha256(t.encode()).hexdigest() for (d, _), t in brute_sentences(pairs(small)).items()}
    got = queries.QUERIES["op3_sentence_spans"](spark, sf).collect()
    assert {r.doc_id: r.kept_sha256 for r in got} == want


# --- exact copies --------------------------------------------------------------


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    known = rng.integers(0, 2**63, (5000, 4)).astype(np.uint64)
    sizes, bits = exact_dedup.build(known)
    assert sorted(exact_dedup.slots(known, sizes, bits)) == list(range(5000))
    assert exact_dedup.build(known[:0])[0] == []


def test_exact_copies(odd, none):
    rows = exact_dedup.dedup(odd).collect()
    assert len(rows) == odd.count()
    groups = defaultdict(list)
    for d, t in pairs(odd):
        groups[hashlib.sha256(t.encode()).hexdigest()].append(d)
    for r in rows:
        ids = groups[r.text_sha256]
        known = [d for d in ids if d is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(list(groups))
    assert exact_dedup.dedup(none).collect() == []
    kept = exact_dedup.keep(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_exact_copies_of_a_history(spark, odd):
    history = odd.filter("doc_id in (9, 12)")
    rows = exact_dedup.dedup(odd.filter("doc_id >= 10"), history).collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in rows} == {
        10: (9, False), 11: (11, True), 12: (12, False), 13: (12, False), 14: (14, True),
    }


def test_hot_lookups_are_split(odd, monkeypatch):
    want = sorted(map(str, exact_dedup.dedup(odd).collect()))
    monkeypatch.setattr(exact_dedup, "HOT_LOOKUPS", 2)
    monkeypatch.setattr(exact_dedup, "BUCKET_DIGESTS", 3)
    assert sorted(map(str, exact_dedup.dedup(odd).collect())) == want


# --- near copies -----------------------------------------------------------------


def word_lists(rows):
    return [re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.lower().encode()) for _, t in rows]


def shingle_set(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_near(rows):
    lists = word_lists(rows)
    first = {}
    for (d, _), w in zip(rows, lists, strict=True):
        if w:
            first.setdefault(tuple(w), []).append(d)
    reps = list(first)
    sets = {w: shingle_set(list(w)) for w in reps}
    root = {w: w for w in reps}

    def top(w):
        while root[w] != w:
            w = root[w]
        return w

    links = Counter()
    for i, a in enumerate(reps):
        for b in reps[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    members = defaultdict(list)
    for w in reps:
        members[top(w)] += [d for d in first[w] if d is not None]
    out = []
    for (d, _), w in zip(rows, lists, strict=True):
        w = tuple(w)
        own = min(members[top(w)], default=None) if w else d
        out.append((d, own, links[w] if w else 0))
    return out


def near(docs):
    return null_first(tuple(r) for r in lsh_forest.join(docs).select("doc_id", "class_id", "n_links").collect())


def test_word_hashes_tell_words_apart(small):
    rows = pairs(small)
    hashes, counts = words.Words()([t for _, t in rows])
    lists = word_lists(rows)
    assert [len(w) for w in lists] == counts.tolist()
    names = {}
    for h, w in zip(hashes.tolist(), [w for ws in lists for w in ws], strict=True):
        assert names.setdefault(h, w) == w
    assert len(names) == len({w for ws in lists for w in ws})


def test_near_copies(odd, none, small):
    assert near(odd) == null_first(brute_near(pairs(odd)))
    assert near(small) == null_first(brute_near(pairs(small)))
    assert near(none) == []


def near_rows(spark, n, seed=1):
    """One base text in n versions that differ in a word or two: links between all or many."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(n):
        own = list(base)
        for at in rng.integers(0, 120, 1 + k % 2):
            own[at] = f"x{rng.integers(0, 9)}"
        rows.append((k, " ".join(own)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_near_copies_in_blocks(spark, monkeypatch):
    rows, docs = near_rows(spark, 120)
    want = null_first(brute_near(rows))
    assert sum(r[2] for r in want) > 4000
    assert near(docs) == want
    monkeypatch.setattr(lsh_forest, "BLOCK", 20)
    assert near(docs) == want


def test_keep_leaves_one_of_each_class(spark, odd):
    rows, docs = near_rows(spark, 30)
    kept = lsh_forest.keep(docs)
    assert {r.doc_id for r in kept.collect()} == {r[1] for r in brute_near(rows)}
    assert lsh_forest.keep(odd).columns == odd.columns


def test_op8_query(spark, sf, small):
    got = queries.QUERIES["op8_lsh_forest"](spark, sf).select("doc_id", "class_id", "n_links").collect()
    assert null_first(got) == null_first(brute_near(pairs(small)))


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 99), (99, 50), (7, 7)]
    got = {r.u: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 50, 99: 50, 50: 50}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []
