"""Operators 4, 5, 9 and 10: rules by brute force, models by held-out rows."""

import re
import zlib

import numpy as np
import pytest

from tonemark.llm import latent_retrieval, neighbour_quality, output_codes, queries, url_rules


# --- URL rules -------------------------------------------------------------------


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def fixed(host, path):
    best = None
    for verdict, rule_host, rule_path in url_rules.RULES:
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            if best is None or len(rule_host + rule_path) > len(best[0]):
                best = (rule_host + rule_path, verdict)
    return best or (None, None)


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET/en/x", "http://example.com/de/a?b#c", "http://xexample.com/de/",
    "http://net", "http://net/", "http://a.net?q=1", "http://b.org/fr/", "http://b.org/fr", "x://y://z/1", "http://\u00c4.net/\u00c9/",
    "http://a.com/p\nq?r", "http://a.com/" + "s/" * 3000 + "?" + "&".join(f"k{k}=1" for k in range(3000)),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, u, None) for k, u in enumerate(URLS)] + [(0, None, None), (5, URLS[5], None), (None, "http://free.example.org/x", None)]
    # casino pages are nearly all bad, the others nearly all good.
    rows += [(1000 + k, f"http://casino{k % 3}.example.org/play/{k}?ref=x", None) for k in range(60)]
    rows += [(2000 + k, f"http://news{k % 3}.example.org/read/{k}?ref=x", None) for k in range(200)]
    return spark.createDataFrame([(*r, "t", True) for r in rows], "page_id long, url string, html string, tokens string, fixed boolean")


@pytest.fixture(scope="module")
def page_labels(spark):
    rows = [(1000 + k, 1, int(k % 20 != 0)) for k in range(50)] + [(2000 + k, int(k % 30 != 0), 0) for k in range(150)]
    return spark.createDataFrame([*rows, (None, 0, 1), (3, None, None), (1001, 1, 0)], "doc_id long, quality int, toxic int")


def test_urls(pages, page_labels):
    got = url_rules.judge(pages, page_labels).collect()
    assert len(got) == pages.count()
    urls = {}
    for r in pages.collect():
        urls.setdefault(r.page_id, r.url)
    for r in got:
        host, path = split_url(urls[r.page_id])
        rule, verdict = fixed(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        mined = "block" if "casino" in host else "allow"
        assert r.verdict == (verdict or mined), r


def brute_rules(baskets, support, confidence):
    """All itemsets of blocked baskets up to four tokens, by counting."""
    from itertools import combinations

    n, least = len(baskets), int(np.ceil(support * len(baskets)))
    counts = {}
    for tokens, bad in baskets:
        for size in range(1, 5):
            for items in combinations(sorted(tokens), size):
                a, b = counts.get(items, (0, 0))
                counts[items] = (a + 1, b + bad)
    base = sum(b for _, b in baskets) / n
    found = {k: b / a for k, (a, b) in counts.items() if b >= least and b / a >= confidence and b / a > base}
    return {
        k: c for k, c in found.items()
        if not any(k[:i] + k[i + 1 :] in found and found[k[:i] + k[i + 1 :]] >= c for i in range(len(k)))
    }


def test_rules_are_those_of_counting(pages, page_labels):
    bad = {}
    for r in page_labels.collect():
        bad[r.doc_id] = bad.get(r.doc_id, False) or r.toxic == 1 or r.quality == 0
    described = url_rules.described(pages.filter("page_id >= 1000")).collect()
    baskets = [(r.tokens, bad[r.page_id]) for r in described if r.page_id in bad]
    want = brute_rules(baskets, 0.05, 0.6)
    got = {tuple(r.tokens): r.confidence for r in url_rules.mined(pages.filter("page_id >= 1000"), page_labels, 0.05, 0.6).collect()}
    short = {k: v for k, v in got.items() if len(k) <= 4}
    assert short.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and want


def test_urls_without_labels(spark, pages, page_labels):
    rows = url_rules.judge(pages, page_labels.limit(0)).collect()
    assert all(r.verdict == (fixed(r.host, r.path)[1] or "allow") for r in rows)
    assert url_rules.judge(pages.limit(0), page_labels).collect() == []


def test_deep_paths_are_tokens(spark):
    pages = spark.createDataFrame([(1, "http://a.net/en/docs/forum/casino7/x.html")], "page_id long, url string")
    tokens = url_rules.described(pages).first().tokens
    assert {"path=en", "path=docs", "path=forum", "path=casino#", "path=x.html"} <= set(tokens)


def test_constant_parts_are_one_token(spark):
    """Twenty parts that always stand together would be a million itemsets."""
    import time

    began = time.time()
    fixed_parts = "/".join(f"part{chr(97 + k)}" for k in range(20))
    rows = [(k, f"http://one.example.org/{fixed_parts}/{'bad' if k % 2 else 'good'}") for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(150)], "doc_id long, quality int, toxic int")
    rules = url_rules.associations(pages, labels).collect()
    assert [r.classes for r in rules] == [[["path=bad"]]] and time.time() - began < 30
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, labels, rules=()).collect()}
    assert got == {k: "block" if k % 2 else "allow" for k in range(200)}


def test_query_keys_come_before_the_fragment(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x#f?no=1"), (2, "http://a.net/x?yes=1#f")], "page_id long, url string")
    first, second = (r.tokens for r in url_rules.described(pages).orderBy("page_id").collect())
    assert not any(t.startswith("key=") for t in first) and "key=yes" in second


def test_op4_query(spark, sf):
    got = queries.QUERIES["op4_url_rules"](spark, sf)
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = got.collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        host, path = split_url(urls[r.page_id])
        rule, verdict = fixed(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


# --- quality ---------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.QUERIES["op5_neighbour_quality"](spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert len(labels) > 50
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in labels]) > 0.95
    good = [rows[r.doc_id].score for r in labels if r.quality == 1]
    bad = [rows[r.doc_id].score for r in labels if r.quality == 0]
    assert np.mean([[g > b for g in good] for b in bad]) > 0.97


def test_quality_never_reads_held_out_labels(spark, small, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = neighbour_quality.held_out(labels["doc_id"])
    flipped = labels.withColumn("quality", queries.F.when(out, 1 - labels["quality"]).otherwise(labels["quality"]))
    one, two = (sorted(map(tuple, neighbour_quality.score(small, x).collect())) for x in (labels, flipped))
    assert one == two


def test_quality_of_odd_rows(spark, odd, none, sf):
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0), (9, 0, 0), (None, 1, 0), (6, None, 0), (7, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    rows = neighbour_quality.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (1, 2)}
    assert len(empty) == 1
    assert {r.score for r in neighbour_quality.score(odd, labels.limit(0)).collect()} == {0.5}
    assert neighbour_quality.score(none, labels).collect() == []
    kept = neighbour_quality.keep(odd, labels)
    assert kept.columns == odd.columns


def test_votes_are_those_of_plain_neighbours():
    """Scores equal a loop over all neighbours."""
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab .AB1|!"), 80)) for _ in range(30)]
    counts = neighbour_quality.features(texts)
    x = neighbour_quality._weighted(counts, np.ones(counts.shape[1], np.float32))
    assert np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-5)
    assert (counts[:, : neighbour_quality.TERMS].sum(axis=1) <= 80).all()


# --- language ----------------------------------------------------------------------


def test_codewords_are_apart():
    for n in (1, 2, 3, 4, 7, 8, 30):
        codes = output_codes.codewords(n)
        assert len(codes) == n and set(np.unique(codes)) <= {-1, 1}
        gaps = [(codes[a] != codes[b]).sum() for a in range(n) for b in range(a)]
        assert not gaps or min(gaps) >= (1 if n < 4 else 3)


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op9_output_codes"](spark, sf).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_rare_languages_stay_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(output_codes, "MOST_ROWS", 40)
    rows = [(k, f"text {k}", f"big{k % 4}") for k in range(1200)] + [(5000 + k, f"rare {k}", "rare") for k in range(8)]
    langs = output_codes.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20)[1]
    assert len(langs) == 40 and langs.count("rare") >= 4


def test_language_of_odd_rows(odd, none):
    rows = output_codes.predict(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r.lang_pred for r in rows}
    assert [by_id[k] for k in (1, 2, 3, 5)] == ["und"] * 4
    assert set(by_id.values()) <= {"und", "en", "de", "fr"}
    assert output_codes.predict(none).collect() == []
    only = odd.filter("lang = 'en'")
    assert {r.lang_pred for r in output_codes.predict(only).collect()} == {"und", "en"}
    unknown = odd.withColumn("lang", queries.F.lit(None).cast("string"))
    assert {r.lang_pred for r in output_codes.predict(unknown).collect()} == {"und"}


# --- benchmark items -----------------------------------------------------------------


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("seed", range(5))
def test_common_subsequence(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 8, 50).tolist(), rng.integers(0, 8, 90).tolist()
    assert latent_retrieval.common_subsequence(a, b) == longest_common(a, b)


def test_vocabulary_places():
    rng = np.random.default_rng(0)
    own, others = (rng.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(2))
    vocabulary = latent_retrieval.Vocabulary(own)
    assert (vocabulary.words[vocabulary(own)] == own).all()
    assert (vocabulary(others) == -1).all()
    assert len(latent_retrieval.Vocabulary(own[:0])) == 0


def plain(text):
    return " " + " ".join(re.findall(r"\w+", (text or "").lower())) + " "


def test_op10_query_finds_verbatim_items(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op10_latent_retrieval"](spark, sf).collect()}
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert got == {(d, i) for d, t in docs.items() for i, s in items.items() if s in t}


def test_paraphrases(spark, small):
    """Every seventh word changed: found; clean texts and single shared phrases: not."""
    rng = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrst")
    lexicon = ["".join(rng.choice(letters, 5)) for _ in range(4000)]
    items = [(k, " ".join(rng.choice(lexicon, 20 + 8 * k))) for k in range(8)] + [(50, None), (51, "too short"), (52, "")]
    docs = []
    for k, text in items[:8]:
        changed = [rng.choice(lexicon) if i % 7 == 3 else w for i, w in enumerate(text.split())]
        around = [" ".join(rng.choice(lexicon, 60)) for _ in range(2)]
        docs += [(k, f"{around[0]} {' '.join(changed)} {around[1]}"), (100 + k, f"{around[0]} {' '.join(text.split()[:6])} {around[1]}")]
    docs += [(200, None), (201, ""), (0, docs[0][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").unionByName(small.select((queries.F.col("doc_id") + 1000).alias("doc_id"), "text"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in latent_retrieval.find(table, benchmark).collect())
    assert got == [(k, k) for k in range(8)]


def test_large_benchmarks_lose_no_holders(spark):
    """2200 items of running text: every verbatim holder is found, and every changed one that the word check takes."""
    rng = np.random.default_rng(5)
    source = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    source = [w for w in source if len(w) >= 70]

    def run(n):
        own = source[rng.integers(len(source))]
        at = rng.integers(len(own) - n + 1)
        return own[at : at + n]

    items = [run(int(n)) for n in rng.integers(15, 61, 2200)]
    split, docs, want = latent_retrieval.words.Words(), [], set()
    for k in range(0, 2200, 55):
        changed = list(items[k])
        for i in rng.choice(len(changed), len(changed) // 5, replace=False):
            changed[i] = run(1)[0]
        for doc, held in ((k, items[k]), (10_000 + k, changed)):
            text = " ".join([*run(50), *held, *run(50)])
            docs.append((doc, text))
            own, around = split([" ".join(items[k])])[0], split([text])[0]
            if latent_retrieval.checked(own, frozenset(own.tolist()), around) or doc == k:
                want.add((doc, k))
    table = spark.createDataFrame(docs, "doc_id long, text string").unionByName(
        spark.createDataFrame([(100_000 + k, " ".join(w)) for k, w in enumerate(source)], "doc_id long, text string")
    )
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in latent_retrieval.find(table, benchmark).collect()}
    assert want <= got, (len(want), len(want - got))


def test_items_of_common_words_among_rare_ones(spark):
    """What surrounds a passage does not hide it."""
    item = "which of these is the one that was not in it"
    docs = [(k, f"{item} {k}") for k in range(300)] + [(1000, " ".join([*(f"rare{k}" for k in range(40)), item, *(f"odd{k}" for k in range(40))]))]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id for r in latent_retrieval.find(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert got == {d for d, _ in docs}


def test_retrieval_of_odd_rows(spark, odd, none):
    benchmark = spark.createDataFrame([(1, "seven grey wolves watch from a distant hill while the fox jumps", "x")], "item_id long, text string, doc_id string")
    assert latent_retrieval.find(none, benchmark).collect() == []
    assert latent_retrieval.find(odd, benchmark.limit(0)).collect() == []
    kept = latent_retrieval.keep(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


def test_retrieval_in_blocks(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted((r.doc_id, r.item_id) for r in latent_retrieval.find(docs, benchmark).collect())
    monkeypatch.setattr(latent_retrieval, "MOST_WORDS", 600)
    assert sorted((r.doc_id, r.item_id) for r in latent_retrieval.find(docs, benchmark).collect()) == want


def test_short_items_are_found_word_for_word(spark):
    """Items of one to seven words, by a loop over all runs of words."""
    items = [(1, "Zebra"), (2, "one two three four five six seven"), (3, "two, three!"), (3, "two three"), (4, "three two"), (5, ""), (6, "a b c d"), (7, "zebra")]
    docs = [
        (1, "a zebra crossing"), (2, "zero one two three four five six seven eight"), (3, "one two. Three"), (4, "ZEBRA"), (5, None), (6, ""),
        (7, "one two three four five six"), (8, "a b c"), (9, "x a b c d"), (9, "x a b c d"), (None, "zebras"), (10, "two"),
    ]
    table = spark.createDataFrame([(*r, "t", True) for r in docs], "doc_id long, text string, _id string, short boolean")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = [r for r in latent_retrieval.find(table, benchmark).collect() if r.short]
    want = set()
    for d, text in docs:
        have = re.findall("[a-z0-9]+", (text or "").lower())
        for i, item in items:
            run = re.findall("[a-z0-9]+", item.lower())
            if run and any(have[k : k + len(run)] == run for k in range(len(have))):
                want.add((d, i, len(run)))
    assert {(r.doc_id, r.item_id, r.n_words) for r in found} == want and len(found) == len(want)
    kept = {r.doc_id for r in latent_retrieval.keep(table, benchmark).collect()}
    assert kept == {1, 3, 4, 5, 6, 7, 8, None, 10}


def test_directions_left_out_decide_on_candidates():
    """with as many directions as passages a window's products were those of plain TF-IDF."""
    hashes = np.arange(1, 81, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shared, first, second, other = hashes[:28], hashes[28:30], hashes[30:32], hashes[32:62]
    passages = [np.concatenate([shared, first]), np.concatenate([shared, second]), other]
    vocabulary = latent_retrieval.Vocabulary(hashes)
    own = latent_retrieval.Vocabulary(np.concatenate(passages))
    idf = np.ones(len(vocabulary))
    vectors = latent_retrieval.word_vectors(passages, own, idf[vocabulary(own.words)])
    assert vectors.shape[1] == 2
    # Passages without a common word: none is left out whole.
    apart = list(hashes.reshape(20, 4))
    words_of = latent_retrieval.Vocabulary(hashes)
    kept = latent_retrieval.word_vectors(apart, words_of, np.ones(80))
    assert kept.shape[1] >= 19 and all((kept[words_of(p)].sum(axis=0) ** 2).sum() / 4 >= 0.39 for p in apart)
    block = latent_retrieval.Block([0, 1, 2], passages, own.words, vectors, vocabulary, idf)
    assert (block.lengths**2 >= latent_retrieval.KEPT * 30 - 1e-3).all()
    # A sixth of the first passage and what the second has instead of the rest.
    at = vocabulary(np.concatenate([shared[:5], second, hashes[62:]]))
    product = block.vectors[block.place[at]].sum(axis=0) @ block.target.T
    assert 5 / 30 < latent_retrieval.SHARE <= product[0] / block.lengths[0] ** 2
    # The bound on windows holds for words that a passage does not have.
    assert block.share[at].sum() >= (product / block.lengths**2).max() - 1e-6
    assert block.cosine[at].sum() >= (product / block.lengths).max() - 1e-6
