"""Operators 1 and 6: exact round trips against the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tonemark.llm import packing, pfor, queries, token_files, tokens
from tonemark.sources.storage import new_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 50257, 2**32 - 1])
def test_blocks_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint32)
    ids[rng.integers(0, max(n, 1), 3)[: n and 3]] = 2**32 - 1
    data, starts = pfor.pack(ids)
    assert (pfor.unpack(data, starts, n) == ids).all()
    assert len(starts) == -(-n // pfor.BLOCK)


@pytest.mark.parametrize(
    "text",
    ["", " ", "a b", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", "a\n\nb", "\n", "don't we'll", "a\u00a0b c", "x\0 y", "\x1c a b",
     "a\u0085b", "<|endoftext|> x", "hello <|endoftext|> x", "a<|endoftext|><|endoftext|>\nb", "<|endo ftext|> x", "\u00c9t\u00e9 \u4f60\u597d \U0001f600!", "a,b ,c .", "12 345 6",
     "a  b\tc", "a \n b\u2003c", "\n\u00dfen.\nOn!? \u00e9t\u00e9, \u02b0a e\u0301t ..."],
)
def test_pieces_encode_like_the_whole(tokenizer, text):
    assert tokens.encode([text])[0] == ids_of(tokenizer, text, 0)[:-1].astype("<u4").tobytes()


def test_latin_words_encode_like_the_library(tokenizer):
    letters = [chr(x) for x in range(33, 0x370)]
    texts = [f"x {a}{b}{m}\n{a}{b}" for a in letters for b in ("", "a") for m in ("", ".", "!?")]
    for text, ids in zip(texts, tokens.encode(texts), strict=True):
        assert ids == ids_of(tokenizer, text, 0)[:-1].astype("<u4").tobytes(), text


def test_full_cache_keeps_its_older_half(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 10)
    cache = tokens._worker_state(tokens.VOCABULARY)["pieces"]
    cache.clear()
    for text in ("one two three four five six seven", "a b c d e f g h", "x h z"):
        assert tokens.encode([text])[0] == ids_of(tokenizer, text, 0)[:-1].astype("<u4").tobytes()
    assert set(list(cache)[:5]) < {"\0one", "two", "three", "four", "five", "six", "seven"}
    assert set(list(cache)[5:]) == {"\0x", "h", "z"}


def expected_files(tokenizer, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(tokenizer, text, 2)
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, odd, none, small, tokenizer, monkeypatch):
    for docs in (odd, none, small):
        path = new_path(spark, "t")
        token_files.write(docs, path)
        got = [tuple(r) for r in token_files.read(spark, path).collect()]
        want = expected_files(tokenizer, [(r.doc_id, r.text) for r in docs.collect()])
        assert sorted(got, key=lambda r: r[1]) == want
    path = new_path(spark, "t")
    token_files.write(odd, path)
    for r in token_files.read(spark, path, with_ids=True).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens


def test_op1_query(spark, sf, small, tokenizer):
    got = sorted(map(tuple, queries.QUERIES["op1_token_blocks"](spark, sf).collect()))
    assert got == expected_files(tokenizer, [(r.doc_id, r.text) for r in small.collect()])


def test_differencing_fills_windows():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 300):
        lengths = np.minimum(2047, rng.lognormal(6, 1, n).astype(int) + 1)
        found = packing.windows_of(lengths, 2048)
        sums = np.bincount(found, weights=lengths)
        assert sums.max() <= 2048 and len(found) == n
    even, fullest = packing.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert fullest in (15, 16) and np.bincount(even, weights=[8, 7, 6, 5, 4]).max() == fullest


def check_pieces(tokenizer, rows, pieces):
    whole = defaultdict(list)
    for doc_id, text in rows:
        whole[doc_id].append(ids_of(tokenizer, text, 1))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        by_sequence[p.sequence_id].append(p)
    assert {k[0] for k in by_doc} == set(whole)
    for (doc_id, n), own in by_doc.items():
        same = [x for x in whole[doc_id] if len(x) == n]
        assert sum(p.length for p in own) == n * len(same)
        for p in own:
            assert any(zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in same)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
    total = sum(p.length for p in pieces)
    return len(by_sequence) * packing.CAPACITY / max(total, 1) - 1


def test_packing(odd, none, small, tokenizer):
    for docs in (odd, small):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        padding = check_pieces(tokenizer, rows, packing.pack(docs.coalesce(1)).collect())
        assert padding < 0.05
    assert packing.pack(none).collect() == []


def test_op6_query(spark, sf, small, tokenizer):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    check_pieces(tokenizer, rows, queries.QUERIES["op6_packing"](spark, sf).collect())
