"""Token ids of whole texts, with a worker-wide cache of encoded pieces.

The byte-level vocabulary never joins a non-space character with a space that follows
it, so a text may be cut before each single space or line break and every piece encoded
alone. Texts with any other white space, or with a token that the vocabulary adds (such
as an end mark, which is one id), go through the library whole. The cache saves
time only; its newer half goes when it is full, so memory stays bounded. Plain words skip the
library's text normalisation and go to its model directly, with the same ids.
"""

from __future__ import annotations

import os
import sys
import types
from array import array
from itertools import compress, islice
from operator import not_

VOCABULARY = "byte_bpe_50k.json"
CACHED_PIECES = 1_200_000
WHOLE_BATCH = 64


def _worker_state(vocabulary: str) -> dict:
    """The tokenizer and its cache: one per Python worker, kept between tasks."""
    home = sys.modules.setdefault("_token_cache", types.ModuleType("_token_cache"))
    if vocabulary not in home.__dict__:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        path = vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary)
        tokenizer = Tokenizer.from_file(path)
        added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
        pre = tokenizer.pre_tokenizer
        plain = isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
        model = tokenizer.model if plain and tokenizer.normalizer is None else None
        home.__dict__[vocabulary] = {"tokenizer": tokenizer, "model": model, "pieces": {}, "added": added}
    return home.__dict__[vocabulary]


def cut(text: str) -> list[str] | None:
    """Pieces between single spaces and line breaks; None if the text holds a NUL.

    A piece is keyed by how it begins: a line break is kept, NUL marks the first piece of
    the text, and every other piece stands for itself after one space.
    """
    if "\0" in text:
        return None
    pieces = text.replace("\n", " \n").split(" ")
    pieces[0] = "\0" + pieces[0]
    return pieces


def _alone(piece: str) -> bool:
    """Whether the piece is one word without white space, so that it encodes alone."""
    word = piece[1:] if piece[:1] in ("\n", "\0") else piece
    return word.split() == [word]


def _spelled(piece: str) -> str:
    return piece if piece[0] == "\n" else piece[1:] if piece[0] == "\0" else " " + piece


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes that are not printable: from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {byte: chr(256 + i) for i, byte in enumerate(sorted(set(range(256)) - printable))}


_LETTERS = _byte_letters()
_MARKS = ",.;:!?"


def _word_ids(piece: str, model) -> bytes | None:
    """Ids of a Latin word and the marks behind it, straight from the library's model.

    The pre-tokenizer makes one token of such a word with the space before it, one of a
    line break and one of the marks; anything else gives None and takes the long way.
    """
    word = piece.rstrip(_MARKS)
    lead = word[0] if word[:1] in ("\n", "\0") else ""
    body = word[len(lead) :]
    if not body.isalpha() or max(body) >= "\u0370":
        return None
    parts = [_LETTERS[10]] if lead == "\n" else []
    body = body if body.isascii() else body.encode().decode("latin-1").translate(_LETTERS)
    parts.append(body if lead else _LETTERS[32] + body)
    if len(word) < len(piece):
        parts.append(piece[len(word) :])
    return array("I", [token.id for part in parts for token in model.tokenize(part)]).tobytes()


def encode(texts: list[str], vocabulary: str = VOCABULARY) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    state = _worker_state(vocabulary)
    tokenizer, cache = state["tokenizer"], state["pieces"]
    texts = [text.encode("utf-8", "replace").decode() for text in texts]
    if len(cache) > CACHED_PIECES:
        # Frequent pieces come early: the older half stays.
        older = dict(islice(cache.items(), CACHED_PIECES // 2))
        cache.clear()
        cache.update(older)
    # Each piece is looked up once; `gaps` are the places of those not seen before.
    cuts: list[tuple[list[str], list[bytes | None], list[int]] | None] = []
    new: set[str] = set()
    for text in texts:
        pieces = None if any(token in text for token in state["added"]) else cut(text)
        if pieces is None:
            cuts.append(None)
            continue
        found = list(map(cache.get, pieces))
        gaps = list(compress(range(len(found)), map(not_, found)))
        new.update(map(pieces.__getitem__, gaps))
        cuts.append((pieces, found, gaps))
    if state["model"] is not None:
        words = {piece: _word_ids(piece, state["model"]) for piece in new}
        cache.update((piece, ids) for piece, ids in words.items() if ids)
        new = {piece for piece, ids in words.items() if not ids}
    fresh = list(filter(_alone, new))
    encoded = tokenizer.encode_batch_fast([_spelled(x) for x in fresh], add_special_tokens=False)
    cache.update(zip(fresh, [array("I", e.ids).tobytes() for e in encoded], strict=True))
    out, whole = [], []
    for i, parts in enumerate(cuts):
        if parts is not None:
            pieces, found, gaps = parts
            for at in gaps:
                found[at] = cache.get(pieces[at])
            if None not in found:
                out.append(b"".join(found))
                continue
        out.append(b"")
        if texts[i]:
            whole.append(i)
    for at in range(0, len(whole), WHOLE_BATCH):
        some = whole[at : at + WHOLE_BATCH]
        for i, e in zip(some, tokenizer.encode_batch_fast([texts[i] for i in some], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
    return out


def encoded_batches(batches, vocabulary: str, size: int = 200):
    """(doc ids, ids as bytes) of the Arrow batches, `size` documents at a time."""
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for at in range(0, len(ids), size):
            yield ids[at : at + size], encode(texts[at : at + size].to_pylist(), vocabulary)
