"""Operator 11: personal data, and the terms that give it away.

E-mail addresses, IP addresses, card numbers and phone numbers are found by form and are the
protected entities. How much a term tells of an entity is estimated from the whole corpus:

1. One scan finds the entities of every document. Each word within `WINDOW` words of a
   mention is paired with the entity, once a document. Documents with a mention keep their
   packed text; the others are done.
2. Pairs are counted over all documents. Those seen in at least `SUPPORT` different
   surroundings (copies of one passage are one) are candidates.
3. A second scan counts the documents that hold each candidate term. A bit table of fixed
   size tells which words of a text need a look; a join on the term settles the rest.
4. With N documents, c(e) with the entity, c(t) with the term and c(t, e) with the pair, the
   term gives away log2(N c(t, e) / (c(t) c(e))) of the entity's log2(N / c(e)) bits. From a
   share of `DISCLOSURE` on, every occurrence of the term in documents that mention the
   entity nearby goes: it is generalised to its first `PREFIX` letters if that class of words
   stays below the share, and removed otherwise.

Counts are combined before they are shuffled, and pairs are joined back with a hot pair's
rows spread over tasks, so an entity in a third of all documents has no task of its own.

Defined results: null and empty texts hold nothing; a text is read whole, in time linear in its
length; rows equal in doc_id and text have equal spans, and count as documents of their own; an
entity that every document mentions cannot be given away; an empty table gives no rows; other
columns are ignored. Terms and entities are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark.llm.common import KEY, staged
from tonemark.operators.scale import lookup_join

KINDS = ["email", "ip", "card", "phone"]
WINDOW = 10
SUPPORT = 3
DISCLOSURE = 0.9
PREFIX = 3
BITS = 1 << 23
_HELD = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number's later digits cannot begin a match where its first could not.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W_]+")


# --- entities --------------------------------------------------------------------


def _emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        begin = at
        while domain and begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at:
            free = domain.end()
            out.append((begin, free))
        at = text.find("@", at + 1)
    return out


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def entities(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind in `KINDS`, end, value) in order."""
    found = [(a, 0, b, text[a:b].lower()) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), 1, m.end(), m[0]) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _digits(m[0])
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end(), digits))
        if "+" in text:
            for m in _PHONE.finditer(text):
                digits = _digits(m[0])
                if 10 <= len(digits) <= 15:
                    found.append((m.start(), 3, m.end(), digits))
    return sorted(found)


def _hashed(name: str) -> int:
    value = xxhash.xxh3_64_intdigest(name.encode("utf-8", "replace"))
    return value - (1 << 64) if value >> 63 else value


def term(word: str) -> int:
    return _hashed(word.lower())


def wider(word: str) -> int | None:
    """The class of words that begin like this one; short words have none."""
    return _hashed("\0" + word.lower()[:PREFIX]) if len(word) > PREFIX else None


def plain_words(text: str, found) -> list[tuple[int, int]]:
    """Places of the words outside all entities."""
    out, k, reach = [], 0, 0
    for m in _WORD.finditer(text):
        while k < len(found) and found[k][0] < m.end():
            reach = max(reach, found[k][2])
            k += 1
        if m.start() >= reach:
            out.append(m.span())
    return out


def near_pairs(text: str, found) -> list[tuple[int, int, int | None, int]]:
    """(entity, term, the term's class, surroundings) of every pair once, classes as terms of their own."""
    places = plain_words(text, found)
    starts = [a for a, _ in places]
    hashed: dict[str, tuple[int, int | None]] = {}
    out: dict[tuple[int, int], tuple[int | None, int]] = {}
    for begin, kind, _, value in found:
        entity = _hashed(f"{KINDS[kind]}:{value}")
        at = bisect_left(starts, begin)
        around = [text[a:b].lower() for a, b in places[max(0, at - WINDOW) : at + WINDOW]]
        context = _hashed(" ".join(around))
        for word in around:
            if word not in hashed:
                hashed[word] = term(word), wider(word)
            own, family = hashed[word]
            out.setdefault((entity, own), (family, context))
            if family is not None:
                out.setdefault((entity, family), (None, context))
    return [(e, t, family, context) for (e, t), (family, context) in out.items()]


def listed(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


# --- scans -----------------------------------------------------------------------

_COUNTS = [f"n_{k}" for k in KINDS]
_NEAR = pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64()), ("family", pa.int64()), ("context", pa.int64())]))
_SCANNED = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int64()) for c in KEY), *((c, pa.int64()) for c in _COUNTS)]
    + [("base", pa.string()), ("packed", pa.binary()), ("near", _NEAR), ("named", pa.list_(pa.int64()))]
)


def scanned(docs: DataFrame, keep_texts: bool) -> DataFrame:
    """Entities of every document; pairs, and the packed text, of those with one."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in part.column("text").to_pylist():
                    found = entities(text)
                    counts = [sum(f[1] == k for f in found) for k in range(len(KINDS))]
                    base = listed((a, KINDS[k], b) for a, k, b, _ in found)
                    packed = packer.compress(text.encode("utf-8", "replace")) if found or keep_texts else None
                    near = [dict(zip(("e", "t", "family", "context"), p, strict=True)) for p in near_pairs(text, found)] if found else None
                    named = sorted({_hashed(f"{KINDS[k]}:{v}") for _, k, _, v in found}) if found else None
                    rows.append((*counts, base, packed, near, named))
                columns = [pa.array(c, _SCANNED.field(k + 3).type) for k, c in enumerate(zip(*rows, strict=True))]
                yield pa.record_batch([*(part.column(c) for c in ("doc_id", *KEY)), *columns], schema=_SCANNED)

    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("th"), text.alias("text")
    )
    schema = (
        f"doc_id long, d long, th long, {', '.join(f'{c} long' for c in _COUNTS)}, base string, packed binary, "
        "near array<struct<e: long, t: long, family: long, context: long>>, named array<long>"
    )
    return keyed.mapInArrow(run, schema)


def holding(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """t and c_t: how many documents hold each wanted term or class."""
    place = F.col("t").bitwiseAND(F.lit(BITS - 1))
    # At most BITS / 32 rows, whatever the terms.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(31)).cast("int"))
    words = wanted.groupBy(F.shiftright(place, 5).alias("word")).agg(F.bit_or(bit).alias("bits"))
    table = np.zeros(BITS >> 5, np.uint32)
    for r in words.collect():
        table[r["word"]] = r["bits"]

    def run(batches):
        held: dict[int, int] = {}

        def out():
            done = pa.record_batch([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())], ["t", "n"])
            held.clear()
            return done

        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = {w.lower() for w in set(_WORD.findall(text or ""))}
                names = [_hashed(w) for w in words]
                names += [_hashed("\0" + p) for p in {w[:PREFIX] for w in words if len(w) > PREFIX}]
                t = np.array(names, np.int64)
                at = t & (BITS - 1)
                for name in t[(table[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1].tolist():
                    held[name] = held.get(name, 0) + 1
                if len(held) > _HELD:
                    yield out()
        yield out()

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "t long, n long")
    return wanted.join(counted.groupBy("t").agg(F.sum("n").alias("c_t")), "t")


def share(n: Column, together: Column, c_t: Column, c_e: Column) -> Column:
    """The share of an entity's information that a term gives away; null where it has none."""
    told = F.log2(n.cast("double") * together / (c_t.cast("double") * c_e))
    return told / F.nullif(F.log2(n.cast("double") / c_e), F.lit(0.0))


def disclosing(docs: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """e, t, together and general: the terms that give an entity away."""
    near = found.filter("near is not null").select(F.inline("near"))
    pairs = (
        near.groupBy("e", "t", "family", "context")
        .agg(F.count("*").alias("n"))
        .groupBy("e", "t", "family")
        .agg(F.sum("n").alias("together"), F.count("*").alias("contexts"))
        .filter(F.col("contexts") >= support)
    )
    pairs = staged(pairs, "candidate-pairs")
    named = found.filter("named is not null").select(F.explode("named").alias("e")).groupBy("e").agg(F.count("*").alias("c_e"))
    total = F.lit(found.count())
    rated = (
        pairs.join(holding(docs, pairs.select("t").distinct()), "t")
        .join(named, "e")
        .select("e", "t", "family", "together", share(total, F.col("together"), F.col("c_t"), F.col("c_e")).alias("share"))
    )
    rated = staged(rated, "rated-pairs")
    classes = rated.select("e", F.col("t").alias("family"), F.col("share").alias("class_share"))
    return (
        rated.filter(F.col("share") >= disclosure)
        .join(classes, ["e", "family"], "left")
        .select("e", "t", "together", F.coalesce(F.col("class_share") < disclosure, F.lit(False)).alias("general"))
    )


# --- the result ------------------------------------------------------------------

_OUT = (
    f"doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, base_sha256 string, spans string, "
    "n_terms long, n_generalised long, sanitised string"
)


def sanitised(text: str, found, terms: list[tuple[int, int, bool]]) -> str:
    """The text with entities named by kind, terms cut to their class or removed."""
    marks = [(a, b, f"[{KINDS[k].upper()}]") for a, k, b, _ in found]
    marks += [(a, b, text[a : a + PREFIX] + "*" if general else "[TERM]") for a, b, general in terms]
    out, at = [], 0
    for a, b, mark in sorted(marks):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def clean(
    docs: DataFrame, with_text: bool = True, disclosure: float = DISCLOSURE, support: int = SUPPORT
) -> DataFrame:
    """One row per document: counts, spans and the sanitised text."""
    found = staged(scanned(docs, with_text), "entities")
    told = disclosing(docs, found, disclosure, support)
    near = found.filter("near is not null").select(*KEY, F.inline("near")).select(*KEY, "e", "t")
    hits = lookup_join(near, told, ["e", "t"], count_col="together", spread_by="d", row_bytes=40)
    gone = hits.groupBy(*KEY, "t").agg(F.min("general").alias("general")).groupBy(*KEY).agg(F.collect_list(F.struct("t", "general")).alias("gone"))

    def run(batches):
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for base, packed, gone in zip(*(part.column(c).to_pylist() for c in ("base", "packed", "gone")), strict=True):
                    text = opened.decompress(packed).decode() if packed is not None else None
                    terms, spans, clean_text = [], base, None
                    if gone or with_text:
                        held = entities(text) if base else []
                        general = {g["t"]: g["general"] for g in gone or ()}
                        places = plain_words(text, held) if gone else []
                        terms = [(a, b, general[t]) for a, b in places if (t := term(text[a:b])) in general]
                        both = sorted([(a, k, b) for a, k, b, _ in held] + [(a, len(KINDS), b) for a, b, _ in terms])
                        spans = listed((a, [*KINDS, "term"][k], b) for a, k, b in both)
                        clean_text = sanitised(text, held, terms) if with_text else None
                    name = hashlib.sha256(base.encode()).hexdigest()
                    rows.append((name, spans, len(terms), sum(g for *_, g in terms), clean_text))
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                kept = ["doc_id", *_COUNTS]
                yield pa.record_batch(
                    [*(part.column(c) for c in kept), *columns],
                    [*kept, "base_sha256", "spans", "n_terms", "n_generalised", "sanitised"],
                )

    columns = ["doc_id", *_COUNTS, "base", "packed"]
    plain = found.filter("near is null").select(*columns, F.lit(None).cast("array<struct<t: long, general: boolean>>").alias("gone"))
    marked = found.filter("near is not null").join(gone, KEY, "left").select(*columns, "gone")
    out = plain.unionByName(marked).mapInArrow(run, _OUT)
    return out if with_text else out.drop("sanitised")
