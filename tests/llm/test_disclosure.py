"""Operator 11: base spans against the plain patterns, disclosing terms by brute force."""

import hashlib
import math
import random
import re
import time

import pytest

from tonemark.llm import disclosure, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d // 10 + d % 10 for d in doubled)) % 10 == 0


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{['email', 'ip', 'card', 'phone', 'term'][k]}:{a}:{b}" for a, k, b in spans)


CASES = [
    "", "@", "a@b", "a@b.c", "a@b.c.", "x a@b.c.d@e.f y", "a@@b.c", "é@b.c", "aé.x@b-c.d_e", "..@-.-", "a@b..c", "%@x.y@z.w",
    "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "0001.002.255.0", "1.2.3", "1111.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1111 1",
    "4111  1111 1111 1111", "+1 (377) 555-0271", "+1", "++12 345 678 90", "+1234567890123456", "+1((((", "+12-4111 1111 1111 1111",
    "0" * 14, "0" * 19, "0" * 20, "1.1.1.1@1.1.1.1", "٣٣٣.1.1.1",
]


def test_entities_are_those_of_the_patterns():
    rng = random.Random(3)
    drawn = ["".join(rng.choices("a1@.-+ ()_%é4", k=rng.randint(0, 60))) for _ in range(4000)]
    drawn += ["".join(rng.choices("0123456789 -", k=40)) for _ in range(2000)]
    for text in CASES + drawn:
        assert [(a, k, b) for a, k, b, _ in disclosure.entities(text)] == plain_spans(text), text


def test_long_texts_take_linear_time():
    began = time.time()
    for unit in ("1", "1.", "a", "@", "+1", "a@", "1 ", "+(", "a.b@c-", "1.2.3."):
        disclosure.entities(unit * 1_000_000)
    assert time.time() - began < 60


def secret_rows():
    rng = random.Random(5)
    words = [f"common{k}" for k in range(40)]
    rows = []
    for k in range(300):
        rows.append((k, " ".join(rng.choices(words, k=30))))
    for k in range(8):  # frodo and its like stand beside the address only; ring stands elsewhere too.
        some = " ".join(rng.choices(words, k=5))
        rows.append((1000 + k, f"{some} Frodo sent the ring from bag.end0@shire.example.com to {rng.choice(words)} with samwise{k % 2}"))
    rows += [(2000 + k, f"a ring for {rng.choice(words)}") for k in range(60)]
    rows += [(2500 + k, f"a samovar for {rng.choice(words)}") for k in range(100)]
    # Copies of one passage are one surrounding.
    rows += [(3000 + k, "only gandalf knows 10.1.2.3 by heart") for k in range(50)]
    rows += [(4000, "frodo without an address"), (None, "Frodo wrote to bag.end0@shire.example.com"), (4001, None), (4002, "")]
    rows += [(1000, rows[300][1])]
    return rows


def brute(rows, level, support):
    """{row number: flagged words} by plain counting."""
    n = len(rows)
    near, df, holders = {}, {}, {}
    for k, (_, text) in enumerate(rows):
        text = text or ""
        words = {w.lower() for w in re.findall(r"[^\W_]+", text)}
        for w in words | {w[:3] + "*" for w in words if len(w) > 3}:
            df[w] = df.get(w, 0) + 1
        spans = plain_spans(text)
        free = [m for m in re.finditer(r"[^\W_]+", text) if not any(a < m.end() and m.start() < b for a, _, b in spans)]
        for a, _, b in spans:
            entity = text[a:b].lower()
            holders.setdefault(entity, set()).add(k)
            before = [m[0].lower() for m in free if m.start() < a][-10:]
            after = [m[0].lower() for m in free if m.start() >= a][:10]
            for w in before + after:
                for name in [w] + [w[:3] + "*"] * (len(w) > 3):
                    near.setdefault((entity, name), {}).setdefault(k, " ".join(before + after))

    def share(e, w):
        pair = near.get((e, w), {})
        if len(set(pair.values())) < support:
            return None
        return math.log2(n * len(pair) / (df[w] * len(holders[e]))) / math.log2(n / len(holders[e]))

    flagged = {}
    for (e, w), where in near.items():
        if not w.endswith("*") and (s := share(e, w)) is not None and s >= level:
            wide = share(e, w[:3] + "*") if len(w) > 3 else None
            for k in where:
                flagged.setdefault(k, {}).setdefault(w, []).append(wide is not None and wide < level)
    return {k: {w: all(v) for w, v in ws.items()} for k, ws in flagged.items()}


def compare(spark, rows, level=disclosure.DISCLOSURE, support=disclosure.SUPPORT):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base", "2 AS near", "3 AS packed", "4 AS d")
    got = sorted(map(tuple, disclosure.clean(frame, True, level, support).collect()), key=str)
    flagged = brute(rows, level, support)
    want = []
    for k, (doc_id, text) in enumerate(rows):
        text, words = text or "", flagged.get(k, {})
        base = plain_spans(text)
        terms = [
            (m.start(), 4, m.end()) for m in re.finditer(r"[^\W_]+", text)
            if m[0].lower() in words and not any(a < m.end() and m.start() < b for a, _, b in base)
        ]
        counts = [sum(kind == c for _, kind, _ in base) for c in range(4)]
        general = sum(words[text[a:b].lower()] for a, _, b in terms)
        marks, out, at = sorted([(a, b, f"[{['EMAIL', 'IP', 'CARD', 'PHONE'][c]}]") for a, c, b in base]
                                + [(a, b, text[a:a + 3] + "*" if words[text[a:b].lower()] else "[TERM]") for a, _, b in terms]), "", 0
        for a, b, mark in marks:
            if a >= at:
                out += text[at:a] + mark
            at = max(at, b)
        want.append((doc_id, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + terms)), len(terms), general, out + text[at:]))
    assert got == sorted(want, key=str)
    return flagged


def test_terms_by_brute_force(spark):
    rows = secret_rows()
    flagged = compare(spark, rows)
    assert any("frodo" in ws for ws in flagged.values())
    assert any(ws.get("samwise0") for ws in flagged.values())
    assert not any("ring" in ws or "gandalf" in ws for ws in flagged.values())
    texts = {t: s for t, s in zip([t for _, t in rows], range(len(rows)))}
    assert texts["frodo without an address"] not in flagged


@pytest.mark.parametrize("level, support", [(0.6, 2), (0.3, 1)])
def test_terms_at_other_thresholds(spark, level, support):
    flagged = compare(spark, secret_rows(), level, support)
    assert len(flagged) > 5


def test_odd_tables(odd, none):
    rows = disclosure.clean(odd, with_text=False).collect()
    assert len(rows) == odd.count() and all(r.spans is not None for r in rows)
    assert disclosure.clean(none).collect() == []


def test_op11_query(spark, sf):
    rows = {r.doc_id: r for r in queries.QUERIES["op11_disclosure"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base = plain_spans(r.text or "")
        got = rows.pop(r.doc_id)
        assert got.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert set(listed(base).split(",")) <= set(got.spans.split(","))
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(k == c for _, k, _ in base) for c in range(4)]
    assert not rows
