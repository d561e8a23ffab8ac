"""Fingerprints, likeness and repeats once more, letter by letter and without the library's hashes in between."""

from collections import defaultdict

from tidemark.llm.queries import QUERIES

M32, M64 = 2**32 - 1, 2**64 - 1
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def stirred(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ x >> shift) * factor & M64
    return x


def rolled(text, i):
    h = sum(ord(text[i - back]) * pow(0x01000193, back, 1 << 32) for back in range(min(7, i + 1))) & M32
    h = (h ^ h >> 15) * 0x2C1B3C6D & M32
    return h ^ h >> 13


def fingerprint(text):
    block = 4
    while block * 64 < len(text):
        block *= 2
    if not text:
        return f"{block}::"
    hashes = [rolled(text, i) for i in range(len(text))]

    def pieces(size):
        out, start = [], 0
        for i, h in enumerate(hashes):
            if h % size == size - 1 and len(out) < 63:
                out.append(text[start : i + 1])
                start = i + 1
        return [*out, text[start:]] if start < len(text) else out

    while block > 4 and len(pieces(block)) < 32:
        block //= 2
    letter = lambda piece: ALPHABET[stirred(sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(piece)) & M64) >> 58]
    return f"{block}:{''.join(map(letter, pieces(block)))}:{''.join(map(letter, pieces(2 * block)))}"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def likeness(a, b):
    (n, a1, a2), (m, b1, b2) = a.split(":"), b.split(":")
    score = lambda x, y: 1 - edits(x, y) / max(len(x), len(y)) if x or y else 1.0
    if a == b:
        return 1.0
    pairs = [(a1, b1), (a2, b2)] if n == m else [(a1, b2)] if int(n) == 2 * int(m) else [(a2, b1)] if int(m) == 2 * int(n) else []
    return max((score(x, y) for x, y in pairs), default=0.0)


def test_fingerprints_letter_by_letter(spark, sf, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op9_fingerprints"](spark, sf).collect()}
    order = sorted(((i, t or "") for i, t in texts), reverse=True)
    prints = {i: fingerprint(t) for i, t in order}
    for (doc_id, text), (after_id, after) in zip(order, order[1:] + order[:1]):
        half, row = len(text) // 2, rows[doc_id]
        edited = fingerprint(text[: len(text) - half] + after[:half])
        assert (row["fingerprint"], row["edited_fingerprint"]) == (prints[doc_id], edited)
        assert abs(row["near_edited"] - likeness(prints[doc_id], edited)) < 1e-12
        assert abs(row["near_next"] - likeness(prints[doc_id], prints[after_id])) < 1e-12


def test_every_repeat_of_a_hundred_code_points(spark, sf, texts):
    first, later = {}, defaultdict(set)
    for doc_id, text in sorted((i, t or "") for i, t in texts):
        for at in range(len(text) - 99):
            if first.setdefault(text[at : at + 100], (doc_id, at)) != (doc_id, at):
                later[doc_id].update(range(at, at + 100))
    found = defaultdict(set)
    for r in QUERIES["op10_substring_dedup"](spark, sf).collect():
        found[r["doc_id"]].update(range(r["start"], r["end"]))
    want = sum(map(len, later.values()))
    assert want > 10_000 and sum(len(found[d] & p) for d, p in later.items()) == want
    assert sum(len(p - later[d]) for d, p in found.items()) <= 0.02 * want
