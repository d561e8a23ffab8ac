"""Identifiers without a digit or of several tokens, hidden among the documents and found by where they stand."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import pii

FRAMES = [("write to {} or wait", 0), ("contact: {} (office)", 0), ("signed {} of staff", 0)]
NAMES = ["Ann Lee", "jo_marsh", "ann at mail dot com", "K. Oduya", "maria-de-la-cruz", "Li", "pat at site dot org", "Sam van Dyke"]


def test_hidden_identifiers_in_documents(spark, sf, texts):
    """Recall and precision of found spans over all documents of the table, each with a frame put in: nine
    in ten with a seed, one in ten with an identifier that no base pattern matches (a frame is trusted up to one
    unseen value in five, so twice as many would lie at that bound); every third document
    gets an everyday frame that seeds share with many words instead."""
    draw, rows, hidden, everyday = random.Random(5), [], {}, 0
    for doc_id, text in texts:
        body = (text or "").split(" ")
        at = draw.randrange(len(body) + 1)
        if doc_id % 3 == 0:
            put, everyday = draw.choice([f"and u{doc_id}@mail.example.com the", *(f"and {w} the" for w in ("then", "all of", "other things", "what"))]), everyday + 1
        else:
            frame = draw.choice(FRAMES)[0]
            secret = doc_id % 10 == 0
            put = frame.format(draw.choice(NAMES) if secret else f"user{doc_id}@mail{doc_id % 7}.example.com")
            if secret:
                hidden[doc_id] = (" ".join(body[:at]) + " " if at else "", put, frame.index("{"), len(put) - len(frame) + 2)
        rows.append((doc_id, " ".join([*body[:at], put, *body[at:]])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r["doc_id"], x["start"], x["end"]) for r in pii.personal_spans(docs).collect() for x in r["found"]}
    want = {(d, len(head) + at, len(head) + at + n) for d, (head, _, at, n) in hidden.items()}
    assert len(want) > 10 and everyday > 10
    assert len(want & found) >= 0.95 * len(want)
    assert len(want & found) >= 0.95 * len(found)


def plain_frame(words):
    return ((pii._code(words[0]) << 2 if len(words) == 3 else 0) ^ (pii._code(words[-2]) << 1) ^ pii._code(words[-1])) & (2**64 - 1)


def test_fillers_by_plain_loops():
    draw = random.Random(3)
    for _ in range(200):
        text = " ".join(draw.choice(["a", "b.", "(c", "dd", "...", "É,"]) for _ in range(draw.randrange(12)))
        wanted = {("a", "b"), ("dd", "c"), ("é", "a"), ("a", "dd", "b"), ("c", "a", "é")}
        frames = {plain_frame(words) for words in wanted}
        bits = np.zeros(1 << pii.MAP_BITS >> 3, np.uint8)
        for f in frames:
            low = f & ((1 << pii.MAP_BITS) - 1)
            bits[low >> 3] |= 1 << (low & 7)
        words, at = text.split(" ") if text else [], 0
        spots = []
        for w in words:
            spots.append((at, w))
            at += len(w) + 1
        bare = [w.strip(pii._EDGE).lower() for w in words]
        want = set()
        for i in range(len(words)):
            for j in range(i + 2, min(len(words), i + pii.MOST_TOKENS + 2)):
                inner = bare[i + 1 : j]
                if ((bare[i], bare[j]) in wanted or i and (bare[i - 1], bare[i], bare[j]) in wanted) and inner[0] and inner[-1] and bare[i] not in inner and bare[j] not in inner:
                    s, e = spots[i + 1], spots[j - 1]
                    want.add((s[0] + len(s[1]) - len(s[1].lstrip(pii._EDGE)), e[0] + len(e[1].rstrip(pii._EDGE))))
        assert {x for _, s, e in pii._fillers(text, bits, pii._Codes(), True) for x in zip(s.tolist(), e.tolist())} == want


def test_frames_are_the_same_in_spark_and_python(spark):
    pairs = [["write", "or"], ["é", "z"], ["|", "|"], ["日本", "x" * 90], ["write", "to", "or"]]
    df = spark.createDataFrame([(x,) for x in pairs], "words array<string>").select("words", pii._frame(F.col("words")).alias("frame"))
    for words, frame in df.collect():
        assert frame & (2**64 - 1) == plain_frame(words)
    bits = pii._bit_map(df)
    assert all(bits[(r["frame"] & (1 << pii.MAP_BITS) - 1) >> 3] >> (r["frame"] & 7) & 1 for r in df.collect()) and int(np.unpackbits(bits).sum()) == len(pairs)
