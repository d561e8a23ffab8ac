import hashlib
import random
import re
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import bpe, ctph, gear_chunks, pii
from tidemark.llm.queries import QUERIES
from tidemark.llm.rolling import code_points

PATH = public_tokenizers.path("word_bpe_49k.json")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((kind, *m.span()))
    return out


def test_base_spans_by_brute_force(spark, sf, texts):
    got = {r["doc_id"]: r for r in QUERIES["op1_personal_data"](spark, sf).collect()}
    for doc_id, text in texts:
        spans = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(text))
        assert got[doc_id]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert got[doc_id]["spans"].startswith(spans)
        assert got[doc_id]["n_email"] == spans.count("email:") and got[doc_id]["n_phone"] == spans.count("phone:")
    random.seed(2)
    for _ in range(4000):
        letters = random.choice(["ab@.c-", "0123. ", "+0123 ()-.", "0 4-", "a1@.+ é"])
        text = "".join(random.choice(letters) for _ in range(random.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text)


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"write to u{i}@mail.example.com now") for i in range(12)] + [(20, "write to acct-9941x now")]
    rows += [(40 + i, f"year {1990 + i}1 ended") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: [x["kind"] for x in r["found"]] for r in pii.personal_spans(docs).collect()}
    assert got[20] == ["found"] and not any(got[40 + i] for i in range(9)) and not got[0]
    out = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert out[20] == "write to [FOUND] now" and out[0] == "write to [EMAIL] now" and out[40] == "year 19901 ended"


def test_pii_edges(odd, none, odd_rows):
    out = pii.redacted(odd)
    assert out.columns == odd.columns and out.count() == len(odd_rows)
    text = out.filter("doc_id = 10").first()["text"]
    assert text == "mail [EMAIL] or [PHONE] é <s>[INST]"
    assert pii.redacted(none).count() == 0 and pii.personal_spans(none).count() == 0


def test_bpe_equals_the_library(spark, sf, texts, odd, none):
    library = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r for r in QUERIES["op6_bpe"](spark, sf).collect()}
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = got[doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    model = bpe.RankBpe(PATH)
    for text in ["", " ", "ΣΑΣ ΟΔΟΣ İ", "é", "<|endoftext|> a<|startoftext|>", "a\x1cb\x85c", "it's THEY'LL", "abc" * 500, "日本🙂", "x ́y"]:
        out = array("i")
        model.encode(text, out)
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(out) == ids and model.decode(ids) == library.decode(ids, skip_special_tokens=False)
    made = bpe.encode(odd, PATH)
    assert set(made.columns) == set(odd.columns) and made.count() == 12 and bpe.encode_decode(none, PATH).count() == 0
    assert bpe.decode(bpe.encode(odd.select("doc_id", "text"), PATH), PATH).filter("doc_id = 3").first()["decoded"].startswith("w</w>")


def test_fingerprints(spark, sf, texts, odd, none):
    rows = {r["doc_id"]: r for r in QUERIES["op9_fingerprints"](spark, sf).collect()}
    order = sorted(texts, reverse=True)
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = rows[doc_id]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == ctph.fingerprint(code_points(text)) and row["edited_fingerprint"] == ctph.fingerprint(code_points(edited))
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    near = np.mean([r["near_edited"] for r in rows.values() if r["n_chars"] > 2000])
    far = np.mean([r["near_next"] for r in rows.values() if r["n_chars"] > 2000])
    assert near > far + 0.2
    assert ctph.compared(odd).count() == 12 and ctph.compared(none).count() == 0
    small = ctph.with_edits(odd.filter("doc_id = 10")).first()
    assert small["fingerprint"] == small["next_fingerprint"]
    many = spark.range(50).selectExpr("id * id as doc_id", "concat('text ', id) as text")
    a = {r["doc_id"]: r["edited_sha256"] for r in ctph.with_edits(many).collect()}
    placed = ctph.ranged(many, "doc_id", "text", rows_per_bucket=3)
    assert placed.filter("ahead = 1").count() > 10 and len(a) == 50


def test_chunks_shift_and_planted_passages(spark, odd, none, odd_rows):
    random.seed(4)
    text = "".join(random.choice("abcdefgh ") for _ in range(3000))
    ends = gear_chunks.cuts(code_points(text))
    moved = gear_chunks.cuts(code_points("inserted" + text))
    assert len(set(ends + 8) - set(moved)) <= 4 and min(np.diff(ends[:-1])) > gear_chunks.REACH
    spans = gear_chunks.repeated_spans(odd).collect()
    by = defaultdict(list)
    for r in spans:
        by[r["doc_id"]].append(r)
    assert 8 in by and by[8][0]["first_doc_ids"] == [7] and 7 not in by and 10 not in by
    assert by[4][0]["first_doc_ids"] == [3] and 3 not in by
    passage = dict((i, t) for i, t, _, _ in odd_rows)[8]
    assert all(passage[r["start"] : r["end"]] in dict((i, t) for i, t, _, _ in odd_rows)[7] for r in by[8])
    cut = gear_chunks.without_spans(odd, gear_chunks.repeated_spans(odd))
    assert cut.columns == odd.columns and cut.count() == 12
    left = cut.filter("doc_id = 8").first()["text"]
    assert len(left) == len(passage) - sum(r["n_chars"] for r in by[8])
    assert gear_chunks.repeated_spans(none).count() == 0


def test_short_periodic_own_and_null_id_repeats(spark):
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n))
    short = " ".join(rng.choice(["a", "on", "to", "be", "it", "x"]) + rng.choice("abcdefgh") for _ in range(51))
    tight = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(51))
    shared = [short, tight, *((x * 200)[:600] for x in ("na ", "yes no ", "| - | ", "x"))]
    rows = []
    for i, passage in enumerate(shared):
        rows += [(10 * i, noise(300) + passage + noise(300)), (10 * i + 1, noise(90) + passage + noise(400))]
    own, lone, same = noise(200), noise(200), noise(150)
    rows += [(900, noise(80) + own + noise(70) + own), (None, noise(50) + lone), (None, noise(120) + lone), (950, same), (950, same)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = gear_chunks.repeated_spans(docs)
    got = defaultdict(list)
    for r in spans.collect():
        got[r["doc_id"]].append(r)
    texts = dict(rows)
    for i, passage in enumerate(shared):
        at = texts[10 * i + 1].index(passage)
        covered = {p for r in got[10 * i + 1] for p in range(r["start"], r["end"])}
        assert set(range(at, at + len(passage))) <= covered, passage
        assert len(covered) <= len(passage) + 20 and [10 * i] == [x for r in got[10 * i + 1] for x in r["first_doc_ids"] if x != 10 * i + 1]
    assert got[900][0]["end"] == 550 and abs(got[900][0]["start"] - 350) <= 8 and got[900][0]["first_doc_ids"] == [900]
    assert len(got[None]) == 1 and got[None][0]["n_chars"] >= 200 and got[None][0]["first_doc_ids"] == [None]
    assert [(r["start"], r["end"]) for r in got[950]] == [(0, 150)]
    left = sorted(len(r["text"]) for r in gear_chunks.without_spans(docs, spans).filter("doc_id = 950").collect())
    assert left == [0, 150]


def test_a_text_whose_only_boundary_is_its_start(spark):
    rng, short = random.Random(0), ""
    while list(gear_chunks.marks(code_points(short))) != [0]:
        short = "".join(rng.choice("abcdefghij ") for _ in range(100))
    docs = spark.createDataFrame([(1, short), (2, "some words before it " + short + " and after"), (3, short)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["start"], r["end"], *r["first_doc_ids"]) for r in gear_chunks.repeated_spans(docs).collect()}
    assert got == {(2, 21, 121, 1), (3, 0, 100, 1)}


def test_trust_runs_to_its_end_and_keys_are_whole(spark):
    rows = [(f"s{i}", True, ["p0"]) for i in range(30)]
    rows += [(f"v{step}-{i}", False, [f"p{step}", f"p{step + 1}"]) for step in range(6) for i in range(5)]
    marks = spark.createDataFrame(rows, "value string, seed boolean, patterns array<string>")
    assert pii.trusted_values(marks, min_trust=0.4).count() == 30
    text = "to a.b@example.com,c.d@example.com now " + "7" * 250 + "x and " + "7" * 250 + "y"
    made = pii.instances(text, pii.base_spans(text))
    assert [text[s:e] for s, e, _, seed, _ in made if seed] == ["a.b@example.com", "c.d@example.com"]
    assert len({value for _, _, value, seed, _ in made if not seed}) == 2
