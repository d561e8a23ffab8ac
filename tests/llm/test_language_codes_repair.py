import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare_rows import normal

from tidemark.llm import centroid_lang, gnat_codes, turn_repair
from tidemark.llm.common import with_facts
from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_turn_repair"])
def test_equals_sql(spark, sf, duck, name):
    assert normal(QUERIES[name](spark, sf).toPandas()) == normal(duck.sql(ORACLES[name]).df())


def test_language_of_held_out_texts(spark, sf):
    rows = {r["doc_id"]: r for r in QUERIES["op11_language"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in held} == {k for k, r in rows.items() if r["held_out"]}
    spoken = [r for r in held if any(c.isalpha() for c in r["text"] or "")]
    assert np.mean([rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in spoken]) >= 0.97
    assert all((rows[r["doc_id"]]["lang_pred"] == "und") != any(c.isalpha() for c in r["text"] or "") for r in docs)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_counts_by_brute_force(monkeypatch):
    def plain(text):
        line = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        return Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1))

    text = "Ab, abba 12 Élan; ça-va? bb"
    names = plain(text)
    whole = centroid_lang.counts(text)
    assert whole.sum() == sum(names.values())
    lone = {}
    for gram in names:
        if " " not in gram and len(gram) == 1:
            lone[gram] = np.flatnonzero(centroid_lang.counts(gram) - centroid_lang.counts("q") > 0)
    assert all(any(whole[b] >= names[g] for b in spots) for g, spots in lone.items())
    for size in (1, 2, 3, 5):
        monkeypatch.setattr(centroid_lang, "SLICE", size)
        assert (centroid_lang.counts(text) == whole).all()
    assert centroid_lang.counts("12 _ -") is None and centroid_lang.counts(None) is None and centroid_lang.counts("a") is not None


def test_nearest_centroid_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = centroid_lang.learned(docs.filter("doc_id % 2 = 0"))
    assert Counter(model.langs).keys() == {"de", "en", "es", "fr"} and max(Counter(model.langs).values()) <= centroid_lang.CLUSTERS
    odd_docs = docs.filter("doc_id % 2 = 1").select("doc_id", "text")
    got = {r["doc_id"]: r for r in centroid_lang.predicted(odd_docs, model).collect()}
    for doc_id, text in odd_docs.collect():
        found = centroid_lang.counts(text)
        if found is None:
            assert got[doc_id]["lang_pred"] == "und"
            continue
        weighed = [np.log1p(c) * w for c, w in zip(found.tolist(), model.idf.tolist())]
        size = sum(w * w for w in weighed) ** 0.5
        cosines = [round(sum(w * c for w, c in zip(weighed, centroid)) / size, 9) for centroid in model.centroids.tolist()]
        assert got[doc_id]["lang_pred"] == model.langs[int(np.argmax(cosines))]
        assert abs(got[doc_id]["score"] - max(cosines)) < 1e-8


def test_language_edges(spark, odd, none, odd_rows):
    got = centroid_lang.identified(odd).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[9]["lang_pred"] == "und" and by[9]["rejected"] and by[9]["score"] == 0
    assert by[6]["lang_pred"] in ("en", "de") and centroid_lang.identified(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "text here", None)], "doc_id bigint, text string, lang string")
    assert [r["lang_pred"] for r in centroid_lang.identified(unlabelled).collect()] == ["und"]
    strange = spark.createDataFrame([(i, "the cat and the dog sat there " * 3, "en") for i in range(40)] + [(99, "qzx jqk wvz", None)], "doc_id bigint, text string, lang string")
    assert [r["doc_id"] for r in centroid_lang.identified(strange).filter("rejected").collect()] == [99]


def test_tree_equals_brute_force():
    rng = np.random.default_rng(3)
    for size, spread in [(64, 300), (64, 3), (1, 5), (5, 1), (17, 40), (64, 1)]:
        entries = rng.integers(-spread, spread + 1, (size, 4))
        points = rng.integers(-spread - 5, spread + 6, (500, 4))
        away = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        who, best, measured = gnat_codes.Gnat(entries).nearest(points)
        assert (who == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()
        assert measured <= away.size
    clustered = (rng.integers(-9, 10, (8, 4)) * 400)[np.arange(64) % 8] + rng.integers(-5, 6, (64, 4))
    assert gnat_codes.Gnat(clustered).nearest(clustered)[2] < 64 * 40
    large = np.array([[2**26, 0], [2**26 + 1, 0], [-(2**26), 1]])
    assert gnat_codes.Gnat(large).nearest(large)[0].tolist() == [0, 1, 2]


def plain_codes(vectors):
    """Codes and codebooks of integer vectors in order of id."""
    parts = vectors.reshape(len(vectors), 16, -1)
    books = [[list(parts[i, p]) for i in range(min(64, len(parts)))] for p in range(16)]
    assign = lambda: [[min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(books[p])) for p, v in enumerate(row)] for row in parts]
    for _ in range(2):
        found = assign()
        for p in range(16):
            for e in range(len(books[p])):
                mine = [parts[r, p] for r in range(len(parts)) if found[r][p][1] == e]
                if mine:
                    books[p][e] = [sum(map(int, x)) // len(mine) for x in zip(*mine)]
    return assign(), hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def test_codes_by_brute_force_and_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 32).tolist(), i % 3 if i % 7 else None, "x") for i in range(150)]
    rows += [(200 + i, rows[3][1], 9, "x") for i in range(60)]
    bad = [(300, None, 1, "x"), (301, [None] + [0.0] * 31, 1, "x"), (302, [float("nan")] * 32, 1, "x"), (303, [float("inf")] * 32, 1, "x")]
    shape = "vec_id bigint, embedding array<float>, label int, code string"
    table = spark.createDataFrame(rows + bad + [(304, [1.0], 5, "x"), (305, [], 5, "x")], shape).repartition(5)
    got = {r["vec_id"]: r for r in gnat_codes.codes(table).collect()}
    assert set(got) == {r[0] for r in rows} | {304, 305} and got[304]["code"] is None and got[305]["error"] is None
    whole = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(int)
    found, digest = plain_codes(whole)
    sums = Counter()
    for row, parts in zip(rows, found):
        sums[row[2]] += sum(d for d, _ in parts)
    for row, parts in zip(rows, found):
        mine = got[row[0]]
        assert mine["code"] == "".join(f"{e:02x}" for _, e in parts) and mine["error"] == sum(d for d, _ in parts)
        assert mine["label_error"] == sums[row[2]] and mine["codebooks_sha256"] == digest
    few = spark.createDataFrame([(1, [0.5] * 16, 1, ""), (1, [0.5] * 16, 1, ""), (None, [0.25] * 16, 1, "")], shape)
    assert [r["error"] for r in gnat_codes.codes(few).collect()] == [0, 0, 0]
    assert gnat_codes.codes(table.limit(0)).count() == 0
    with pytest.raises(Exception, match="too large"):
        gnat_codes.codes(spark.createDataFrame([(1, [3e38] * 16, 1, "")], shape)).count()


def test_facts_of_hot_and_null_keys(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id) END AS key")
    facts = rows.groupBy("key").count().selectExpr("key", "count AS n", "count * 2 AS twice")
    got = with_facts(rows, facts, ["key"], ["twice"])
    assert got.columns == ["id", "key", "twice"] and got.count() == 3000
    assert {(r["key"] or "")[:1]: r["twice"] for r in got.collect()} == {"h": 3000, "": 428, "k": 2}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tidemark.llm.common import scratch_dir

    def session(master, **conf):
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(session("local-cluster[3,2,1000]"))
    assert scratch_dir(session("yarn", **{"spark.checkpoint.dir": "hdfs:/work"})) == "hdfs:/work"


def plain_repair(rows):
    """(cost, audit, turns) by search over (cost, audit) with Dijkstra's rule, over whole audits."""
    want = {0: "u", 1: "u", 2: "a", 3: "u"}
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    seen, faults = set(), []
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    heap, least = [(0, "", 0, 0, ())], None
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if least is not None and (cost, audit) >= least[:2]:
            return least
        if i == len(rows) and state in (0, 3):
            least = (cost, audit, list(out))
            continue
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] in ("", "t"):
                extra = faults[i] == "t"
                if (state, role[:1]) in after:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, after[state, role[:1]], (*out, (role, text))))
                name = {"u": "user", "a": "assistant"}[want[state]]
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, after[state, want[state]], (*out, (name, text))))
        if cost < 3 * len(rows) + 4:
            name = {"u": "user", "a": "assistant"}[want[state]]
            heapq.heappush(heap, (cost + 2, audit + "I", i, after[state, want[state]], (*out, (name, ""))))
    return least


def test_repair_by_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), rng.choice(["a.", "b!", "c", " ", "d? \n", "e. x"])) for _ in range(rng.randrange(6))]
        cost, audit = turn_repair.cheapest([r[:1] for r, _ in rows], turn_repair.faults(rows))
        want = plain_repair(rows)
        assert (cost, audit) == want[:2], rows
        made = turn_repair.rebuilt(rows, audit)
        assert made == want[2] and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made))


def test_repair_edges(spark):
    shape = "conv_id bigint, turn bigint, role string, text string, cost int, audit string"
    rows = [(1, 0, "user", "a."), (1, 1, "assistant", "b."), (1, 1, "assistant", "b."), (1, 5, "user", "c"), (2, None, None, None), (None, 0, "user", "x."), (3, None, "user", "x. "), (3, 2, "assistant", "y!")]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], shape)
    got = {r["conv_id"]: r for r in turn_repair.repaired(table).collect()}
    assert got[1]["audit"] == "KKDD" and got[1]["cost"] == 6 and got[1]["gaps"] == 3 and got[1]["duplicate"] == got[1]["truncated"] == 1 and got[1]["illegal"] == 1
    assert got[2]["audit"] == "D" and got[2]["gaps"] == 0 and got[2]["blank"] == 1 and got[2]["turns"] == []
    assert got[None]["audit"] == "KI" and [tuple(t) for t in got[None]["turns"]] == [("user", "x."), ("assistant", "")]
    assert got[3]["audit"] == "KK" and got[3]["gaps"] == 0
    assert turn_repair.repaired(table.limit(0)).count() == 0
    long = spark.range(600).selectExpr("7 AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('turn ', id, '.') AS text")
    assert turn_repair.repaired(long).first()["audit"] == "K" * 600
    damaged = turn_repair.damaged(long)
    assert turn_repair.repaired(damaged).count() == 1 and damaged.filter("copies = 2").count() > 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    lost = turn_repair.digests(turn_repair.repaired(turn_repair.damaged(spark.createDataFrame([(gone, 0, "user", "x.", 1, "")], shape)))).first()
    assert lost["audit"] == "" and lost["cost"] == 0 and lost["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
