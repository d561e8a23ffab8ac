import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import kneser_ney, overlap_join
from tidemark.llm.components import components
from tidemark.llm.queries import QUERIES


def plain_components(docs, width, num):
    sets = {}
    for i, text in docs:
        words = (text or "").encode().lower().split()
        k = min(width, len(words))
        sets[i] = frozenset(tuple(words[j : j + k]) for j in range(len(words) - k + 1)) if words else frozenset()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    lists = defaultdict(set)
    for i, s in sets.items():
        for e in s:
            lists[e].add(i)
    for i, s in sets.items():
        common = defaultdict(int)
        for e in s:
            for j in lists[e]:
                if j < i:
                    common[j] += 1
        for j, c in common.items():
            if 100 * c >= num * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_join_by_brute_force(spark, sf, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op7_overlap_join"](spark, sf).collect()}
    assert got == plain_components(texts, 3, 90)


def test_join_of_small_sets_chains_and_crowds(spark):
    random.seed(7)
    rows = []
    for i in range(300):
        n = random.choice([1, 2, 9, 10, 11, 12, 20, 21, 22, 30, 45])
        words = [f"w{j}" for j in range(n)]
        for _ in range(random.choice([0, 0, 1])):
            words[random.randrange(n)] = f"x{random.randrange(4)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"h{j}" if j != i % 60 else f"y{i}" for j in range(60))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for width, num in ((3, 90), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in overlap_join.near_copies(docs, width, num).collect()}
        assert got == plain_components(rows, width, num)


def test_boundary_follows_cost():
    boundary, lists_only, best = overlap_join.choose_boundary([(10, 100, 10_000_000)], 90, 100)
    assert boundary == 10 and best < lists_only
    assert overlap_join.choose_boundary([(30, 100, 5)], 90, 100)[0] == 0
    assert overlap_join.choose_boundary([(45, 10, 10**12)], 90, 100)[0] == 45


def test_near_copies_that_do_not_link_make_few_pairs(spark, monkeypatch):
    """Twice as many copies of one text, each edited in its own places, make about twice as many pairs."""
    monkeypatch.setattr(overlap_join, "SHORT_LIST", 8)
    monkeypatch.setattr(overlap_join, "LONG_LIST", 40)
    made = []
    placed = overlap_join._Join.placed
    counted = []

    def watched(self, lists):
        pairs = placed(self, lists)
        counted.append(pairs.count())
        return pairs

    monkeypatch.setattr(overlap_join._Join, "placed", watched)
    for m in (150, 300):
        random.seed(3)
        rows = []
        for i in range(m):
            words = [f"t{j}" for j in range(120)]
            for _ in range(random.choice([1, 2, 3, 4, 5])):
                words[random.randrange(120)] = f"e{random.randrange(10**9)}"
            rows.append((i, " ".join(words)))
        counted.clear()
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in overlap_join.near_copies(docs).collect()}
        assert got == plain_components(rows, 3, 90)
        made.append(sum(counted))
    assert made[1] <= 3 * made[0] + 100 and made[1] < 300 * 299 / 2 / 4


def test_join_edges(spark, odd, none):
    kept = overlap_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] or 0) for r in kept.collect())
    assert ids == [0, 1, 2, 3, 6, 7, 9, 10]
    assert overlap_join.keep_one(none).count() == 0 and overlap_join.near_copies(none).count() == 0
    twice = odd.filter("doc_id = 10").unionByName(odd.filter("doc_id = 10"))
    assert overlap_join.keep_one(twice).count() == 1


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b")
    got = components(edges).collect()
    assert len(got) == 201 and {r["root"] for r in got} == {0}


def test_model_sums_to_one_and_both_scorers_agree(spark, sf):
    docs = spark.createDataFrame([(i, "en", "abab cab bac " * (1 + i % 3) + "xyz"[i % 3]) for i in range(12)], "doc_id bigint, lang string, text string")
    grams, contexts = kneser_ney.model_tables(kneser_ney.gram_counts(docs))
    p = {r["gram"]: r["p"] for r in grams.collect()}
    g = {r["gram"]: r["g"] for r in contexts.collect()}
    letters = {x for x in p if len(x) == 1}

    def chance(context, letter):
        if context + letter in p:
            return p[context + letter]
        if not context:
            return g[""]
        return g.get(context, 1.0) * chance(context[1:], letter)

    for context in ("", "a", "ba", "bab", " cab", "zzzz"):
        assert abs(sum(chance(context, x) for x in letters) + chance(context, "?") - 1) < 1e-6
    odd = docs.unionByName(spark.createDataFrame([(50, "en", None), (51, "en", ""), (52, "xx", "abc"), (53, None, "abc"), (54, "en", "unseen Ωé"), (54, "en", "unseen Ωé")], docs.schema))
    a = sorted((r["doc_id"], r["nats"] or 0.0) for r in kneser_ney.scored(odd, grams, contexts).collect())
    b = sorted((r["doc_id"], r["nats"] or 0.0) for r in kneser_ney.scored_by_join(odd, grams, contexts).collect())
    assert len(a) == len(b) and all(x[0] == y[0] and abs(x[1] - y[1]) < 1e-9 * max(1, x[1]) for x, y in zip(a, b))


def plain_nats(train, text, order=5):
    """Interpolated modified Kneser-Ney in plain Python: recursive, by the textbook's counts."""
    top = defaultdict(int)
    for t in train:
        padded = "\x02" * (order - 1) + t
        for i in range(len(t)):
            top[padded[i : i + order]] += 1
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = defaultdict(int)
        for gram in counts[n + 1]:
            counts[n][gram[1:]] += 1
    cuts, mass, left = {}, {}, {}
    for n, own in counts.items():
        k = [0, *(sum(1 for c in own.values() if c == j) for j in (1, 2, 3, 4))]
        ratio = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else None
        cuts[n] = [min(j, max(0.05, j - (j + 1) * ratio * k[j + 1] / k[j])) if ratio is not None and k[j] else 0.5 * j for j in (1, 2, 3)]
        mass[n], left[n] = defaultdict(int), defaultdict(float)
        for gram, c in own.items():
            mass[n][gram[:-1]] += c
            left[n][gram[:-1]] += cuts[n][min(c, 3) - 1]

    def chance(gram):
        n, context = len(gram), gram[:-1]
        below = chance(gram[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        if not mass[n][context]:
            return below
        c = counts[n].get(gram, 0)
        return ((c - cuts[n][min(c, 3) - 1]) if c else 0.0) / mass[n][context] + left[n][context] / mass[n][context] * below

    padded = "\x02" * (order - 1) + text
    return -sum(math.log(chance(padded[i : i + order])) for i in range(len(text)))


def test_perplexity_by_brute_force(spark, sf, texts, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SLICE", 700)
    train = [t for _, t in texts[:25] if t] + ["a\x02b " * 40]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(train)], "doc_id bigint, lang string, text string")
    grams, contexts = kneser_ney.model_tables(kneser_ney.gram_counts(docs))
    asked = [t for _, t in texts[25:40] if t] + ["", "unseen Ωé"]
    rows = spark.createDataFrame([(i, "en", t) for i, t in enumerate(asked)], docs.schema)
    got = {r["doc_id"]: r["nats"] for r in kneser_ney.scored(rows, grams, contexts).collect()}
    for i, t in enumerate(asked):
        if t:
            want = plain_nats(train, t)
            assert abs(got[i] - want) < 1e-6 * max(1, want)
    other, more = kneser_ney.model_tables(kneser_ney.gram_counts(docs.unionByName(docs.filter("doc_id < 5"))))
    second = {r["doc_id"]: r["nats"] for r in kneser_ney.scored(rows, other, more).collect()}
    want = plain_nats(train + train[:5], asked[0])
    assert abs(second[0] - want) < 1e-6 * want  # not scored with the first model's tables


def test_perplexity_accuracy_and_edges(spark, sf, odd, none, labels):
    rows = QUERIES["op2_perplexity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.4 * len(bad)
    assert kneser_ney.quality_by_perplexity(odd, labels).count() == 12
    assert kneser_ney.quality_by_perplexity(none, labels).count() == 0
    assert kneser_ney.quality_by_perplexity(odd, labels.filter("false")).filter("not kept").count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, sf).cache()
    scored = {r["doc_id"] for r in QUERIES["op3_quality_rules"](spark, sf).filter("kept").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == scored
    once = corpus_pipeline.near_copies(spark, good, sf).cache()
    want = plain_components([(r["doc_id"], r["text"]) for r in good.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in once.collect()) == sorted({c for _, c in want.values()})
    clean = corpus_pipeline.personal_data(spark, once, sf).cache()
    assert clean.columns == docs.columns and clean.count() == once.count()
    assert clean.filter(F.col("text").rlike(r"[a-z0-9]@[a-z0-9-]+\.[a-z]")).count() == 0
    assert clean.filter(F.length("text") != F.col("n_chars")).count() == 0
    mixed = corpus_pipeline.source_mix(spark, clean, sf)
    assert mixed.columns == docs.columns and mixed.select("doc_id").exceptAll(clean.select("doc_id").unionByName(clean.select("doc_id")).unionByName(clean.select("doc_id"))).count() == 0
    tokens = corpus_pipeline.token_ids(spark, clean, sf)
    assert tokens.filter(F.size("ids") != F.col("n_tokens")).count() == 0 and tokens.count() == clean.count()
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][-1] == "token_ids"
