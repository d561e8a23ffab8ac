import hashlib
import re
import zlib
from collections import Counter, defaultdict

from compare_rows import normal
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, curriculum, decision_list, label_shards
from tidemark.llm.common import stored
from tidemark.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics_by_brute_force(spark, sf, texts, odd, odd_rows, labels):
    got = {r["doc_id"]: r for r in QUERIES["op3_quality_rules"](spark, sf).collect()}
    for doc_id, text in texts:
        want = stats(text)
        row = got[doc_id]
        assert tuple(row[n] for n in NAMES) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert row["base_failed"] == failed and (not failed or not row["kept"])
    rows, _ = decision_list.quality_rules(odd, labels)
    got = sorted((r["doc_id"] or 0, *(r[n] for n in NAMES)) for r in rows.collect())
    assert got == sorted((i or 0, *stats(t)) for i, t, _, _ in odd_rows)


def test_rules_separate_labelled_rows(spark):
    rows = [(i, f"{'BAD WORD #' if i % 4 == 0 else 'good words'} " + " ".join(f"t{i}y{j}" for j in range(80))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id bigint, quality int")
    scored, rules = decision_list.quality_rules(docs, labels)
    assert rules and all(str(c) for rule in rules for c in rule)
    assert {r["doc_id"] for r in scored.filter("kept").collect()} == {i for i in range(400) if i % 4}
    assert decision_list.keep_good(docs, labels).count() == 300


def test_rules_edges(odd, none, labels):
    assert decision_list.keep_good(odd, labels).columns == odd.columns
    assert decision_list.keep_good(none, labels).count() == 0
    scored, rules = decision_list.quality_rules(odd, labels.filter("false"))
    assert rules == [] and scored.filter("kept = base_failed").count() == 0


def test_mix_equals_sql_and_stays_near_targets(spark, sf, duck):
    got = QUERIES["op4_mix_sources"](spark, sf)
    assert normal(got.toPandas()) == normal(duck.sql(ORACLES["op4_mix_sources"]).df())


def test_mix_edges(odd, none):
    out = curriculum.mix(odd)
    rows = out.collect()
    assert len(rows) == 12 and all(r["taken"] <= 3 * r["size"] and len(r["positions"]) * r["size"] == r["taken"] for r in rows)
    by = defaultdict(int)
    for r in rows:
        by[r["source"]] += r["taken"]
    for r in rows:
        assert abs(by[r["source"]] - r["target"]) <= max(x["size"] for x in rows if x["source"] == r["source"]) / 2 + 1e-9
    order = [r["position"] for r in curriculum.by_position(out, 2).collect()]
    assert order == sorted(order) and all(0 <= p <= 1 for p in order)
    assert out.select("doc.*").columns == odd.columns and curriculum.mix(none).count() == 0


def test_mix_query_comes_in_training_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    first = {r["doc_id"]: r["positions"][0] if r["positions"] else 2.0 for r in curriculum.mix(docs).select("doc_id", "positions").collect()}
    got = [first[r["doc_id"]] for r in QUERIES["op4_mix_sources"](spark, sf).collect()]
    assert len(set(got)) > 2 and got == sorted(got)


def test_pipeline_rows_carry_the_training_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = [r["doc_id"] for r in curriculum.by_position(curriculum.mix(docs)).select("doc_id").collect()]
    mixed = stored(corpus_pipeline.source_mix(spark, docs, sf), "mixed")
    rows = corpus_pipeline.token_ids(spark, mixed, sf).select("doc_id", "place").collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["place"])] == want
    assert corpus_pipeline.token_ids(spark, docs.cache(), sf).columns[-1] == "place"


def test_position_inverts_the_schedule(spark):
    ramp = ((0.0, 1.0), (0.5, 3.0), (1.0, 0.0))
    whole = curriculum.integral(ramp)
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        t = spark.range(1).select(curriculum.position(F.lit(0), F.lit(share), [ramp])).first()[0]
        done = 0.0
        for (t0, w0), (t1, w1) in zip(ramp, ramp[1:]):
            x = min(max(t - t0, 0), t1 - t0)
            done += w0 * x + (w1 - w0) * x * x / 2 / (t1 - t0)
        assert abs(done / whole - share) < 1e-9


def test_chat_equals_sql(spark, sf, duck):
    got = QUERIES["op5_chat_format"](spark, sf)
    assert normal(got.toPandas()) == normal(duck.sql(ORACLES["op5_chat_format"]).df())


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a<|turn|>&lt;[b]\n"), (1, 1, "assistant", "<|end|>\n&amp;"), (1, 2, "us\ner", None), (2, 0, "user", "no reply"), (None, None, None, ""), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"), (3, 0, "system", "é😀")]
    made = chat.examples(chat.conversations_of(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        flat = "".join(f"{r}\n{t}\n" for _, r, t in sorted(turns))
        loss = "".join(t for _, r, t in sorted(turns) if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(turns) and row["turns_sha256"] == hashlib.sha256(flat.encode()).hexdigest()
        assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.examples(chat.conversations_of(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")))).count() == 0


def check_shards(rows, docs, shards):
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(0 <= s < shards for s in slots)
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(shards):
        assert abs(sum(r["size"] for r in rows if r["shard"] == s) - total / shards) <= most


def test_shards_are_even_and_keep_copies_together(spark, sf, texts):
    rows = QUERIES["op8_shards"](spark, sf).collect()
    check_shards(rows, [t for _, t in texts], 24)
    groups = Counter(t for _, t in texts)
    where = {r["doc_id"]: r["shard"] for r in rows}
    split = {t for t, n in groups.items() if n > 1 and len({where[i] for i, x in texts if x == t}) > 1}
    assert len(split) <= max(1, sum(n > 1 for n in groups.values()) // 3)


def test_shards_edges(spark, odd, none, odd_rows):
    check_shards(label_shards.shard(odd, 3).collect(), [t for _, t, _, _ in odd_rows], 3)
    assert label_shards.shard(none).count() == 0
    hot = [(i, "same text" if i % 3 else f"text {i}") for i in range(900)]
    rows = label_shards.shard(spark.createDataFrame(hot, "doc_id bigint, text string"), 6).collect()
    check_shards(rows, [t for _, t in hot], 6)


def test_hot_hub_is_dealt_out(spark):
    """Half of all rows share a text: their group stays one, and the join with its votes is not one task."""
    from pyspark.sql import functions as F

    from tidemark.llm.common import with_facts

    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("hub"), "id")
    facts = rows.groupBy("hub").agg(F.count("*").alias("n"), F.max("id").alias("want"))
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # or small tables are one task
    for name, value in off.items():
        spark.conf.set(name, value)
    try:
        dealt = with_facts(rows, facts, ["hub"], ["want"]).withColumn("task", F.spark_partition_id())
        by_task = {r["task"]: r["count"] for r in dealt.filter("hub = 7").groupBy("task").count().collect()}
        assert sum(by_task.values()) == 20_001 and max(by_task.values()) < 10_000
        assert dealt.filter("hub = 7 and want = 39998").count() == 20_001 and dealt.filter("hub <> 7 and want = id").count() == 19_999
    finally:
        for name in off:
            spark.conf.unset(name)
