"""Quality classifier: interpolated modified Kneser-Ney over code points, one model per language.

Counts of ORDER-grams come from all trusted texts (quality label 1). Spark shards all tables by
n-gram: continuation counts of each lower order are grouped from the order above, discounts and
context masses are grouped per order, and probabilities are built upwards by joins of each order with
the one below. Documents are scored against the finished tables: broadcast to the workers as hash
arrays while they have no more than MAX_BROADCAST rows (checked), otherwise by joins of the documents'
n-grams with the tables, sharded by n-gram. A document is kept if its perplexity is within a quantile
of trusted documents of its language that took no part in the counts (one in HELD_OUT, by hash).

Perplexities are shrunk towards the trusted mean of the language by PRIOR code points, so that very
short texts are not judged by chance. Null and empty texts and languages without trusted text have no
evidence: null perplexity, kept. Repeated rows score alike. Without trusted rows everything is kept.
Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .rolling import code_points, mixed

ORDER, PRIOR, QUANTILE, SLACK = 5, 100, 0.995, 1.1
#: Rows of all orders that may be sent to every worker (16 bytes each; hash arrays there hold 32 to 64).
#: Models with more rows are joined. Both ways add the same doubles, so this changes the cost only.
MAX_BROADCAST = 8_000_000
#: Fixed value: stands before the start of every text.
PAD = "\x02" * (ORDER - 1)
SLICE = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
EMPTY = mixed(np.ones(1, np.uint64))
#: One trusted document in so many is kept out of the counts and sets the thresholds.
HELD_OUT = 5


def gram_codes(points: np.ndarray, order: int) -> np.ndarray:
    """Code of the ``order``-gram that ends at each position (from position order - 1 on)."""
    n = len(points) - order + 1
    code = np.full(max(n, 0), order, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(order):
            code = code * _STEP + points[i : i + n].astype(np.uint64) + np.uint64(1)
    return mixed(code)


def gram_counts(trusted: DataFrame) -> DataFrame:
    """lang, gram, c: counts of ORDER-grams; combined by slice, then by Spark map-side and by shard. Every
    code point of a text ends one gram, whose start is padding at the start of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(lang: str, parts: list[tuple[str, str]]) -> pa.RecordBatch:
            joined = "".join(context + part for context, part in parts)
            sizes = np.array([(ORDER - 1, len(part)) for _, part in parts]).ravel()
            ends = np.repeat(np.tile([False, True], len(parts)), sizes)[ORDER - 1 :]
            starts = np.flatnonzero(ends)
            _, at, count = np.unique(gram_codes(code_points(joined), ORDER)[starts], return_index=True, return_counts=True)
            grams = [joined[i : i + ORDER] for i in starts[at].tolist()]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(count)], ["lang", "gram", "c"])

        held: dict[str, list[tuple[str, str]]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                for at in range(0, len(text), SLICE):  # long texts in slices, each after its context
                    part = text[at : at + SLICE]
                    held.setdefault(lang, []).append(((PAD + text[max(0, at - ORDER + 1) : at])[-ORDER + 1 :], part))
                    size[lang] = size.get(lang, 0) + len(part)
                    if size[lang] >= SLICE:
                        yield counted(lang, held.pop(lang))
                        size[lang] = 0
        for lang, parts in held.items():
            if parts:
                yield counted(lang, parts)

    rows = trusted.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text")
    return rows.mapInArrow(run, "lang string, gram string, c bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def model_tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grams: lang, gram, p), (contexts: lang, gram, g): interpolated probabilities of every seen
    n-gram of each order, and the mass that each seen context leaves to the order below."""
    orders = {ORDER: stored(counts, "grams")}
    for n in range(ORDER - 1, 0, -1):
        orders[n] = orders[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c"))
    lower, grams, contexts = None, None, None
    for n in range(1, ORDER + 1):
        own = stored(orders[n], "order")
        freq = own.groupBy("lang").agg(*(F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in range(1, 5)), F.count("*").alias("types"))
        ratio = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        cut = lambda k: F.least(F.lit(float(k)), F.greatest(F.lit(0.05), F.coalesce(k - (k + 1) * ratio * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.5 * k))))
        freq = freq.select("lang", "types", *(cut(k).alias(f"d{k}") for k in (1, 2, 3)))
        cutted = own.join(F.broadcast(freq) if n == 1 else freq, "lang").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        cutted = cutted.withColumn("context", F.substring("gram", 1, n - 1))
        mass = stored(cutted.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("left"), F.max("types").alias("types")), "mass")
        joined = cutted.drop("types").join(mass, ["lang", "context"])
        if lower is None:
            p = (F.col("c") - F.col("d")) / F.col("total") + F.col("left") / F.col("total") / (F.col("types") + 1)
            made = joined.select("lang", "gram", p.alias("p"))
        else:
            below = lower.select("lang", F.col("gram").alias("_tail"), F.col("p").alias("_p"))
            joined = joined.withColumn("_tail", F.substring("gram", 2, n - 1)).join(below, ["lang", "_tail"])
            made = joined.select("lang", "gram", ((F.col("c") - F.col("d")) / F.col("total") + F.col("left") / F.col("total") * F.col("_p")).alias("p"))
        lower = stored(made, "probabilities")
        scale = F.when(F.lit(n == 1), 1 / (F.col("types") + 1)).otherwise(F.lit(1.0))  # of an unseen letter
        own_mass = mass.select("lang", F.col("context").alias("gram"), (F.col("left") / F.col("total") * scale).alias("g"))
        grams = lower if grams is None else grams.unionByName(lower)
        contexts = own_mass if contexts is None else contexts.unionByName(own_mass)
    return grams, contexts


class Tables:
    """Open-addressed hash arrays from code to value."""

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        bits = max(8, int(2 * len(codes)).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.zeros(1 << bits, dtype=np.float64)
        codes, first = np.unique(codes, return_index=True)
        values = values[first]
        spot = codes.astype(np.int64) & self.mask
        while len(codes):
            free = self.keys[spot] == 0
            take, index = np.unique(spot[free], return_index=True)
            chosen = np.flatnonzero(free)[index]
            self.keys[take], self.values[take] = codes[chosen], values[chosen]
            rest = np.ones(len(codes), bool)
            rest[chosen] = False
            codes, values, spot = codes[rest], values[rest], (spot[rest] + 1) & self.mask

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Values, NaN where absent."""
        spot = codes.astype(np.int64) & self.mask
        held = self.keys[spot]
        out = np.where(held == codes, self.values[spot], np.nan)
        open_ = np.flatnonzero((held != codes) & (held != 0))
        while len(open_):
            spot[open_] = (spot[open_] + 1) & self.mask
            held = self.keys[spot[open_]]
            hit = held == codes[open_]
            out[open_[hit]] = self.values[spot[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return out


Arrays = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def coded(rows: DataFrame, value: str) -> DataFrame:
    """lang, code, value: the n-grams as 64-bit codes, computed by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(1).to_pylist()
            codes = np.empty(len(grams), dtype=np.uint64)
            sizes = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                codes[at] = gram_codes(code_points("".join(grams[i] for i in at)), n)[::n] if n else EMPTY
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64)), batch.column(2)], ["lang", "code", "value"])

    return rows.select("lang", "gram", F.col(value).alias("value")).mapInArrow(run, "lang string, code bigint, value double")


def packed(grams: DataFrame, contexts: DataFrame) -> Arrays:
    """Per language: codes and values of n-grams, codes and values of contexts; 16 bytes a row."""
    out: Arrays = {}
    tables = [coded(grams, "p").toArrow(), coded(contexts, "g").toArrow()]
    langs = [np.array(t.column("lang").to_pandas(), dtype=object) for t in tables]
    for lang in sorted(set(langs[0])):
        parts: list[np.ndarray] = []
        for t, own in zip(tables, langs):
            at = np.flatnonzero(own == lang)
            parts += [t.column("code").to_numpy()[at].view(np.uint64), t.column("value").to_numpy()[at]]
        out[str(lang)] = (parts[0], parts[1], parts[2], parts[3])
    return out


_BUILT: dict[tuple[str, str], tuple[Tables, Tables]] = {}


def built(number: str, model: Arrays, lang: str | None) -> tuple[Tables, Tables] | None:
    """Hash arrays of one language of broadcast ``number``, made once in a worker."""
    if lang is None or lang not in model:
        return None
    if any(n != number for n, _ in _BUILT):
        _BUILT.clear()
    if (number, lang) not in _BUILT:
        codes, p, contexts, g = model[lang]
        _BUILT[number, lang] = (Tables(codes, p), Tables(contexts, g))
    return _BUILT[number, lang]


def log_probabilities(points: np.ndarray, model: tuple[Tables, Tables]) -> np.ndarray:
    """Natural log of the probability of each code point after the first ORDER - 1 (the padding)."""
    p, g = model
    n = len(points) - ORDER + 1
    out = np.full(n, np.nan, dtype=np.float64)
    scale = np.ones(n)
    todo = np.arange(n)
    for order in range(ORDER, 0, -1):
        codes = gram_codes(points[ORDER - order :], order)[todo]
        found = p.find(codes)
        hit = ~np.isnan(found)
        out[todo[hit]] = scale[todo[hit]] * found[hit]
        todo = todo[~hit]
        if not len(todo):
            return np.log(out)
        if order > 1:
            left = g.find(gram_codes(points[ORDER - order :], order - 1)[todo])
        else:
            left = g.find(np.repeat(EMPTY, len(todo)))
        scale[todo] *= np.where(np.isnan(left), 1.0, left)
    out[todo] = scale[todo]
    return np.log(out)


def scored(docs: DataFrame, grams: DataFrame, contexts: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, lang, n_chars, nats (negative log probability of the whole text; null without model)."""
    if grams.count() + contexts.count() > max_broadcast:
        return scored_by_join(docs, grams, contexts)
    arrays = packed(grams, contexts)
    number = uuid.uuid4().hex
    model = docs.sparkSession.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nats = []
            for lang, text in zip(batch["lang"], batch["text"]):
                own = built(number, model.value, lang) if text else None
                total = None
                if own is not None:
                    total = 0.0
                    for at in range(0, len(text), SLICE):
                        part = (PAD + text[max(0, at - ORDER + 1) : at])[-ORDER + 1 :] + text[at : at + SLICE]
                        total -= float(log_probabilities(code_points(part), own).sum())
                nats.append(total)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang": batch["lang"], "n_chars": [len(t) if t else 0 for t in batch["text"]], "nats": pd.array(nats, dtype="Float64")})

    return docs.select("doc_id", "lang", "text").mapInPandas(run, "doc_id bigint, lang string, n_chars bigint, nats double")


def scored_by_join(docs: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """The same as ``scored`` with every table sharded by n-gram: one row per position, joined with
    each order in turn. Moves far more; for models too large to broadcast."""
    rows = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "lang", "text"))
    per_row = rows.groupBy("row", "doc_id", "lang").agg(F.count("*").alias("copies"), F.first(F.length("text").cast("bigint")).alias("n_chars"), F.first("text").alias("text"))
    padded = F.concat(F.lit(PAD), F.col("text"))
    positions = per_row.filter("n_chars > 0").select("row", "lang", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring(padded, i, F.lit(ORDER)))).alias("at", "gram"))
    out = positions.withColumns({"p": F.lit(None).cast("double"), "scale": F.lit(1.0)})
    for order in range(ORDER, 0, -1):
        own = grams.filter(F.length("gram") == order).select("lang", F.col("gram").alias("_gram"), F.col("p").alias("_p"))
        left = contexts.filter(F.length("gram") == order - 1).select("lang", F.col("gram").alias("_context"), "g")
        tail = F.substring("gram", ORDER - order + 1, order)
        out = out.withColumns({"_gram": tail, "_context": F.substring("gram", ORDER - order + 1, order - 1)})
        out = out.join(own, ["lang", "_gram"], "left").join(left, ["lang", "_context"], "left")
        out = out.withColumn("p", F.coalesce("p", F.col("scale") * F.col("_p"))).withColumn("scale", F.col("scale") * F.coalesce("g", F.lit(1.0))).drop("_gram", "_context", "_p", "g")
    nats = out.groupBy("row").agg((-F.sum(F.log(F.coalesce("p", "scale")))).alias("nats"))
    known = grams.select("lang").distinct().withColumn("_known", F.lit(True))
    joined = per_row.drop("text").join(nats, "row", "left").join(known, "lang", "left").withColumn("nats", F.when(F.col("_known"), F.col("nats")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "lang", "n_chars", "nats")


def quality_by_perplexity(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, kept for each row of ``docs`` (doc_id, lang, text).

    The threshold of a language is ``slack`` times the ``quantile`` of its trusted documents'
    perplexities. Trusted are documents whose quality labels are all 1.
    """
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    good = stored(good.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0), "trusted-ids")
    training = docs.select("doc_id", "lang", "text").join(good.filter("not held"), "doc_id", "left_semi")
    grams, contexts = model_tables(gram_counts(training))
    rows = stored(scored(docs, grams, contexts, max_broadcast), "scores")
    trusted = rows.join(good.filter("held"), "doc_id", "left_semi").filter(F.col("nats").isNotNull())
    means = stored(trusted.groupBy("lang").agg((F.sum("nats") / F.sum("n_chars")).alias("mean")), "mean-nats")
    shrunk = lambda: F.exp((F.col("nats") + PRIOR * F.col("mean")) / (F.col("n_chars") + PRIOR))
    limits = trusted.join(means, "lang").groupBy("lang").agg((slack * F.percentile_approx(shrunk(), quantile, 10_000)).alias("threshold"), F.first("mean").alias("mean"))
    limits = stored(limits, "limits").withColumnRenamed("lang", "_lang")
    out = rows.join(limits, rows["lang"].eqNullSafe(limits["_lang"]), "left").withColumn("perplexity", shrunk())
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
