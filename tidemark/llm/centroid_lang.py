"""Language identification by the nearest centroid of TF-IDF n-gram vectors.

Text is folded to lower-case letters with single spaces between (and at both ends). Its n-grams of one to
three characters are counted in BUCKETS hashed buckets; a vector is log(1 + count) times the bucket's inverse
document frequency, normalised, in whole steps of 2**-20, so that sums do not depend on their order. Each
language has up to CLUSTERS centroids from spherical k-means. A text gets the language of the centroid with
the greatest cosine (ties: the least language by code point). It is ``rejected`` where that cosine lies more
than TOLERANCE standard deviations under the mean of the language's own training texts.

Learning: document frequencies, language counts and rejection thresholds cover all training rows (text and
lang not null, not held out). Only the clusters are fitted on a bounded sample: of each language, the distinct
texts whose hash is under a rate that makes some SAMPLE texts. What prediction reads is the text alone.

Null texts and texts without a letter are ``und`` with score 0, as is every text where nothing could be
learned. Very long texts are counted in slices. Repeated rows each count as documents; in the sample they are
one. A null id is not held out. Empty tables give empty results. Columns other than the named ones are not
read. More than MOST_LANGS languages raise ValueError: centroids are sent to every task.

At scale: texts are read three times (frequencies, sample, prediction) and only the sample's are shuffled.
Frequencies leave a task as one row a bucket, centroid sums as one row a centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored
from .rolling import code_points

ORDERS, BUCKETS = 3, 1 << 13
CLUSTERS, ROUNDS, SAMPLE = 4, 3, 500
TOLERANCE, MOST_LANGS = 4.0, 500
UNKNOWN = "und"
SLICE = 1 << 20
ROWS = 128
#: Odd multipliers of the rolling hash of an n-gram.
MIX, TURN = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


@cache
def folded() -> np.ndarray:
    """For each code point the lower-case letter it counts as; 32 for what is no letter."""
    made = np.full(0x110000, 32, np.uint32)
    for point, letter in enumerate(map(chr, range(0x110000))):
        if letter.isalpha():
            lower = letter.lower()
            made[point] = ord(lower) if len(lower) == 1 else point
    return made


def counts(text: str | None) -> np.ndarray | None:
    """n-grams by bucket, null without a letter."""
    points = folded()[code_points(text or "")]
    kept = points != 32
    if not kept.any():
        return None
    kept[1:] |= kept[:-1].copy()  # one space behind each run of letters
    points = np.concatenate([np.array([32], np.uint32), points[kept]])
    if points[-1] != 32:
        points = np.append(points, np.uint32(32))
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(points), SLICE):
        own = points[max(at - ORDERS + 1, 0) : at + SLICE]
        lead = min(at, ORDERS - 1)  # read before, for n-grams that end in this slice
        code = np.zeros(len(own), np.uint32)
        for n in range(1, ORDERS + 1):
            code = (code[:-1] if n > 1 else code) * TURN + (own[n - 1 :] + np.uint32(n)) * MIX
            code ^= code >> np.uint32(15)
            new = code[max(lead - n + 1, 0) :]
            out += np.bincount((new * TURN) >> np.uint32(32 - 13), minlength=BUCKETS)
    return out


@dataclass
class Model:
    """Inverse document frequencies, and the languages and centroids of equal index."""

    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray

    def vectors(self, found: list[np.ndarray]) -> np.ndarray:
        return unit(np.log1p(np.array(found)) * self.idf)

    def nearest(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, cosine) of each text's counts."""
        cosines = np.round(self.vectors(found) @ self.centroids.T, 9)
        return cosines.argmax(axis=1), np.clip(cosines.max(axis=1), 0.0, 1.0)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300)


def _frequencies(training: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """(inverse document frequencies, texts with letters by language) of all training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, langs = np.zeros(BUCKETS, np.int64), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = counts(text.as_py())
                if found is not None:
                    seen += found > 0
                    langs[lang] = langs.get(lang, 0) + 1
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array([*used.tolist(), *([None] * len(langs))], pa.int32()),
            "lang": pa.array([*([None] * len(used)), *langs], pa.string()),
            "c": pa.array([*seen[used].tolist(), *langs.values()], pa.int64()),
        })

    made = training.select("lang", "text").mapInArrow(run, "bucket int, lang string, c bigint").groupBy("bucket", "lang").agg(F.sum("c").alias("c"))
    rows = made.limit(BUCKETS + MOST_LANGS + 1).collect()  # buckets and languages: both bounded
    langs = {r["lang"]: r["c"] for r in rows if r["bucket"] is None}
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    seen = np.zeros(BUCKETS)
    for r in rows:
        if r["bucket"] is not None:
            seen[r["bucket"]] = r["c"]
    return np.log((1 + sum(langs.values())) / (1 + seen)) + 1, langs


def _clustered(sample: DataFrame, model: Model) -> Model:
    """Centroids after one round: ``sample`` has lang, text and ``first`` (cluster of a seed, else null).
    Without centroids the seeds make them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, text, first in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                found = counts(text.as_py()) if len(model.langs) or first is not None else None
                if found is None:
                    continue
                vector = np.rint(model.vectors([found])[0] * 2**20).astype(np.int64)
                if len(model.langs):
                    own = [i for i, name in enumerate(model.langs) if name == lang]
                    first = int(np.argmax(np.round(model.centroids[own] @ vector, 3)))
                sums[lang, first] = sums.get((lang, first), 0) + vector
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in sums]), "cluster": pa.array([k[1] for k in sums], pa.int32()), "sums": pa.array(list(sums.values()), pa.list_(pa.int64()))})

    def added(part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(part["sums"].to_list()), axis=0)
        return pd.DataFrame({"lang": part["lang"][:1], "cluster": part["cluster"][:1], "sums": [total]})

    shape = "lang string, cluster int, sums array<bigint>"
    made = sample.select("lang", "text", "first").mapInArrow(run, shape).groupBy("lang", "cluster").applyInPandas(added, shape)
    rows = sorted(made.collect(), key=lambda r: (r["lang"], r["cluster"]))  # at most CLUSTERS a language
    if not rows:
        return model
    return Model(model.idf, [r["lang"] for r in rows], unit(np.array([r["sums"] for r in rows], float)))


def learned(training: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, sample: int = SAMPLE) -> Model:
    """A model of the rows (lang, text) of ``training``."""
    training = training.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    idf, langs = _frequencies(training)
    model = Model(idf, [], np.zeros((0, BUCKETS)))
    if not langs:
        return model
    rates = training.sparkSession.createDataFrame([(k, sample / n) for k, n in langs.items()], "lang string, rate double")
    spot = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    some = training.withColumn("spot", spot).join(F.broadcast(rates), "lang").filter(F.col("spot") < F.col("rate") * float(1 << 40))
    some = stored(some.select("lang", "text", "spot").distinct().repartition(32, "spot"), "language-sample")
    seeds = some.groupBy("lang").agg(F.slice(F.sort_array(F.collect_set("spot")), 1, clusters).alias("seeds"))
    place = F.array_position("seeds", F.col("spot"))
    some = some.join(F.broadcast(seeds), "lang").select("lang", "text", F.when(place > 0, place - 1).cast("int").alias("first"))
    for _ in range(1 + rounds):
        model = _clustered(some, model)
    return model


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score of the text, and without the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.schema.get_field_index(text)
            langs, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows if model.langs else 0, ROWS):
                found = [(at + i, c) for i, value in enumerate(batch.column(spot).slice(at, ROWS)) if (c := counts(value.as_py())) is not None]
                if found:
                    rows, (best, cosine) = [i for i, _ in found], model.nearest([c for _, c in found])
                    langs[rows], scores[rows] = [model.langs[b] for b in best], cosine
            kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if i != spot}
            yield pa.RecordBatch.from_pydict(kept | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores)})

    kept = docs.drop("lang_pred", "score")
    shape = kept.drop(text).schema.add("lang_pred", "string").add("score", "double")
    return kept.mapInArrow(run, shape)


def held_out(key: str = "doc_id") -> F.Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row of ``docs``."""
    rows = docs.select("doc_id", "lang", "text", held_out().alias("held_out"))
    with scratch(docs.sparkSession) as keep:
        made = stored(predicted(rows, learned(rows.filter("NOT held_out"))), "languages")
        right = made.filter("NOT held_out AND lang = lang_pred").groupBy("lang_pred")
        bounds = right.agg((F.avg("score") - TOLERANCE * F.stddev_pop("score")).alias("least"))
        out = made.join(F.broadcast(bounds), "lang_pred", "left")  # one row a learned language
        rejected = F.coalesce(F.col("score") < F.round("least", 9), F.col("lang_pred") == UNKNOWN)
        return keep(out.select("doc_id", "held_out", "lang_pred", "score", rejected.alias("rejected")), "identified")
