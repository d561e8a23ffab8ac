"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time [0, 1], piecewise linear. Its integral is the
source's weight in the mix; targets share the budget by those weights under a repetition limit. Words
of a source are laid out in a fixed hash order, epoch after epoch; the cumulative demand of the
schedule is inverted at the middle of each copy of a document to give its training position.

Null and empty texts have size 0 and are never taken. A null source is a source of its own, last in
order. Repeated rows are separate documents; rows alike in every read column are interchangeable.
Empty tables give empty results. All columns of a row are carried in one struct, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_totals, stored, word_count

Schedule = Sequence[tuple[float, float]]

#: Schedules of the sources in code point order, repeating: their integrals are the weights 5, 2 and 1.
#: The first kind leads early and fades, the third grows.
RAMPS: tuple[Schedule, ...] = (((0.0, 7.0), (1.0, 3.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.6), (1.0, 1.4)))

ROWS_PER_BUCKET = 4000


def integral(schedule: Schedule) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))


def source_targets(sizes: DataFrame, schedules: Sequence[Schedule] = RAMPS, repeats: int = 3) -> DataFrame:
    """Targets by source from (source, source_size): the sum of sizes shared by integrated weight,
    no source above ``repeats`` times its size, the excess reshared by weight among the others.

    Sources in order of (limit / weight) fill up first; the level at which the rest share what
    remains is the first that leaves the next source under its limit. One row per source: the
    unpartitioned scans here are over the table of sources, never over documents.
    """
    weights = [integral(s) for s in schedules]
    listed = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("source_rank", F.row_number().over(listed) - 1)
    out = out.withColumn("kind", F.col("source_rank") % len(schedules))
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("kind") + 1))
    out = out.withColumn("ceiling", repeats * F.col("source_size"))
    filled = Window.partitionBy().orderBy(F.col("ceiling") / F.col("weight"), "source_rank")
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("ceiling").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("level", (total - before).cast("double") / rest)
    out = out.withColumn("fits", F.col("level") * F.col("weight") <= F.col("ceiling"))
    out = out.withColumn("level", F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("ceiling") / F.col("weight"))).over(Window.partitionBy()))
    return out.withColumn("target", F.least(F.col("ceiling").cast("double"), F.col("level") * F.col("weight"))).select(
        "source", "source_size", "source_rank", "kind", "target"
    )


def position(kind: Column, share: Column, schedules: Sequence[Schedule] = RAMPS) -> Column:
    """Training time at which a source has asked for ``share`` (0 to 1) of its target."""
    out = None
    for index, schedule in enumerate(schedules):
        whole, done = integral(schedule), 0.0
        solved = F.lit(1.0)
        pieces = []
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            d0, slope = w0 / whole, (w1 - w0) / whole / (t1 - t0)
            part = (t1 - t0) * (w0 + w1) / 2 / whole
            rest = F.greatest(share - done, F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(d0 * d0) + 2 * slope * rest, F.lit(0.0)))
            pieces.append((done + part, F.lit(t0) + F.when(d0 + root > 0, 2 * rest / (d0 + root)).otherwise(F.lit(0.0))))
            done += part
        for upto, value in reversed(pieces):
            solved = F.when(share <= upto, value).otherwise(solved)
        out = F.when(kind == index, solved) if out is None else out.when(kind == index, solved)
    return out


def mix(docs: DataFrame, schedules: Sequence[Schedule] = RAMPS, repeats: int = 3, key: str = "doc_id", text: str = "text", carried: bool = True) -> DataFrame:
    """key, source, size, source_size, target, taken, ``positions`` (array of training times, one per
    copy) and, if ``carried``, ``doc`` (struct of all columns) for each row of ``docs``.

    A copy is taken if its middle word lies within the source's target, so a source's taken words
    differ from its target by half a document at most. The order in a source is by MD5 of the key;
    hot sources are split into buckets of that order (about ROWS_PER_BUCKET rows each), and only
    bucket sums are scanned across buckets.
    """
    spot = F.coalesce(F.md5(F.col(key).cast("string")), F.lit(""))
    doc = [F.struct("*").alias("doc")] if carried else []
    own = docs.select(key, "source", word_count(F.col(text)).alias("size"), spot.alias("_spot"), *doc)
    place = F.conv(F.substring("_spot", 1, 8), 16, 10).cast("long")
    counts = stored(docs.groupBy("source").agg(F.ceil(F.count("*") / ROWS_PER_BUCKET).alias("_buckets")), "source-rows")
    bucketed = own.join(F.broadcast(counts) if counts.count() <= 10_000 else counts, own["source"].eqNullSafe(counts["source"])).drop(counts["source"])
    bucketed = bucketed.withColumn("_bucket", F.coalesce((place * F.col("_buckets") / F.lit(1 << 32)).cast("long"), F.lit(0)))
    sums = stored(bucketed.groupBy("source", "_bucket").agg(F.sum("size").alias("_words")), "bucket-words")
    targets = stored(source_targets(sums.groupBy("source").agg(F.sum("_words").alias("source_size")), schedules, repeats), "source-targets")
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_spot", key, "size").rowsBetween(Window.unboundedPreceding, -1)
    out = bucketed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(offsets, out["source"].eqNullSafe(offsets["_s"]) & (out["_bucket"] == offsets["_b"])).drop("_s", "_b")
    facts = targets.withColumnRenamed("source", "_s")
    out = out.join(F.broadcast(facts) if facts.count() <= 10_000 else facts, out["source"].eqNullSafe(facts["_s"]))
    start = F.col("_off") + F.col("_in")
    middles = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda e: e * F.col("source_size") + start + F.col("size") / 2)
    chosen = F.when(F.col("size") > 0, F.filter(middles, lambda m: m <= F.col("target"))).otherwise(F.array().cast("array<double>"))
    out = out.withColumn("_middles", chosen).withColumn("taken", F.col("size") * F.size("_middles"))
    out = out.withColumn("positions", F.transform("_middles", lambda m: position(F.col("kind"), m / F.col("target"), schedules)))
    return out.select(key, "source", "size", "source_size", "target", "taken", "positions", *(["doc"] if carried else []))


def by_position(mixed: DataFrame, partitions: int | None = None, key: str = "doc_id") -> DataFrame:
    """One row per taken copy, range-sorted by training position (ties: key, then copy)."""
    copies = mixed.select("*", F.posexplode("positions").alias("copy", "position"))
    order = ["position", key, "copy"]
    ranged = copies.repartitionByRange(*([partitions] if partitions else []), *order)
    return ranged.sortWithinPartitions(*order)


def by_first_position(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every row once, range-sorted by the training position of its first copy (ties: key); rows that
    are not taken come last."""
    order = [F.get("positions", F.lit(0)).asc_nulls_last(), F.col(key).asc_nulls_first()]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)
