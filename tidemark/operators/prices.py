"""Price analytics: weighted means, outlier rules, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import DAY, HOUR, bucket
from ..sources.scratch import settled

INVERTED, EXCLUDED = ("signup",), ("error",)


def normalised(quotes: DataFrame) -> DataFrame:
    """Quotes on the common basis: inverted pairs as 1/mid, direct pairs if 0 < mid < 1, others dropped."""
    mid = F.col("mid")
    price = F.when(F.col("source").isin(*INVERTED), F.when(mid > 0, 1 / mid)).otherwise(F.when((mid > 0) & (mid < 1), mid))
    return quotes.withColumn("price", price).filter("price is not null")


def weighted_mean(price: Column, weight: Column) -> Column:
    """Sum of p w over sum of w; rows without weight drop out, no weight at all gives 0."""
    both = F.when(weight.isNotNull() & price.isNotNull(), weight)
    return F.coalesce(F.try_divide(F.sum(price * both), F.nullif(F.sum(both), F.lit(0))), F.lit(0.0))


def time_weights(quotes: DataFrame, as_of: Column, width_ms: int = 600_000) -> DataFrame:
    """``weight``: milliseconds until the next quote of any source, 1 at least; the last runs to ``as_of``.

    The next quote is looked up inside ten minutes, and across them through the first quote of each later ten
    minutes: one row for each is scanned in one task, never the quotes.
    """
    placed = quotes.withColumn("_span", F.floor(F.col("ts_ms") / width_ms))
    firsts = placed.groupBy("_span").agg(F.min("ts_ms").alias("_first"))
    firsts = firsts.select("_span", F.lead("_first").over(Window.partitionBy().orderBy("_span")).alias("_later"))
    inside = F.lead("ts_ms").over(Window.partitionBy("_span").orderBy("ts_ms", "id"))
    out = placed.withColumn("_next", inside).join(firsts, "_span")
    following = F.coalesce("_next", "_later", as_of)
    return out.withColumn("weight", F.greatest(following - F.col("ts_ms"), F.lit(1))).drop("_span", "_next", "_later")


def twap(quotes: DataFrame, as_of: Column) -> DataFrame:
    """Weights come from all quotes; excluded and invalid ones drop out only afterwards."""
    kept = normalised(time_weights(quotes, as_of)).filter(~F.col("source").isin(*EXCLUDED))
    return kept.agg(weighted_mean(F.col("price"), F.col("weight")).alias("twap"))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value at place floor(n / 2) + 1 in ascending order, per key.

    Approximate quantiles (off by a ten-thousandth of the rows at most) on both sides of the middle bound
    it; rows below are counted, and only the distinct values between are put in order, with their counts.
    The bounds are one row per key and are settled first: rows meet them without a shuffle where keys are few.
    """
    bounds = F.percentile_approx(value, F.array(F.lit(0.499), F.lit(0.501)), 10000)
    sides = settled(df.groupBy(*keys).agg(bounds.alias("_q"), F.count(value).alias("_all")))
    near = df.select(*keys, F.col(value).alias("_v")).join(sides, keys).filter(F.col("_v") <= F.get("_q", F.lit(1)))
    low = F.get("_q", F.lit(0))
    counts = near.groupBy(*keys, F.when(F.col("_v") >= low, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"), F.first("_all").alias("_all"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()))
    placed = counts.withColumn("_upto", upto).filter(F.col("_v").isNotNull() & (F.col("_upto") > F.floor(F.col("_all") / 2)))
    return placed.groupBy(*keys).agg(F.min("_v").alias("median"))


def modal(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most common value rounded half to even; ties: first seen."""
    counts = df.withColumn("_v", F.bround(F.col(value), 0)).groupBy(*keys, "_v").agg(F.count("*").alias("_c"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by("_v", F.struct("_c", -F.col("_first"))).alias("mode"))


def within_deviation(df: DataFrame, key: str, value: str, limit: float) -> DataFrame:
    """Rows within ``limit`` of their key's upper median; keys with fewer than two such rows keep all."""
    medians = settled(upper_median(df, [key], value))
    joined = df.join(medians, key).withColumn("_in", F.abs(F.col(value) - F.col("median")) / F.col("median") <= limit)
    joined = joined.join(settled(joined.groupBy(key).agg(F.count_if("_in").alias("_ins"))), key)
    return joined.filter(F.col("_in") | (F.col("_ins") < 2)).drop("_in", "_ins", "median")


def bucketed(quotes: DataFrame, width_ms: int, value: str, latest: bool = True) -> DataFrame:
    """Last (or first) value per source and tumbling bucket."""
    pick = F.max_by if latest else F.min_by
    return quotes.groupBy(bucket(F.col("ts_ms"), width_ms).alias("bucket"), "source").agg(pick(value, F.struct("ts_ms", "id")).alias(value))


def ewma(quotes: DataFrame, decay: float = 0.975, block_ms: int = HOUR) -> DataFrame:
    """Recursive mean and variance per source, in time order; the difference is to the previous mean.

    Quotes are folded inside blocks of time. With m the mean before a block less the block's first price
    p, and v the variance before it, the block leaves a mean of p + w m + c and a variance of
    w v + a + b m + e m^2. Only these numbers of each block meet in one row per source.
    """
    lam = F.lit(decay).cast("double")
    gain = 1 - lam
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "id", "price"))), lambda x: x["price"])
    blocks = quotes.groupBy("source", bucket(F.col("ts_ms"), block_ms).alias("at")).agg(ordered.alias("xs")).withColumn("p", F.get("xs", F.lit(0)))

    def inside(acc: Column, x: Column) -> Column:
        w, y = acc["w"], x - F.col("p")
        delta = y - acc["c"]
        return F.struct(
            (lam * w).alias("w"),
            (lam * acc["c"] + gain * y).alias("c"),
            (lam * acc["a"] + gain * delta * delta).alias("a"),
            (lam * acc["b"] - 2 * gain * delta * w).alias("b"),
            (lam * acc["e"] + gain * w * w).alias("e"),
        )

    none = F.struct(F.lit(1.0).alias("w"), *(F.lit(0.0).alias(x) for x in "cabe"))
    folded = blocks.select("source", "at", "p", F.aggregate("xs", none, inside).alias("f")).select("source", "at", "p", "f.*")
    rows = folded.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("at", "p", *"wcabe"))).alias("blocks"))

    def across(acc: Column, k: Column) -> Column:
        m = acc["mean"] - k["p"]
        return F.struct((k["p"] + k["w"] * m + k["c"]).alias("mean"), (k["w"] * acc["var"] + k["a"] + k["b"] * m + k["e"] * m * m).alias("var"))

    start = F.struct(F.get("blocks", F.lit(0))["p"].alias("mean"), F.lit(0.0).alias("var"))
    return rows.select("source", F.inline(F.array(F.aggregate("blocks", start, across))))
