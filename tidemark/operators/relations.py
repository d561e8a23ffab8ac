"""Filters, keyed writes, joins and window folds over relations; each takes and returns DataFrames."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def optional_filters(df: DataFrame, time: str, status: str | None = None, from_ts: int | None = None, to_ts: int | None = None) -> DataFrame:
    if status is not None:
        df = df.filter(F.col("status") == status)
    if from_ts is not None:
        df = df.filter(F.col(time) >= from_ts)
    return df if to_ts is None else df.filter(F.col(time) <= to_ts)


#: Most rows that a request of a kind gets.
LIMITS = {"prices": 5000, "actions": 200, "attempts": 200, "history": 200, "alerts": 100}


def limit_of(kind: Column) -> Column:
    """Cap of a kind of request, null for unknown kinds (no cap)."""
    out = F.lit(None).cast("int")
    for name, most in LIMITS.items():
        out = F.when(kind == name, most).otherwise(out)
    return out


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key: one hash aggregation of structs, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(df.columns)


def n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", place).filter(F.col("_n") <= n).drop("_n")


def upsert_coalesce(log: DataFrame, key: str, order: Sequence[str], keep_old: Sequence[str], overwrite: Sequence[str]) -> DataFrame:
    """State of a change log: last non-null value of ``keep_old`` columns, last value of the others."""
    at = F.struct(*order)
    held = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), at)).alias(c) for c in keep_old]
    last = [F.max_by(c, at).alias(c) for c in overwrite]
    return log.groupBy(key).agg(*held, *last)


def expire_stale(df: DataFrame, as_of: Column, age_ms: int) -> DataFrame:
    stale = F.col("status").isin("detected", "executing") & (F.col("detected_ms") < as_of - age_ms)
    return df.withColumns({"status": F.when(stale, "expired").otherwise(F.col("status")), "reason": F.when(stale, "Timeout")})


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def rolling_sum(df: DataFrame, key: str, time: str, value: str, span_ms: int, name: str, steps: int = 96) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the key's rows of the last ``span_ms``, own time included.

    A span has ``steps`` steps at most, and only rows of one step meet: those that come in it, those that leave the span in
    it, and one row with the sum of the steps before, which is a window over one row a step.
    """
    steps = math.gcd(span_ms, steps)  # steps make up the span exactly
    width = span_ms // steps
    step = F.floor(F.col(time) / width)
    part = lambda step_, at, sign: F.struct(step_.alias("_step"), at.alias("_time"), sign.alias("_value"))
    both = F.array(part(step, F.col(time), F.col(value).cast("double")), part(F.floor((F.col(time) + span_ms) / width), F.col(time) + span_ms, -F.col(value).cast("double")))
    spread = df.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(time).alias("_own"), F.inline(both))
    spread = spread.withColumn("_row", F.when(F.col("_own") == F.col("_time"), F.col("_row"))).drop("_own")
    sums = df.groupBy(F.col(key).alias("_key"), step.alias("_step")).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_key").orderBy("_step").rangeBetween(-steps, -1))
    base = sums.select("_key", "_step", (F.col("_step") * width - 1).alias("_time"), before.cast("double").alias("_value"))
    last = Window.partitionBy("_key", "_step").orderBy("_time").rangeBetween(Window.unboundedPreceding, 0)
    return spread.unionByName(base, allowMissingColumns=True).withColumn(name, F.sum("_value").over(last)).filter("_row IS NOT NULL").select("_row.*", name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Insert-or-ignore: the first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, "_row.*").select(df.columns)


def struct_or_null(**parts: Column) -> Column:
    """A struct of the parts, null if all of them are."""
    return F.when(F.coalesce(*(F.when(c.isNotNull(), 1) for c in parts.values())).isNotNull(), F.struct(*(c.alias(n) for n, c in parts.items())))


def lower_merged(held: Column) -> Column:
    """A map with lower-case keys; values of keys that become equal are added."""
    keys = F.array_distinct(F.transform(F.map_keys(held), lambda k: F.lower(k)))
    total = lambda key: F.aggregate(F.filter(F.map_entries(held), lambda e: F.lower(e["key"]) == key), F.lit(0.0), lambda t, e: t + e["value"])
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, total(k))))


def ownership(moves: DataFrame) -> DataFrame:
    """owner, token, owned: each pair of ``moves`` (token, sender, owner, at) in which the owner sent or got the token,
    and whether the token's latest move went to it."""
    pairs = moves.select(F.col("sender").alias("owner"), "token").unionByName(moves.select("owner", "token")).dropDuplicates()
    latest = moves.groupBy("token").agg(F.max_by("owner", "at").alias("held"))
    return pairs.join(latest, "token").select("owner", "token", (F.col("held") == F.col("owner")).alias("owned"))
