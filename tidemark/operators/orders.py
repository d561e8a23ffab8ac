"""Venue payloads to typed rows, order normalisation and quoting ladders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import payloads as P
from ..sources.scratch import settled


def book_levels(payloads: DataFrame) -> DataFrame:
    """id, side, price, amount of successful book payloads; levels without a positive price drop out."""
    schema = "struct<status:string,data:struct<bids:array<array<string>>,asks:array<array<string>>>>"
    made = payloads.select("id", F.from_json("payload", schema).alias("b")).filter("b.status = 'success'")

    def side(name: str) -> Column:
        return F.transform(f"b.data.{name}s", lambda x: F.struct(F.lit(name).alias("side"), P.number(x[0]).alias("price"), P.number(x[1]).alias("amount")))

    return made.select("id", F.inline(F.concat(side("bid"), side("ask")))).filter("price > 0")


def tickers(payloads: DataFrame) -> DataFrame:
    """id, source, buy, sell, last of ticker payloads; 0 where one is missing."""
    value = lambda name: F.coalesce(P.number(F.get_json_object("payload", f"$.ticker.{name}")), F.lit(0.0)).alias(name)
    return payloads.select("id", "source", *map(value, ("buy", "sell", "last")))


def quotes_of_tickers(rows: DataFrame) -> DataFrame:
    """Quotes of the inverse pair: bid from the sell side, ask from the buy side, both from the last price
    where a ticker has neither. Rows without any price drop out."""
    empty = (F.col("buy") <= 0) & (F.col("sell") <= 0)
    out = rows.withColumns({name: F.when(empty, F.col("last")).otherwise(F.col(name)) for name in ("buy", "sell")})
    inverse = lambda name: F.when(F.col(name) > 0, 1 / F.col(name)).otherwise(0.0)
    out = out.withColumns({"bid": inverse("sell"), "ask": inverse("buy")})
    mid = F.when((F.col("bid") > 0) & (F.col("ask") > 0), (F.col("bid") + F.col("ask")) / 2).otherwise(inverse("last"))
    return out.withColumn("mid", mid).filter("mid > 0").select("id", "bid", "ask", "mid")


def quotes_of_summary(rows: DataFrame) -> DataFrame:
    """Quotes as they stand; the last price takes the place of both sides if both are 0, and of the mid
    unless both are positive."""
    empty = (F.col("buy") == 0) & (F.col("sell") == 0)
    sides = rows.select("id", "last", F.when(empty, F.col("last")).otherwise(F.col("buy")).alias("bid"), F.when(empty, F.col("last")).otherwise(F.col("sell")).alias("ask"))
    mid = F.when((F.col("bid") > 0) & (F.col("ask") > 0), (F.col("bid") + F.col("ask")) / 2).otherwise(F.col("last"))
    return sides.filter("not (bid = 0 and ask = 0)").select("id", "bid", "ask", mid.alias("mid"))


def p2p_ads(payloads: DataFrame) -> DataFrame:
    """id, total, price, orders, rate, release, online, quantity of every advertisement of a page."""
    item = "struct<price:string,recentOrderNum:int,recentExecuteRate:double,releaseTime:double,isOnline:boolean,lastQuantity:string>"
    made = payloads.select("id", F.from_json("payload", f"struct<result:struct<count:int,items:array<{item}>>>").alias("p"))
    ads = made.select("id", F.col("p.result.count").alias("total"), F.explode("p.result.items").alias("a"))
    return ads.select(
        "id", "total", P.number(F.col("a.price")).alias("price"), F.coalesce("a.recentOrderNum", F.lit(0)).alias("orders"), F.coalesce("a.recentExecuteRate", F.lit(0.0)).alias("rate"), F.col("a.releaseTime").alias("release"),
        F.coalesce("a.isOnline", F.lit(False)).alias("online"), F.coalesce(P.number(F.col("a.lastQuantity")), F.lit(0.0)).alias("quantity"),
    )


def reputable(ads: DataFrame, orders: int = 100, rate: float = 90.0, release: float = 900.0) -> DataFrame:
    """Advertisements of makers with enough orders, a completion rate in percent and a release time in seconds that
    will do, who are online; one without a release time is not known well enough."""
    return ads.filter((F.col("orders") >= orders) & (F.col("rate") >= rate) & (F.col("release") <= release) & F.col("online"))


def route_rates(payloads: DataFrame) -> DataFrame:
    """id, rates (one a route, null unless positive; inverted where the route says so), valid, and their mean."""
    made = payloads.select("id", F.from_json("payload", "struct<routes:array<struct<rate:string,invert:boolean>>>")["routes"].alias("routes"))
    rate = lambda x: F.when(P.number(x["rate"]) > 0, F.when(x["invert"], 1 / P.number(x["rate"])).otherwise(P.number(x["rate"])))
    out = made.select("id", F.transform("routes", rate).alias("rates")).withColumn("known", F.filter("rates", lambda x: x.isNotNull()))
    mean = F.when(F.size("known") > 0, F.aggregate("known", F.lit(0.0), lambda t, x: t + x) / F.size("known"))
    return out.select("id", "rates", F.size("known").alias("valid"), mean.alias("mean"))


def ramp_rows(payloads: DataFrame, least: float = 100.0) -> DataFrame:
    """id, side, rate, balance of book rows with at least ``least`` and a positive rate; malformed ones go."""
    made = payloads.select("id", F.explode(F.from_json("payload", "array<struct<side:string,rate:string,balanceUsd:string>>")).alias("x"))
    balance = P.number(F.coalesce(F.nullif("x.balanceUsd", F.lit("")), F.lit("0")))
    return made.select("id", "x.side", P.number(F.col("x.rate")).alias("rate"), balance.alias("balance")).filter((F.col("balance") >= least) & (F.col("rate") > 0))


def ramp_quotes(rows: DataFrame) -> DataFrame:
    """Best sell rate as bid and best buy rate as ask, where both sides have rows."""
    side = lambda name: F.when(F.col("side") == name, F.col("rate"))
    return rows.groupBy("id").agg(F.max(side("sell")).alias("bid"), F.min(side("buy")).alias("ask")).filter("bid is not null and ask is not null")


def chain_orders(payloads: DataFrame) -> DataFrame:
    """id, side, price, size, desired, filled; the price is the one shown to users."""
    order = "array<struct<desired_amount:string,filled_amount:string,spot_contract:struct<ui_intent:struct<price:string,size:string>>>>"
    made = payloads.select("id", F.from_json("payload", f"struct<bids:{order},asks:{order}>").alias("b"))
    both = made.select("id", F.inline(F.array(F.struct(F.lit("bid").alias("side"), F.col("b.bids").alias("xs")), F.struct(F.lit("ask").alias("side"), F.col("b.asks").alias("xs")))))
    rows = both.select("id", "side", F.explode("xs").alias("x"))
    value = lambda path, name: P.number(F.col(f"x.{path}")).alias(name)
    out = rows.select("id", "side", value("spot_contract.ui_intent.price", "price"), value("spot_contract.ui_intent.size", "size"), value("desired_amount", "desired"), F.coalesce(P.number(F.col("x.filled_amount")), F.lit(0.0)).alias("filled"))
    return out.filter("price > 0 and desired > 0 and filled >= 0 and size >= 0")


def parsed(payloads: DataFrame) -> DataFrame:
    """id, venue, side, status, created, whole (no remaining volume stated) and the five numbers of each order payload,
    which is parsed once: nested objects come as text."""
    names = ("price", "volume", "origin_volume", "remaining_volume", "executed_volume")
    fields = payloads.select("id", "venue", F.json_tuple("payload", "side", "state", "status", "created_at", *names).alias("side", "state", "status", "created", *names))
    status = F.lower(F.coalesce(F.nullif("state", F.lit("")), F.col("status"), F.lit("")))
    side = F.lower("side")
    value = lambda n: P.field_value(F.col(n)).alias(n)
    return fields.select("id", "venue", F.when(side.isin("buy", "sell"), side).alias("side"), status.alias("status"), P.time_ms(F.col("created")).alias("created"), F.col("remaining_volume").isNull().alias("whole"), *map(value, names))


def normalised(payloads: DataFrame) -> DataFrame:
    """Orders with a side and a price: id, venue, side, status, price, volume, remaining, executed,
    notional, created. Missing volumes follow from those that are there."""
    out = parsed(payloads).withColumn("status", F.nullif("status", F.lit("")))
    out = out.filter(F.col("side").isNotNull() & (F.col("price") > 0))
    out = out.withColumn("volume", F.when(F.col("volume") <= 0, F.col("origin_volume")).otherwise(F.col("volume")))
    base = F.when(F.col("origin_volume") > 0, F.col("origin_volume")).otherwise(F.col("volume"))
    derived = F.when(base > F.col("executed_volume"), base - F.col("executed_volume")).otherwise(base)
    out = out.withColumn("remaining", F.greatest(F.lit(0.0), F.when(F.col("remaining_volume") <= 0, derived).otherwise(F.col("remaining_volume"))))
    whole = F.when(F.col("origin_volume") > 0, F.col("origin_volume")).otherwise(F.col("remaining") + F.col("executed_volume"))
    out = out.withColumn("volume", F.when(F.col("volume") <= 0, whole).otherwise(F.col("volume")))
    notional = F.col("price") * F.when(F.col("remaining") > 0, F.col("remaining")).otherwise(F.col("volume"))
    return out.select("id", "venue", "side", "status", "price", "volume", "remaining", F.col("executed_volume").alias("executed"), notional.alias("notional"), "created")


def resting(payloads: DataFrame, states: Sequence[str] = ("wait", "pending_cancel")) -> DataFrame:
    """id, venue, side, price, volume (what remains, or the whole where that is not stated) of open orders."""
    left = F.when(F.col("whole"), F.col("volume")).otherwise(F.col("remaining_volume"))
    out = parsed(payloads).filter(F.col("status").isin(*states)).select("id", "venue", "side", "price", left.alias("volume"))
    return out.filter("side is not null and price > 0 and volume > 0")


def tracked(payloads: DataFrame, status: str = "pending_cancel") -> DataFrame:
    return payloads.filter(P.order_status(F.col("payload")) == status).select("venue", "id", "payload")


def saved_tracked(orders: DataFrame, parts: int = 1000) -> DataFrame:
    """venue, part, value: orders as JSON arrays, cut by id so that no array grows with a venue."""
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
    return orders.groupBy("venue", part).agg(F.concat(F.lit("["), F.array_join(F.collect_list("payload"), ","), F.lit("]")).alias("value"))


def read_tracked(saved: DataFrame) -> DataFrame:
    """venue, id (text) of every order in saved arrays."""
    return saved.select("venue", F.explode(F.from_json("value", "array<struct<id:string>>")).alias("o")).select("venue", "o.id")


def placed_by_side(orders: DataFrame, parts: int = 64) -> DataFrame:
    """``place`` of each order in its venue: by side, best price first, then id.

    Orders of a side are cut at approximate quantiles of their prices; rows are put in order inside a cut, and the
    numbers of rows in the cuts before it are added. A venue's orders do not meet in one task. The quantiles of many
    rows depend on the order in which parts are merged, so they are settled: both readings cut at the same prices.
    """
    shares = F.array(*(F.lit(k / parts) for k in range(1, parts)))
    bounds = settled(orders.groupBy("venue", "side").agg(F.percentile_approx("price", shares, 1000).alias("_bounds")))
    rows = orders.join(bounds, ["venue", "side"])
    rows = rows.withColumn("_cut", F.size(F.filter("_bounds", lambda b: b > F.col("price")))).drop("_bounds")
    cuts = rows.groupBy("venue", "side", "_cut").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("venue").orderBy("side", "_cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.select("venue", "side", "_cut", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("venue", "side", "_cut").orderBy(F.col("price").desc(), "id"))
    return rows.withColumn("_inside", inside).join(cuts, ["venue", "side", "_cut"]).withColumn("place", (F.col("_ahead") + F.col("_inside")).cast("int")).drop("_cut", "_inside", "_ahead")


def anchors(orders: DataFrame, key: str) -> DataFrame:
    """Middle of the best buy and the best sell; null if a side is empty."""
    buy, sell = F.max(F.when(F.col("side") == "buy", F.col("price"))), F.min(F.when(F.col("side") == "sell", F.col("price")))
    return orders.groupBy(key).agg(((buy + sell) / 2).alias("anchor"))


def ladder_sizes(state: DataFrame, ngn_size: float, usd_size: float, levels: int, strength: float) -> DataFrame:
    """Sizes of one level from (ref, ngn, usd): equal notionals, tilted towards selling the overweight
    asset, at most the balance less one percent over the levels."""
    worth = F.col("ngn") / F.col("ref") + F.col("usd")
    base = F.least(F.lit(ngn_size), usd_size * F.col("ref"))
    tilt = F.when(worth > 0, (F.col("usd") - F.col("ngn") / F.col("ref")) / worth).otherwise(0.0)
    capped = lambda size, held: F.least(size, F.col(held) * 0.99 / levels)
    return state.withColumns({"ngn_size": capped(base * (1 - strength * tilt), "ngn"), "usd_size": capped(base / F.col("ref") * (1 + strength * tilt), "usd")})


def ladder_targets(sizes: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """venue, side, price, volume: buys below and sells above the reference; buy prices and volumes are
    rounded down to cents, sell prices up."""
    cents = lambda x: F.round(x * 100, 4)  # noqa: E731  so that 1.15 * 100 is 115
    rows = sizes.select("venue", "ref", "ngn_size", "usd_size", F.explode(F.array(*map(F.lit, offsets))).alias("off"))
    low, high = F.col("ref") - F.col("off"), F.col("ref") + F.col("off")
    buy = F.when((F.col("ngn_size") > 0) & (low > 0), F.struct(F.lit("buy").alias("side"), (F.floor(cents(low)) / 100).alias("price"), (F.floor(cents(F.col("ngn_size") / low)) / 100).alias("volume")))
    sell = F.when(F.col("usd_size") > 0, F.struct(F.lit("sell").alias("side"), (F.ceil(cents(high)) / 100).alias("price"), (F.floor(cents(F.col("usd_size"))) / 100).alias("volume")))
    return rows.select("venue", F.inline(F.filter(F.array(buy, sell), lambda x: x.isNotNull()))).filter("volume > 0")


def zipped(current: DataFrame, desired: DataFrame, key: str) -> DataFrame:
    """key, rank, current, desired: orders of both ladders by rank (side, price, volume)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("side", "price", "volume"))
    side = lambda df, name: df.select(key, rank.alias("rank"), F.struct("side", "price", "volume").alias(name))
    return side(current, "current").join(side(desired, "desired"), [key, "rank"])


def requote_reasons(current: DataFrame, desired: DataFrame, key: str, most_bps: float, tolerance: float = 0.01) -> DataFrame:
    """key, reason why resting orders should be replaced: unequal counts, else the first difference by
    rank in side, price or volume; null if there is none."""
    numbers = current.groupBy(key).agg(F.count("*").alias("n")).join(desired.groupBy(key).agg(F.count("*").alias("m")), key, "full_outer")
    drift = F.abs(F.col("current.price") - F.col("desired.price")) / F.col("desired.price") * 10000
    why = (
        F.when(F.col("current.side") != F.col("desired.side"), "side_mismatch")
        .when((F.col("desired.price") <= 0) | (drift > most_bps), "anchor_move")
        .when(F.abs(F.col("current.volume") - F.col("desired.volume")) > tolerance, "size_change")
    )
    first = zipped(current, desired, key).withColumn("why", why).filter("why is not null").groupBy(key).agg(F.min_by("why", "rank").alias("why"))
    unequal = F.coalesce("n", F.lit(0)) != F.coalesce("m", F.lit(0))
    return numbers.join(first, key, "left").select(key, F.when(unequal, "count_mismatch").otherwise(F.col("why")).alias("reason"))


def decoded_swaps(logs: DataFrame, least: int = 192) -> DataFrame:
    """Logs with their signed amounts; payloads shorter than ``least`` bytes drop out."""
    sized = logs.withColumn("bytes", F.floor(F.length(P.bare_hex(F.col("data"))) / 2).cast("int")).filter(F.col("bytes") >= least)
    return sized.withColumns({"amount0": P.signed_word(F.col("data"), 0), "amount1": P.signed_word(F.col("data"), 1)})


def stable_volume(data: Column, stable_token: Column, decimals: int) -> Column:
    """Absolute amount of the stable token (0 or 1; null: none); 0 for payloads under 64 bytes."""
    amount = F.when(stable_token == 0, P.signed_word(data, 0)).when(stable_token == 1, P.signed_word(data, 1))
    return F.when(F.length(P.bare_hex(data)) < 128, 0.0).otherwise(F.coalesce(F.abs(amount) / 10.0**decimals, F.lit(0.0)))


def block_chunks(ranges: DataFrame, size: int) -> DataFrame:
    """id, first_block, last_block: inclusive ranges of at most ``size`` blocks that cover lo to hi."""
    starts = F.explode(F.sequence("lo", "hi", F.lit(size).cast("bigint"))).alias("first_block")
    return ranges.filter("lo <= hi").select("id", "hi", starts).select("id", "first_block", F.least(F.col("first_block") + size - 1, F.col("hi")).alias("last_block"))
