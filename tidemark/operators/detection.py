"""Trade detection over pools and books, route selection, position rebalancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K

LIQUIDITY, POOL_FEE, BOOK_FEE = 2e4, 0.0005, 0.001
#: Pools whose curves one task writes out.
TASK_POOLS = 250


def _through_pools(x: Column, first: Column, second: Column) -> tuple[Column, Column]:
    """(moved, out): dollars into the first pool, its token into the second one."""
    moved = K.swap_1_for_0(x, F.lit(LIQUIDITY), first, POOL_FEE)
    return moved, K.swap_0_for_1(moved, F.lit(LIQUIDITY), second, POOL_FEE)


DIRECTIONS = (("a to b", "qa", "qb"), ("b to a", "qb", "qa"))


def pool_trades(pools: DataFrame, size: Column) -> DataFrame:
    """Both directions of a trade of ``size`` dollars through two pools with roots qa and qb."""
    made = []
    for name, first, second in DIRECTIONS:
        moved, out = _through_pools(size, F.col(first), F.col(second))
        made.append(F.struct(F.lit(name).alias("direction"), moved.alias("moved"), out.alias("usd_out")))
    return pools.select("*", F.inline(F.array(*made)))


def _profit(first: str, second: str):
    return lambda x: _through_pools(x, F.col(first), F.col(second))[1] - x


def best_pool_trades(pools: DataFrame, high: float = 15_000.0) -> DataFrame:
    """direction, size, profit: the best size of each direction, found by thirds."""
    sizes = [F.struct(F.lit(name).alias("direction"), F.lit(k).alias("place"), K.best_size(_profit(a, b), high).alias("size")) for k, (name, a, b) in enumerate(DIRECTIONS)]
    out = pools.select("*", F.inline(F.array(*sizes)))
    (_, a, b), (_, c, d) = DIRECTIONS
    return out.withColumn("profit", F.when(F.col("place") == 0, _profit(a, b)(F.col("size"))).otherwise(_profit(c, d)(F.col("size"))))


def best_direction(trades: DataFrame, key: str) -> DataFrame:
    best = trades.groupBy(key).agg(F.max_by(F.struct("direction", "size", "profit"), F.struct("profit", -F.col("place"))).alias("b"))
    return best.select(key, "b.*")


def pool_curve(pools: DataFrame, least: int = 5000) -> DataFrame:
    """Profit of both directions at whole sizes from 1 to ``least`` or 1.5 times the best size. A small table of pools
    makes thousands of rows of each, so pools are dealt out over tasks of TASK_POOLS."""
    pools = pools.repartition(-(-pools.count() // TASK_POOLS) or 1)
    best = F.greatest(*(K.best_size(_profit(a, b), 15_000.0) for _, a, b in DIRECTIONS))
    upto = pools.withColumn("upto", F.greatest(F.lit(least), (best * 1.5).cast("int")))
    grid = upto.withColumn("size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("upto").cast("bigint"))))
    x = F.col("size").cast("double")
    return grid.select("*", *(_profit(a, b)(x).alias(name.replace(" ", "_")) for name, a, b in DIRECTIONS))


def books_with_pools(levels: DataFrame) -> DataFrame:
    """book_id, bids (price, amount and the amount before it, best first) and the root price of a pool.

    A book's levels are one payload, as in a snapshot of an exchange.
    """
    order = Window.partitionBy("book_id", "side").orderBy(F.when(F.col("side") == "ask", F.col("price")).otherwise(-F.col("price")), "level_id", "part")
    ahead = F.coalesce(F.sum("amount").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = levels.select("book_id", "side", (F.col("price") / 1000).alias("p"), F.col("amount").alias("a"), ahead.alias("b"))
    bids = F.array_sort(F.collect_list(F.when(F.col("side") == "bid", F.struct("b", "p", "a"))))
    books = rows.groupBy("book_id").agg(bids.alias("bids"), F.avg("p").alias("mid"), F.count_distinct("side").alias("sides")).filter("sides = 2")
    return books.select("book_id", "bids", F.sqrt(1 / F.col("mid") * (1 + (F.col("book_id") % 9 - 4) / 100.0)).alias("q"))


def _sold(bids: Column, size: Column) -> Column:
    gain = F.aggregate(bids, F.lit(0.0), lambda total, x: total + F.greatest(F.lit(0.0), F.least(x["a"], size - x["b"])) * x["p"])
    return gain * (1 - BOOK_FEE)


def book_trades(books: DataFrame, size: Column) -> DataFrame:
    """moved: proceeds of ``size`` sold to the bids; usd_out: what the pool pays for them."""
    moved = _sold(F.col("bids"), size)
    return books.withColumn("moved", moved).withColumn("usd_out", K.swap_0_for_1(F.col("moved"), F.lit(LIQUIDITY), F.col("q"), POOL_FEE))


def best_book_trades(books: DataFrame, probe: float = 5.0, high: float = 5000.0) -> DataFrame:
    """size, profit: the best size of each book whose profit on ``probe`` is positive."""
    profit = lambda x: K.swap_0_for_1(_sold(F.col("bids"), x), F.lit(LIQUIDITY), F.col("q"), POOL_FEE) - x
    searched = books.filter(profit(F.lit(probe)) > 0).withColumn("size", K.best_size(profit, high))
    return searched.withColumn("profit", profit(F.col("size")))


def routed(candidates: DataFrame, routes: DataFrame) -> DataFrame:
    """Candidates whose direction is a known route between the same venues; ``routes`` is a registry."""
    found = candidates.join(F.broadcast(routes), "direction")
    return found.filter((F.col("buy") == F.col("buy_leg")) & (F.col("sell") == F.col("sell_leg"))).drop("buy_leg", "sell_leg")


def with_balances(candidates: DataFrame, balances: DataFrame) -> DataFrame:
    """buy_stable, sell_base: balances of both venues, null where unknown."""
    buys = balances.select(F.col("venue").alias("buy"), F.col("stable").alias("buy_stable"))
    sells = balances.select(F.col("venue").alias("sell"), F.col("base").alias("sell_base"))
    return candidates.join(F.broadcast(buys), "buy", "left").join(F.broadcast(sells), "sell", "left")


def capped(candidates: DataFrame, most: float, price: float) -> DataFrame:
    """``cap``: the size that funds, the largest trade and the sell side's token allow; venues with
    unknown or empty balances drop out."""
    funded = candidates.filter((F.col("buy_stable") > 0) & (F.col("sell_base") > 0))
    return funded.withColumn("cap", F.least("size", "buy_stable", F.lit(most), F.col("sell_base") * price))


def guarded(candidates: DataFrame, least: float) -> DataFrame:
    """``net`` profit at the cap less gas; positive sizes with a finite net of ``least`` or more."""
    out = candidates.filter("cap > 0").withColumn("net", F.col("profit") * F.col("cap") / F.col("size") - F.col("gas"))
    return out.filter((F.col("net") >= least) & ~F.isnan("net") & (F.abs("net") < float("inf")))


def scored(candidates: DataFrame, weight: float) -> DataFrame:
    """``improvement``: cost of the account's imbalance before less after the trade; ``score``."""
    base, total = F.col("sell_base") * 10, F.col("sell_base") * 10 + F.col("buy_stable")
    cost = lambda held, all_: all_ * F.pow(held / total - 0.5, F.lit(2))
    after = cost(base + F.col("cap"), base + F.col("cap") + F.col("buy_stable") - F.col("cap"))
    out = candidates.withColumn("improvement", cost(base, total) - after)
    return out.withColumn("score", F.col("net") + weight * F.col("improvement"))


def rebalances(positions: DataFrame) -> DataFrame:
    """direction, amount, least: the swap that brings a0 and a1 to the ratio of their range, where they are
    off by more than a hundredth of their value; a hundredth of slippage is accepted."""
    r0, r1 = K.required_ratio(F.col("root"), F.col("low"), F.col("high"))
    out = positions.withColumns({"r0": r0, "r1": r1, "price": F.col("root") * F.col("root")})
    out = out.withColumn("total", F.col("a0") * F.col("price") + F.col("a1")).filter("total > 0")
    unit = F.col("r0") * F.col("price") + F.col("r1")
    out = out.withColumn("t0", F.col("total") * F.col("r0") / F.when(unit > 0, unit).otherwise(1.0))
    out = out.withColumn("t1", F.greatest(F.lit(0.0), F.col("total") - F.col("t0") * F.col("price")))
    out = out.filter(F.abs(F.col("a0") - F.col("t0")) * F.col("price") > F.col("total") * 0.01)
    over = F.col("a0") > F.col("t0")
    spare0, spare1 = F.col("a0") - F.col("t0"), F.col("a1") - F.col("t1")
    return out.withColumns(
        {
            "direction": F.when(over, "0 to 1").otherwise("1 to 0"),
            "amount": F.when(over, spare0).otherwise(spare1),
            "least": F.when(over, spare0 * F.col("price") * 0.99).otherwise(spare1 / F.col("price") * 0.99),
        }
    )


def mean_of(rates: Column) -> Column:
    """Mean of the known ones; null if there are none."""
    known = F.filter(rates, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda t, x: t + x) / F.size(known))


def gated(sums: DataFrame, seeded: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` only of keys that are seeded, null otherwise."""
    return sums.join(seeded, key, "left").withColumn(value, F.when(F.col("seeded"), F.col(value)))
