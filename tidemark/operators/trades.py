"""Trade lifecycle, risk and portfolio folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import DAY

TERMINAL = ("executed", "failed")


def attempt_stats(attempts: DataFrame, since: Column | None = None) -> DataFrame:
    own = attempts if since is None else attempts.filter(F.col("detected_ms") >= since)
    done = F.col("status") == "completed"
    return own.agg(
        F.count("*").alias("detected"),
        F.count_if(done).alias("executed"),
        F.coalesce(F.sum(F.when(done, F.col("actual_profit"))), F.lit(0.0)).alias("profit"),
        F.coalesce(F.sum(F.when(done, F.coalesce("executed_size", F.lit(0.0)))), F.lit(0.0)).alias("volume"),
    )


def history(events: DataFrame, attempts: DataFrame, limit: int, from_ts: int | None = None, to_ts: int | None = None, pipeline: str | None = None) -> DataFrame:
    """Latest attempts with one folded row each, in one plan.

    ``to_ts`` filters events; ``from_ts`` filters attempts by their latest matching event, so older
    events of a kept attempt remain. Size and wallet come from the first routed event (else the first),
    result, actual profit and moved coins from the last terminal event (else the last), type, reason, venues and
    hash from the last.
    """
    facts = attempts if pipeline is None else attempts.filter(F.col("pipeline") == pipeline)
    joined = events.join(facts.select(F.col("id").alias("attempt_id"), "pipeline", "direction"), "attempt_id")
    if to_ts is not None:
        joined = joined.filter(F.col("ts_ms") <= to_ts)
    at, row = F.struct("ts_ms", "event_id"), F.struct("event_type", "ts_ms", "size", "expected", "reason", "buy_venue", "sell_venue", "wallet", "tx_hash", "gain", "moved")
    routed, ended = F.col("event_type") == "routed", F.col("event_type").isin(*TERMINAL)
    folded = joined.groupBy("attempt_id", "pipeline", "direction").agg(
        F.coalesce(F.min_by(F.when(routed, row), F.when(routed, at)), F.min_by(row, at)).alias("routed"),
        F.coalesce(F.max_by(F.when(ended, row), F.when(ended, at)), F.max_by(row, at)).alias("final"),
        F.max_by(row, at).alias("latest"),
        F.count("*").alias("n_events"),
    )
    if from_ts is not None:
        folded = folded.filter(F.col("latest.ts_ms") >= from_ts)
    return folded.orderBy(F.col("latest.ts_ms").desc(), F.col("attempt_id").desc()).limit(limit).select(
        "attempt_id", "pipeline", "direction", F.col("routed.ts_ms").alias("routed_at"), F.col("routed.size").alias("size"), F.col("final.expected").alias("result"),
        F.col("latest.event_type").alias("last_event"), F.col("latest.ts_ms").alias("last_at"), F.col("latest.reason").alias("reason"), "n_events",
        "latest.buy_venue", "latest.sell_venue", "routed.wallet", "latest.tx_hash", F.col("final.gain").alias("actual_profit"), "final.moved",
    )


def daily_pnl(trades: DataFrame) -> DataFrame:
    gain, loss = F.when(F.col("profit") >= 0, F.col("profit")), F.when(F.col("profit") < 0, -F.col("profit"))
    return trades.groupBy("desk", F.floor(F.col("ts_ms") / DAY).alias("day")).agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("profit"), F.coalesce(F.sum(loss), F.lit(0.0)).alias("loss"))


def breaker(trades: DataFrame, most_failures: int = 3, daily_loss: float = 500.0) -> DataFrame:
    """``streak`` of failed trades and ``active`` at each trade of a desk.

    A failed trade lengthens the streak, a completed one with a profit of 0 or more ends it, a completed
    loss leaves it. The breaker trips when the streak or the day's loss reaches its limit and stays until
    the day ends; then it and the streak are reset, while a streak below the limit runs on. Trades are
    scanned inside a desk's day; across days one row per day is folded.
    """
    day = F.floor(F.col("ts_ms") / DAY)
    order = Window.partitionBy("desk", "day").orderBy("ts_ms", "id")
    rows = trades.withColumn("day", day).withColumn("_island", F.count_if(~F.col("failed") & (F.col("profit") >= 0)).over(order))
    inside = Window.partitionBy("desk", "day", "_island").orderBy("ts_ms", "id")
    lost = F.sum(F.when(~F.col("failed") & (F.col("profit") < 0), -F.col("profit"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_own": F.count_if("failed").over(inside), "day_loss": F.coalesce(lost, F.lit(0.0))})
    first = F.col("_island") == 0
    days = rows.groupBy("desk", "day").agg(
        F.coalesce(F.max(F.when(first, F.col("_own"))), F.lit(0)).alias("before"), (F.max("_island") > 0).alias("ended"), F.coalesce(F.max(F.when(~first, F.col("_own"))), F.lit(0)).alias("most"),
        F.max_by("_own", F.struct("ts_ms", "id")).alias("last"), F.max("day_loss").alias("loss"),
    )
    listed = F.array_sort(F.collect_list(F.struct("day", "before", "ended", "most", "last", "loss")))
    state = "struct<carried:bigint,days:array<struct<day:bigint,carried:bigint>>>"

    def step(at: Column, d: Column) -> Column:
        reached = (at["carried"] + d["before"] >= most_failures) & (d["before"] > 0)
        tripped = reached | (d["most"] >= most_failures) | (d["loss"] >= daily_loss)
        left = F.when(tripped, F.lit(0)).when(d["ended"], d["last"]).otherwise(at["carried"] + d["last"])
        return F.struct(left.cast("bigint").alias("carried"), F.concat(at["days"], F.array(F.struct(d["day"].alias("day"), at["carried"].alias("carried")))).alias("days")).cast(state)

    start = F.struct(F.lit(0).cast("bigint").alias("carried"), F.array().cast("array<struct<day:bigint,carried:bigint>>").alias("days")).cast(state)
    carried = days.groupBy("desk").agg(listed.alias("ds")).select("desk", F.inline(F.aggregate("ds", start, step)["days"]))
    out = rows.join(carried, ["desk", "day"]).withColumn("streak", F.col("_own") + F.when(first, F.col("carried")).otherwise(0))
    trips = (F.col("failed") & (F.col("streak") >= most_failures)) | (F.col("day_loss") >= daily_loss)
    return out.withColumn("active", F.max(trips).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_island", "_own", "carried", "day")


def null_safe_totals(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums that are null if any part is unknown."""
    return df.groupBy(*keys).agg(F.when(F.count(value) == F.count("*"), F.sum(value)).alias("total"), F.count("*").alias("sources"))


def can_trade(breaker_active: Column, volume: Column, size: Column, loss: Column, balance: Column, max_volume: float, max_loss: float, min_balance: float) -> Column:
    """First failing reason, null if none; ``volume`` is that of the last 24 hours without the trade."""
    return F.when(breaker_active, "breaker").when(volume + size > max_volume, "volume").when(loss >= max_loss, "daily_loss").when(balance < min_balance, "low_inventory")


def allocation_shares(held: DataFrame, account: str, venue: str, spot: float = 0.00066) -> DataFrame:
    """``value`` and its ``share`` (percent) of the account's total per venue of (account, venue 0 to 2, base, usd,
    exact): ``exact`` where it is known, else dollars plus base tokens at ``spot``. Without any value the venues
    share 33.3, 33.3 and 33.4 percent."""
    out = held.withColumn("value", F.coalesce("exact", F.col("usd") + F.col("base") * spot))
    total = F.sum("value").over(Window.partitionBy(account))
    even = F.when(F.col(venue) == 2, 33.4).otherwise(33.3)
    return out.withColumn("share", F.when(total == 0, even).otherwise(F.try_divide(F.col("value"), total) * 100))
