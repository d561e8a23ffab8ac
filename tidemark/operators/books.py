"""Order books: cumulative depth and walks as prefix sums inside a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(side: str) -> list[Column]:
    price = F.col("price").asc() if side == "ask" else F.col("price").desc()
    return [price, F.col("level_id"), F.col("part")]


def depth(levels: DataFrame, side: str, most: int = 15) -> DataFrame:
    """Running amount over the best ``most`` levels of a side, with rank and share of the total."""
    own = Window.partitionBy("book_id").orderBy(*_order(side))
    out = levels.filter(F.col("side") == side).withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= most)
    out = out.withColumn("depth", F.sum("amount").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("ratio", F.col("depth") / F.max("depth").over(Window.partitionBy("book_id")))


def walk(levels: DataFrame, side: str, size: float, fee: float, capacity: Column, gain: Column) -> DataFrame:
    """Per book: ``size`` consumed level by level (``capacity`` each), valued by ``gain`` of the part taken."""
    own = Window.partitionBy("book_id").orderBy(*_order(side)).rowsBetween(Window.unboundedPreceding, -1)
    out = levels.filter(F.col("side") == side).withColumn("cap", capacity)
    out = out.withColumn("take", F.greatest(F.lit(0.0), F.least(F.col("cap"), size - F.coalesce(F.sum("cap").over(own), F.lit(0.0)))))
    return out.groupBy("book_id").agg((F.sum(gain) * (1 - fee)).alias("out"), F.sum("take").alias("used"))


def walk_asks(levels: DataFrame, size: float, fee: float = 0.001) -> DataFrame:
    return walk(levels, "ask", size, fee, F.col("amount") * F.col("price"), F.col("take") / F.col("price"))


def walk_bids(levels: DataFrame, size: float, fee: float = 0.001) -> DataFrame:
    return walk(levels, "bid", size, fee, F.col("amount"), F.col("take") * F.col("price"))


def book_inverse(levels: DataFrame, wanted: float, fee: float = 0.001) -> DataFrame:
    """Quote size whose sale against the bids yields ``wanted`` after the fee."""
    gross = wanted / (1 - fee)
    valid = levels.filter("price > 0 and amount > 0")
    return walk(valid, "bid", gross, 0.0, F.col("amount") * F.col("price"), F.col("take") / F.col("price"))


def best_quotes(levels: DataFrame) -> DataFrame:
    """Best bid and ask per book; null where a side is empty."""
    bid = F.max(F.when(F.col("side") == "bid", F.col("price")))
    ask = F.min(F.when(F.col("side") == "ask", F.col("price")))
    both = F.count_if(F.col("side") == "bid") * F.count_if(F.col("side") == "ask") > 0
    return levels.groupBy("book_id").agg(F.when(both, bid).alias("bid"), F.when(both, ask).alias("ask"))
