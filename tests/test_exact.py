"""Exact integers against Python's own."""

import random

from pyspark.sql import functions as F

from tidemark.functions import exact


def test_words_are_integers(spark):
    rng = random.Random(5)
    values = [0, 1, -1, 10**9, -(10**9), 2**127 - 1, -(2**127), 2**255 - 1, -(2**255), 10**18 - 1, 10**27, *(rng.randrange(-(1 << b), 1 << b) for b in range(8, 256, 8) for _ in range(4))]
    rows = [(i, "0x" + (v % 2**256).to_bytes(32, "big").hex().upper() + f"{i:064x}") for i, v in enumerate(values)]
    frame = spark.createDataFrame([*rows, (-1, "0x00ff"), (-2, None), (-3, "0xzz")], "id int, data string")
    got = {r["id"]: r["w"] for r in frame.select("id", exact.words(F.col("data"), s=True, second=False, none=False).alias("w")).collect()}
    unsigned = {r["id"]: r["w"]["u"] for r in frame.select("id", exact.words(F.col("data"), u=False).alias("w")).collect()}
    for i, v in enumerate(values):
        assert (got[i]["s"], unsigned[i], got[i]["second"], got[i]["none"]) == (str(v), str(v % 2**256), str(i), None)
    assert all(got[i]["s"] is None and unsigned[i] is None for i in (-1, -2, -3))


def test_all_ticks(spark):
    from fractions import Fraction

    made = spark.range(-887_280, 887_281).select(F.col("id").alias("tick"), exact.root_x96_text(F.col("id").cast("int")).alias("root"))
    got = {r["tick"]: None if r["root"] is None else int(r["root"]) for r in made.toPandas().to_dict("records")}
    assert got[0] == 2**96 and got[-887_272] == 4295128739 and got[887_272] == 1461446703485210103287273052203988822378723970342
    assert all(got[t] is None for t in (-887_273, 887_273))
    ticks = range(-887_272, 887_273)
    assert all(got[t] < got[t + 1] for t in ticks[:-1])
    for t in range(1, 60):  # squared, a price: 1.0001 to the power of the tick
        assert abs(Fraction(got[t] ** 2, 2**192) / Fraction(10001, 10000) ** t - 1) < Fraction(1, 2**60)
    assert all(int(got[t]) == exact.root_x96_of(t) for t in range(-2000, 2000))
    product = [got[t] * got[-t] / 2**192 for t in range(1, 100_000, 997)]
    assert all(abs(p - 1) < 1e-9 for p in product)
