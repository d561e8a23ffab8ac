import math

from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions import payloads as P
from tidemark.operators import books, prices, relations, trades


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_swaps_guard_and_concave(spark):
    lit = F.lit
    out = [one(spark, K.swap_0_for_1(lit(x), lit(1e6), lit(2.0))) for x in (0.0, 10.0, 20.0)]
    assert out[0] == 0 and 0 < out[2] < 2 * out[1]
    assert one(spark, K.swap_1_for_0(lit(5.0), lit(0.0), lit(2.0))) == 0
    there = one(spark, K.swap_0_for_1(lit(10.0), lit(1e6), lit(2.0)))
    assert there < 10 * 4 and math.isclose(there, 40, rel_tol=1e-3)


def test_position_amounts_at_the_bounds(spark):
    low, high = K.position_amounts(F.lit(100.0), F.lit(0.5), F.lit(1.0), F.lit(2.0))
    assert one(spark, low) == 50 and one(spark, high) == 0


def test_epoch_millis(spark):
    rows = [("1700000000",), ("1700000000000",), ("2023-11-14T22:13:20Z",), ("x",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(P.time_ms(F.col("t"))).collect()]
    assert got == [1700000000000] * 3 + [None, None]


def test_bucket_widths():
    assert [K.bucket_width(x) for x in (60_000, K.HOUR, K.DAY, 7 * K.DAY, 30 * K.DAY)] == [30_000, 60_000, 300_000, 1_800_000, K.HOUR]


def test_walks(spark):
    rows = [(1, "ask", 2.0, 5.0, 1, 1), (1, "ask", 1.0, 5.0, 2, 1), (1, "bid", 0.9, 4.0, 3, 1), (1, "bid", 0.8, 4.0, 4, 1)]
    levels = spark.createDataFrame(rows, "book_id int, side string, price double, amount double, level_id int, part int")
    assert books.walk_asks(levels, 7.0, 0.0).first()["out"] == 6.0
    assert math.isclose(books.walk_bids(levels, 6.0, 0.0).first()["out"], 0.9 * 4 + 0.8 * 2)
    assert math.isclose(books.book_inverse(levels, 0.9 * 4 + 0.8 * 2, 0.0).first()["out"], 6.0)
    assert books.walk_asks(levels, 1e9, 0.0).first()["used"] == 15.0


def test_weighted_mean_rules(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (100.0, None)], "p double, w double")
    assert df.agg(prices.weighted_mean(F.col("p"), F.col("w"))).first()[0] == 2.5
    assert df.filter("w is null").agg(prices.weighted_mean(F.col("p"), F.col("w"))).first()[0] == 0


def test_upsert_coalesce_keeps_old_values(spark):
    log = spark.createDataFrame([("a", 1, 5.0, "x"), ("a", 2, None, "y"), ("b", 1, 0.0, None)], "k string, v int, hash double, status string")
    got = {r["k"]: (r["hash"], r["status"]) for r in relations.upsert_coalesce(log, "k", ["v"], ["hash"], ["status"]).collect()}
    assert got == {"a": (5.0, "y"), "b": (0.0, None)}


def test_attempt_stats(spark):
    rows = [("completed", 1, 1.5, 10.0), ("completed", 2, 2.0, None), ("detected", 3, None, None)]
    stats = trades.attempt_stats(spark.createDataFrame(rows, "status string, detected_ms long, actual_profit double, executed_size double")).first()
    assert tuple(stats) == (3, 2, 3.5, 10.0)


def test_history_provenance(spark):
    events = spark.createDataFrame([(1, "routed", 100, 1, 7.0, 1.0, 0.0), (1, "executed", 200, 2, 8.0, 2.0, 0.1), (1, "failed", 400, 3, 9.0, 3.0, 0.2)], "attempt_id long, event_type string, ts_ms long, event_id long, size double, expected double, reason double")
    events = events.selectExpr("*", "event_id AS buy_venue", "event_id + 1 AS sell_venue", "concat('w', event_id) AS wallet", "concat('0x', event_id) AS tx_hash", "expected - 1 AS gain", "size * 2 AS moved")
    attempts = spark.createDataFrame([(1, "p", "d", 1.0)], "id long, pipeline string, direction string, actual_profit double")
    row = trades.history(events, attempts, 10, from_ts=150, to_ts=250).first()
    assert (row["routed_at"], row["size"], row["result"], row["last_event"]) == (100, 7.0, 2.0, "executed")
    assert (row["wallet"], row["tx_hash"], row["buy_venue"], row["actual_profit"], row["moved"]) == ("w1", "0x2", 2, 1.0, 16.0)
    assert trades.history(events, attempts, 10, from_ts=500).count() == 0


def test_null_safe_totals(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    assert {r["k"]: r["total"] for r in trades.null_safe_totals(df, ["k"], "v").collect()} == {"a": None, "b": 2.0}


def test_ewma_over_blocks_equals_one_fold(spark):
    import random

    dice, rows, want = random.Random(3), [], {}
    for source, gaps in (("a", (1, 400_000)), ("b", (1, 20_000_000)), ("c", (0, 1))):
        at, mean, var = 0, None, 0.0
        for i in range(60):
            at += dice.randint(*gaps)
            x = dice.uniform(0.2, 0.9)
            rows.append((source, at, i, x))
            if mean is None:
                mean = x
            else:
                mean, var = 0.9 * mean + 0.1 * x, 0.9 * var + 0.1 * (x - mean) ** 2
        want[source] = (mean, var)
    dice.shuffle(rows)
    got = prices.ewma(spark.createDataFrame(rows, "source string, ts_ms long, id int, price double"), 0.9).collect()
    assert {r["source"] for r in got} == set(want)
    for r in got:
        assert math.isclose(r["mean"], want[r["source"]][0], rel_tol=1e-12) and math.isclose(r["var"], want[r["source"]][1], rel_tol=1e-9)


def test_upper_median_by_bounds(spark):
    import random

    dice = random.Random(5)
    held = {"one": [3.0], "two": [2.0, 1.0], "ties": [1.0] * 700 + [2.0] * 700, "many": [dice.lognormvariate(0, 9) for _ in range(30001)], "even": [float(i) for i in range(50000)]}
    rows = [(k, v) for k, values in held.items() for v in values]
    got = {r["k"]: r["median"] for r in prices.upper_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {k: sorted(v)[len(v) // 2] for k, v in held.items()}


def test_rows_meet_their_median_without_a_shuffle(spark):
    quotes = spark.range(1000).selectExpr("id", "id % 3 AS source", "CASE WHEN id % 3 = 2 THEN 2.0 * pow(10, id % 5) ELSE 100.0 + id % 7 END AS price")
    kept = prices.within_deviation(quotes, "source", "price", 0.02)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "Exchange hashpartitioning" not in plan
    rows = [(r["id"], r["source"], r["price"]) for r in quotes.collect()]
    want = set()
    for s in range(3):
        own = [(i, p) for i, t, p in rows if t == s]
        middle = sorted(p for _, p in own)[len(own) // 2]
        near = [i for i, p in own if abs(p - middle) / middle <= 0.02]
        want.update(near if len(near) > 1 else [i for i, _ in own])
    assert {r["id"] for r in kept.collect()} == want and len(want) < 1000


def test_rolling_sum_across_spans(spark):
    import random

    dice = random.Random(7)
    rows = [(i, dice.choice("ab"), dice.randint(0, 500), float(dice.randint(1, 9))) for i in range(200)]
    out = relations.rolling_sum(spark.createDataFrame(rows, "id int, k string, t long, v double"), "k", "t", "v", 50, "total")
    assert out.columns == ["id", "k", "t", "v", "total"]
    want = {i: sum(v2 for _, k2, t2, v2 in rows if k2 == k and t - 50 < t2 <= t) for i, k, t, v in rows}
    assert {r["id"]: r["total"] for r in out.collect()} == want


def test_texts_as_logs_and_pages_show_them(spark):
    lit, address = F.lit, "0x1234567890abcdef1234567890abcdef12345678"
    assert one(spark, K.short_address(lit(address))) == "0x1234...345678" and one(spark, K.short_address(lit("0x12345678"))) == "0x12345678"
    assert one(spark, K.short_address(lit(""))) is None
    assert one(spark, K.shown_address(lit(address))) == "0x123456...345678" and one(spark, K.shown_address(lit("0x123456789012"))) == "0x123456789012"
    assert [one(spark, K.age_text(lit(ms))) for ms in (59_999, 60_000, 7_200_000, 200_000_000)] == ["59s ago", "1m ago", "2h ago", "2d ago"]
    assert [one(spark, K.uptime_text(lit(ms))) for ms in (59_000, 3_660_000, 90_000_000)] == ["0m", "1h 1m", "25h 0m"]
    assert [one(spark, K.human_usd(lit(x))) for x in (1_250_000.0, 2500.0, 44.5, -2500.0)] == ["$1.3M", "$3K", "$45", "$-2500"]


def test_shortened_dollars_as_printf_rounds(spark):
    values = [1500.0, 2500.0, 3500.0, 1_250_000.0, 1_350_000.0, 1_150_000.0, 2_750_000.0, 1_049_999.9, 999_500.0, 44.5, -2500.0]
    values += [float(100 * n) for n in range(10_000, 60_000, 37)] + [1e6 + 50_000.0 * n for n in range(400)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", K.human_usd(F.col("x"), halves_up=False).alias("t")).collect()
    for x, t in rows:
        assert t == (f"${x / 1e6:.1f}M" if x >= 1e6 else f"${x / 1e3:.0f}K" if x >= 1e3 else {44.5: "$45", -2500.0: "$-2500"}[x])


def test_markets_and_event_ids(spark):
    rows = [("USDT_COIN", "usdt/coin"), (None, "usdt/coin"), ("usdtbtc", "usdt/coin")]
    got = spark.createDataFrame(rows, "a string, b string").select(K.market_matches(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [True, True, False]
    assert one(spark, K.event_id(F.lit("0xABcd"), F.lit("0x1F"))) == one(spark, K.event_id(F.lit("abcd"), F.lit("1f"))) == "0xabcd:31"
    assert one(spark, K.event_id(F.lit("0xABcd"), F.lit(None).cast("string"))) is None


def test_reverts(spark):
    def coded(text, size=None):
        data = text.encode()
        return "0x08c379a0" + f"{32:064x}{len(data) if size is None else size:064x}" + data.hex().ljust(64 * (len(data) // 32 + 1), "0")

    cases = {
        "execution reverted: SPL: 0x08c379a000": "execution reverted: SPL",
        coded("order é refused"): "execution reverted: order é refused",
        coded(""): "execution reverted: ",
        coded("x" * 70): "execution reverted: " + "x" * 70,
        coded("cut", 4000): coded("cut", 4000),
        "0x08c379a0": "0x08c379a0",
        "0x08c379a0ff": "0x08c379a0ff",
        "nonce too low": "nonce too low",
        "short: 0xff": "short: 0xff",
    }
    got = {r["e"]: r["c"] for r in spark.createDataFrame([(e,) for e in cases], "e string").select("e", P.clean_revert(F.col("e")).alias("c")).collect()}
    assert got == cases


def test_orders_are_parsed_once(spark):
    from tidemark.operators import orders

    rows = [(1, 7, '{"side":"Buy","state":"Wait","price":{"amount":"2.5"},"volume":{"value":4},"remaining_volume":null,"created_at":1700000000}'), (2, 7, "{broken"), (3, 7, '{"side":"sell","price":"1","volume":"x","origin_volume":"3","executed_volume":"1","status":"done"}')]
    frame = spark.createDataFrame(rows, "id int, venue int, payload string")
    got = {r["id"]: r for r in orders.normalised(frame).collect()}
    assert set(got) == {1, 3} and (got[1]["price"], got[1]["volume"], got[1]["remaining"], got[1]["status"], got[1]["created"]) == (2.5, 4.0, 4.0, "wait", 1700000000000)
    assert (got[3]["volume"], got[3]["remaining"], got[3]["executed"]) == (3.0, 2.0, 1.0)
    plan = orders.normalised(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json_tuple") == 1


def test_shares_without_value(spark):
    held = spark.createDataFrame([(1, v, 0.0, 0.0, None) for v in range(3)] + [(2, 0, 1000.0, 1.0, None), (2, 1, 0.0, 0.0, 0.34)], "account int, venue int, base double, usd double, exact double")
    got = {(r["account"], r["venue"]): r["share"] for r in trades.allocation_shares(held, "account", "venue").collect()}
    assert [got[1, v] for v in range(3)] == [33.3, 33.3, 33.4] and math.isclose(got[2, 0], 83.0)


def test_owners_are_checked(spark):
    moves = spark.createDataFrame([(1, 0, 5, 1), (1, 5, 6, 2), (2, 0, 5, 1)], "token int, sender int, owner int, at int")
    got = {(r["owner"], r["token"]): r["owned"] for r in relations.ownership(moves).collect()}
    assert got == {(0, 1): False, (0, 2): False, (5, 1): False, (5, 2): True, (6, 1): True}


def test_sums_slide_over_steps(spark):
    import random

    rng = random.Random(9)
    rows = [(rng.randrange(3), rng.randrange(400), float(rng.randrange(1, 50))) for _ in range(300)]
    frame = spark.createDataFrame(rows, "k int, t bigint, v double")
    got = sorted((r["k"], r["t"], r["v"], round(r["s"], 6)) for r in relations.rolling_sum(frame, "k", "t", "v", 96, "s", steps=8).collect())
    assert got == sorted((k, t, v, round(sum(v2 for k2, t2, v2 in rows if k2 == k and t - 96 < t2 <= t), 6)) for k, t, v in rows)


def test_places_add_up_over_cuts(spark):
    import random

    from tidemark.operators import orders

    rng = random.Random(4)
    rows = [(v, s, float(rng.randrange(30)), i) for i in range(400) for v, s in [(rng.randrange(2), rng.choice(["buy", "sell"]))]]
    got = {r["id"]: r["place"] for r in orders.placed_by_side(spark.createDataFrame(rows, "venue int, side string, price double, id int"), parts=8).collect()}
    for venue in (0, 1):
        ordered = sorted((r for r in rows if r[0] == venue), key=lambda r: (r[1], -r[2], r[3]))
        assert [got[r[3]] for r in ordered] == list(range(1, len(ordered) + 1))


def test_cuts_of_price_are_made_once(spark):
    """Quantiles of many rows depend on the order of merging: made once for each reading, rows and counts part."""
    from tidemark.operators import orders

    rows = spark.range(5000).selectExpr("CAST(id % 3 AS INT) AS venue", "'buy' AS side", "CAST(id * 7919 % 4999 AS DOUBLE) AS price", "id")
    placed = orders.placed_by_side(rows)
    assert "percentile_approx" not in placed._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["place"] for r in placed.filter("venue = 1").collect()) == list(range(1, 1668))
