"""Detection against plain walks, searches by thirds and bisection, as a reader of an exchange would write them."""

import random
from collections import defaultdict

import pytest

from tidemark.operators import book_pool as B
from tidemark.plans.detection import _levels, _states


def swap(x, liquidity, root, fee):
    inp = x * (1 - fee)
    return liquidity * root * inp * root / (liquidity + inp * root)


def sell(bids, usd):
    coins = 0.0
    for price, amount in bids:
        taken = min(usd, amount)
        coins, usd = coins + taken * price, usd - taken
    return coins * 0.999


def buy(asks, coins):
    usd = 0.0
    for price, amount in asks:
        taken = min(coins, amount * price)
        usd, coins = usd + taken / price, coins - taken
    return usd * 0.999


@pytest.fixture(scope="module")
def routes(spark, sf):
    """(book, route) -> function from a size to (moved, out)."""
    sides = defaultdict(lambda: {"bid": [], "ask": []})
    for r in _levels(spark, sf).collect():
        sides[r["book_id"]][r["side"]].append((r["price"], r["amount"]))
    out = {}
    for s in _states(spark, sf).collect():
        if s["qa"] is None or s["gas_a"] is None:
            continue
        bids, asks = sorted(sides[s["book_id"]]["bid"], reverse=True), sorted(sides[s["book_id"]]["ask"])
        if not bids or not asks:
            continue
        for route, pool, root in (("book_to_a", "a", 1 / s["qa"]), ("a_to_book", "a", s["qa"]), ("book_to_b", "b", s["qb"]), ("b_to_book", "b", 1 / s["qb"])):
            leg = (s[f"l{pool}"], root, s[f"fee_{pool}"])
            if route.startswith("book"):
                made = lambda x, bids=bids, leg=leg: (sell(bids, x), swap(sell(bids, x), *leg))
            else:
                made = lambda x, asks=asks, leg=leg: (swap(x, *leg), buy(asks, swap(x, *leg)))
            out[s["book_id"], route] = made
    return out


@pytest.fixture(scope="module")
def served(spark, sf):
    return B.served(_levels(spark, sf), _states(spark, sf)).cache()


@pytest.mark.parametrize("size", [1.0, 37.5, 2600.0, 1e6])
def test_estimates_are_walks(spark, served, routes, size):
    from pyspark.sql import functions as F

    got = {(r["book_id"], r["route"]): (r["moved"], r["usd_out"]) for r in B.estimates(served, F.lit(size)).collect()}
    assert set(got) == set(routes)
    for key, (moved, out) in got.items():
        assert (moved, out) == pytest.approx(routes[key](size), rel=1e-9)


def test_best_sizes_are_where_thirds_end(served, routes):
    got = {(r["book_id"], r["route"]): r for r in B.best_sizes(served).filter("gains").collect()}
    assert set(got) == {k for k, f in routes.items() if f(5.0)[1] - 5.0 > 0} and len(got) > 4
    for key, row in got.items():
        low, high, profit = 1.0, 5000.0, lambda x, f=routes[key]: f(x)[1] - x
        while high - low > 0.5:
            a, b = low + (high - low) / 3, high - (high - low) / 3
            low, high = (a, high) if profit(a) < profit(b) else (low, b)
        assert row["profit"] == pytest.approx(profit(row["size"]), rel=1e-9)
        assert profit((low + high) / 2) - 1e-9 <= row["profit"] <= profit((low + high) / 2) + 0.5
    best = [r for r in B.best_trades(served).collect() if r["best"]]
    assert len(best) == len({k[0] for k in routes})


def test_curves_and_nearest_points(spark, served, routes):
    rows = {(r["book_id"], r["route"], r["size"]): r for r in B.curve(served).collect()}
    assert len(rows) == 5000 * len(routes)
    rng = random.Random(1)
    for key in rng.sample(sorted(rows), 300):
        moved, out = routes[key[:2]](float(key[2]))
        assert (rows[key]["moved"], rows[key]["profit"], rows[key]["least_out"]) == pytest.approx((moved, out - key[2], out * 0.999), rel=1e-9)
    book = next(iter(routes))[0]
    wanted = spark.createDataFrame([(book, True, 70.5), (book, False, 9999.0)], "book_id bigint, buys_from_book boolean, at double")
    near = {r["buys_from_book"]: r for r in B.nearest_points(B.curve(served), wanted).collect()}
    assert near[True]["size"] == 71 and near[False]["size"] == 5000
    assert near[True]["profit"] == pytest.approx(max(rows[book, r, 71]["profit"] for r in ("book_to_a", "book_to_b")))


def test_nearest_sizes_are_points_of_the_curve(spark, served, routes):
    books = sorted({k[0] for k in routes})
    ats = [0.3, 1.0, 70.5, 4999.5, 5000.0, 9999.0, -4.0, None]
    rows = [(b, side, ats[(i + side) % len(ats)]) for i, b in enumerate(books) for side in (True, False)] + [(books[0], True, 17.0), (-1, True, 3.0)]
    rows_left = served.filter("NOT (book_id % 3 = 0 AND route = 'book_to_b' AND lo > 100) AND NOT (book_id % 4 = 0 AND lo > 60)")  # curves that end early
    wanted = spark.createDataFrame(rows, "book_id bigint, buys_from_book boolean, at double")
    got, want = (sorted(map(str, frame.select("book_id", "buys_from_book", "at", "size", "profit", "pool").collect())) for frame in (B.nearest_sizes(rows_left, wanted), B.nearest_points(B.curve(rows_left), wanted)))
    assert got == want and len(got) == len(rows) - 1


def test_prices_of_the_curve_round_as_in_its_sql(spark, tmp_path):
    import duckdb

    from tidemark.plans import detection, market

    con = duckdb.connect()
    con.sql("create table supplier as select 1::bigint s_suppkey, 's' s_name, 1 s_nationkey, 100.0::double s_acctbal")
    prices = "(1, 'F', 8028.5), (2, 'O', 8070.5), (3, 'F', 1001.25), (4, 'O', 9000.0)"  # 8.0285 and 8.0705 lie below a half when multiplied
    con.sql(f"create table lineitem as select k::bigint l_orderkey, 1::bigint l_partkey, 1::bigint l_suppkey, 1 l_linenumber, 40.0::double l_quantity, (40 * price)::double l_extendedprice, s l_linestatus from (values {prices}) t(k, s, price)")
    for name in ("supplier", "lineitem"):
        con.sql(f"copy {name} to '{tmp_path}/{name}.parquet'")
    got = sorted(map(tuple, detection.profit_curve_cex_dex(spark, str(tmp_path)).collect()))
    assert len(got) == 4 * 5000 and {row[-1] for row in got} >= {8.028, 8.07}
    assert got == sorted(con.sql(market.ORACLES["profit_curve_cex_dex"]).fetchall())


def test_a_nearest_point_does_not_write_the_curve(spark, sf):
    from tidemark.plans.detection import nearest_curve_point

    assert "sequence(" not in nearest_curve_point(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_sort_a_bounded_number_of_levels(spark, monkeypatch):
    levels = spark.range(6000).selectExpr("id % 300 AS book_id", "IF(id % 600 < 300, 'bid', 'ask') AS side", "CAST(2 + id % 7 AS DOUBLE) AS price", "1.0D AS amount", "id AS level_id", "0L AS part")
    pools = spark.range(300).selectExpr("id AS book_id", "1.5D AS qa", "0.6D AS qb", "1e4 AS la", "1e4 AS lb", "0.003D AS fee_a", "0.003D AS fee_b", "0.1D AS gas_a", "0.1D AS gas_b")
    monkeypatch.setattr(B, "TASK_LEVELS", 500)
    sizes = B.served(levels, pools).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 12_000 and len(sizes) == 12 and max(sizes) < 3000  # each level serves two routes


def test_fundable_sizes_by_bisection(spark, served, routes):
    rng = random.Random(2)
    books = sorted({k[0] for k in routes})
    wallets = {b: rng.choice([0.5, 40.0, 3000.0, 1e9]) for b in books}
    frame = spark.createDataFrame([*wallets.items(), (-1, 5.0), (books[0] + 10**6, 0.0)], "book_id bigint, wallet double")
    got = {(r["book_id"], r["route"]): r for r in B.fundable(served, frame).collect()}
    assert set(got) == set(routes)
    for key, row in got.items():
        low, high = 0.0, 5000.0
        if routes[key](high)[0] <= wallets[key[0]]:
            low = high
        while high - low > 0.01:
            middle = (low + high) / 2
            low, high = (middle, high) if routes[key](middle)[0] <= wallets[key[0]] else (low, middle)
        assert low - 1e-6 <= row["size"] <= low + 0.0101 and row["moved"] <= wallets[key[0]] * (1 + 1e-12)


def test_what_is_missing_has_no_route(spark):
    levels = spark.createDataFrame([(1, "bid", 2.0, 5.0, 1, 1), (2, "bid", 2.0, 5.0, 1, 1), (2, "ask", 3.0, 5.0, 2, 1), (3, "bid", 2.0, 5.0, 1, 1), (3, "ask", 3.0, 5.0, 2, 1)], "book_id bigint, side string, price double, amount double, level_id bigint, part bigint")
    shape = "book_id bigint, qa double, qb double, la double, lb double, fee_a double, fee_b double, gas_a double, gas_b double, wallet double"
    state = (1.5, 0.6, 1e4, 1e4, 0.003, 0.003, 0.1, 0.1, 7.0)
    pools = spark.createDataFrame([(1, *state), (2, *state), (3, None, *state[1:]), (4, *state)], shape)
    rows = B.served(levels, pools)
    assert {r["book_id"] for r in rows.select("book_id").collect()} == {2}
    assert B.best_trades(rows).filter("route = 'NONE'").count() + B.best_sizes(rows).filter("gains").select("book_id").distinct().count() == 1
    assert B.curve(rows).count() == 4 * 5000
    dead = spark.createDataFrame([(2, 1.5, 0.6, 0.0, 1e4, 0.003, 0.003, 0.1, 0.1, 7.0)], shape)
    assert {r["route"] for r in B.fundable(B.served(levels, dead), pools.select("book_id", "wallet")).collect()} == {"book_to_a", "book_to_b", "b_to_book"}
    assert B.served(levels.limit(0), pools).count() == 0 and B.fundable_in_pools(pools.filter("book_id = 3")).count() == 0
    both = {r["route"]: r for r in B.fundable_in_pools(pools.filter("book_id = 1")).collect()}
    assert both["a_to_b"]["moved"] == pytest.approx(7.0) and both["b_to_a"]["moved"] == pytest.approx(7.0)


def test_curves_of_pools_are_dealt_over_tasks(spark):
    from tidemark.operators import detection as D

    pools = spark.range(600).coalesce(1).selectExpr("id AS pair", "1.0D AS qa", "1.0D AS qb")
    sizes = D.pool_curve(pools, 50).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 3 and sum(sizes) == 600 * 50 and max(sizes) <= 201 * 50
