"""Registered queries over pools, positions, trade detection, routes, portfolios and keyed writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import payloads as P
from ..operators import detection as D
from ..operators import book_pool, relations
from ..operators import orders as O
from ..sources import views as V
from .market import query, r

# --- pool and position mathematics ---------------------------------------------------------------


def _parts(spark, sf) -> DataFrame:
    """Positions: root price, ticks around it and amounts of both tokens, by part."""
    size, root = F.col("p_size"), F.sqrt(F.col("p_retailprice") / 1000)
    low = F.floor(F.log(F.col("p_retailprice") / 1000) / F.log(F.lit(1.0001))) - 400 + size * 10
    return V.read(spark, sf, "part").select("p_partkey", size.alias("size"), root.alias("root"), low.cast("int").alias("tl"), (low + 300 + size * 2).cast("int").alias("tu"), (size * 3.0).alias("a0"), (size % 7 * 2.0).alias("a1"))


_P = """, part_ AS (SELECT p_partkey, p_size AS size, sqrt(p_retailprice/1000) AS root, (floor(ln(p_retailprice/1000)/ln(1.0001::DOUBLE))-400+p_size*10)::INT AS tl, (floor(ln(p_retailprice/1000)/ln(1.0001::DOUBLE))-400+p_size*10+300+p_size*2)::INT AS tu, p_size*3.0::DOUBLE AS a0, (p_size%7)*2.0::DOUBLE AS a1 FROM part),
  pos AS (SELECT *, pow(1.0001::DOUBLE,tl/2.0::DOUBLE) AS low, pow(1.0001::DOUBLE,tu/2.0::DOUBLE) AS high FROM part_) """.replace(", part_", "WITH part_", 1)


def _positions(spark, sf) -> DataFrame:
    return _parts(spark, sf).withColumns({"low": K.root_at(F.col("tl")), "high": K.root_at(F.col("tu"))})


@query("sqrt_price_to_price", "SELECT p_partkey, round(p_retailprice/1000*1e12::DOUBLE,0) AS price, round(1/(p_retailprice/1000),9) AS inverse FROM part")
def sqrt_price_to_price(spark, sf):
    price = lambda a, b: K.price_of_root(F.col("root") * K.Q96, a, b)
    return _parts(spark, sf).select("p_partkey", r(price(18, 6), 0).alias("price"), r(K.inverted(price(6, 6)), 9).alias("inverse"))


@query("required_ratio", _P + "SELECT p_partkey, round(CASE WHEN root<=low THEN (high-low)/(low*high) WHEN root>=high THEN 0 ELSE (high-root)/(root*high) END,9)::DOUBLE AS r0, round(CASE WHEN root<=low THEN 0 WHEN root>=high THEN high-low ELSE root-low END,9)::DOUBLE AS r1 FROM pos")
def required_ratio(spark, sf):
    r0, r1 = K.required_ratio(F.col("root"), F.col("low"), F.col("high"))
    return _positions(spark, sf).select("p_partkey", r(r0, 9).alias("r0"), r(r1, 9).alias("r1"))


_L = """, l AS (SELECT *, CASE WHEN root<=low THEN a0*low*high/(high-low) WHEN root>=high THEN a1/(high-low) WHEN a0>0 AND a1>0 THEN least(a0*root*high/(high-root), a1/(root-low)) ELSE greatest(a0*root*high/(high-root), a1/(root-low)) END AS liq FROM pos) """


@query("liquidity_from_amounts", _P + _L + "SELECT p_partkey, round(liq,4) AS liquidity FROM l")
def liquidity_from_amounts(spark, sf):
    return _positions(spark, sf).select("p_partkey", r(K.liquidity_for(*map(F.col, ("root", "low", "high", "a0", "a1"))), 4).alias("liquidity"))


@query("in_range", _P + ", t AS (SELECT *, floor(ln(root*root)/ln(1.0001::DOUBLE))::INT AS tick FROM pos) SELECT p_partkey, tick BETWEEN tl AND tu AS inside FROM t")
def in_range(spark, sf):
    tick = F.floor(F.log(F.col("root") * F.col("root")) / F.log(F.lit(1.0001)))
    return _parts(spark, sf).select("p_partkey", tick.between(F.col("tl"), F.col("tu")).alias("inside"))


@query("lp_position_value", _P + _L + """, v AS (SELECT *, least(greatest(root,low),high) AS c FROM l) SELECT p_partkey, round(liq*(1/c-1/high)*root*root+liq*(c-low),4) AS value, round(CASE WHEN root BETWEEN low AND high THEN liq/1e6::DOUBLE*100 ELSE 0 END,6)::DOUBLE AS share FROM v""")
def lp_position_value(spark, sf):
    liquidity = K.liquidity_for(*map(F.col, ("root", "low", "high", "a0", "a1")))
    a0, a1 = K.position_amounts(F.col("liq"), F.col("root"), F.col("low"), F.col("high"))
    share = F.when(F.col("root").between(F.col("low"), F.col("high")), F.col("liq") / 1e6 * 100).otherwise(0.0)
    return _positions(spark, sf).withColumn("liq", liquidity).select("p_partkey", r(a0 * F.col("root") * F.col("root") + a1, 4).alias("value"), r(share).alias("share"))


@query("ratio_rebalance", _P + """, q AS (SELECT *, root*root AS price, CASE WHEN root<=low THEN (high-low)/(low*high) WHEN root>=high THEN 0 ELSE (high-root)/(root*high) END AS r0, CASE WHEN root<=low THEN 0 WHEN root>=high THEN high-low ELSE root-low END AS r1 FROM pos),
  t AS (SELECT *, a0*price+a1 AS total FROM q), u AS (SELECT *, total*r0/(CASE WHEN r0*price+r1>0 THEN r0*price+r1 ELSE 1 END) AS t0 FROM t WHERE total>0), w AS (SELECT *, greatest(0,total-t0*price) AS t1 FROM u WHERE abs(a0-t0)*price>total*0.01::DOUBLE)
  SELECT p_partkey, CASE WHEN a0>t0 THEN '0 to 1' ELSE '1 to 0' END AS direction, round(CASE WHEN a0>t0 THEN a0-t0 ELSE a1-t1 END,6) AS amount, round(CASE WHEN a0>t0 THEN (a0-t0)*price*0.99::DOUBLE ELSE (a1-t1)/price*0.99::DOUBLE END,6) AS least FROM w""")
def ratio_rebalance(spark, sf):
    return D.rebalances(_positions(spark, sf)).select("p_partkey", "direction", r("amount").alias("amount"), r("least").alias("least"))


@query("topup_trigger", "SELECT p_partkey, p_size*3.0::DOUBLE>=100 OR (p_size%7)*2.0::DOUBLE>=10 AS topup FROM part")
def topup_trigger(spark, sf):
    return _parts(spark, sf).select("p_partkey", ((F.col("a0") >= 100) | (F.col("a1") >= 10)).alias("topup"))


_BRAND = ", h AS (SELECT p_brand, count(*) AS n, round(avg(p_retailprice/1000),6) AS mean, coalesce(stddev_pop(p_retailprice/1000),0) AS sd FROM part GROUP BY 1) "


def _brands(spark, sf) -> DataFrame:
    price = F.col("p_retailprice") / 1000
    return V.read(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg(price), 6).alias("mean"), F.coalesce(F.stddev_pop(price), F.lit(0.0)).alias("sd"))


@query("tick_range", "WITH" + _BRAND[1:] + """, s AS (SELECT *, CASE WHEN sd>0 THEN greatest(0.2,least(0.8,0.6+(1.5-mean)/(sd*2.0::DOUBLE)*0.15)) ELSE 0.6 END AS skew FROM h), b AS (SELECT *, greatest(mean-sd*4*skew,0.0001) AS lo, mean+sd*4*(1-skew) AS hi FROM s),
  k AS (SELECT *, floor(trunc(ln(lo)/ln(1.0001::DOUBLE))/60.0)*60 AS tl, ceil(trunc(ln(hi)/ln(1.0001::DOUBLE))/60.0)*60 AS tu FROM b), f AS (SELECT *, floor((tl+tu)/2) AS m, tu-tl AS w FROM k),
  g AS (SELECT p_brand, CASE WHEN w<600 THEN m-300 WHEN w>6000 THEN m-3000 ELSE tl END AS a, CASE WHEN w<600 THEN m+300 WHEN w>6000 THEN m+3000 ELSE tu END AS b FROM f) SELECT p_brand, (floor(a/60)*60)::BIGINT AS low, (ceil(b/60)*60)::BIGINT AS high FROM g""")
def tick_range(spark, sf):
    skew = K.recovered_skew(F.lit(0.6), F.lit(1.5), F.col("mean"), F.col("sd"), 2.0)
    low, high = K.tick_range(F.col("mean"), F.col("sd"), 2.0, F.col("skew"), 60, 600, 6000)
    return _brands(spark, sf).withColumn("skew", skew).select("p_brand", low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


@query("min_history_guard", ", l AS (SELECT *, row_number() OVER (PARTITION BY source, ts_ms//3600000 ORDER BY ts_ms DESC, id DESC) AS k FROM quotes) SELECT source, ts_ms//3600000 AS hour, CASE WHEN count(*)>=10 THEN round(avg(mid),9) END AS mean FROM l WHERE k<=100 GROUP BY 1,2", "quotes")
def min_history_guard(spark, sf):
    """No mean from fewer than 10 of the last 100 prices of a source and hour."""
    hour = F.floor(F.col("ts_ms") / K.HOUR)
    last = relations.n_per_key(V.quotes(spark, sf).withColumn("hour", hour), ["source", "hour"], [F.col("ts_ms").desc(), F.col("id").desc()], 100)
    return last.groupBy("source", "hour").agg(F.when(F.count("*") >= 10, r(F.avg("mid"), 9)).alias("mean"))


# --- detection -------------------------------------------------------------------------------------
# A pair of pools by supplier with prices a little apart; one liquidity.

_TWO = " z AS (SELECT s_suppkey AS pair, sqrt(1+(s_suppkey%13)/40.0::DOUBLE) AS qa, sqrt((1+(s_suppkey%13)/40.0::DOUBLE)*(1+(s_suppkey%9-4)/500.0::DOUBLE)) AS qb FROM supplier) "
_BUY = "({0}*0.9995::DOUBLE)/({1}*({1}+{0}*0.9995::DOUBLE/2e4::DOUBLE))"
_SELL = "(2e4::DOUBLE*{1}*(({0})*0.9995::DOUBLE*{1}))/(2e4::DOUBLE+({0})*0.9995::DOUBLE*{1})"


def _pair_sql(x: str, a: str, b: str) -> str:
    return _SELL.format(_BUY.format(x, a), b)


def _pools(spark, sf) -> DataFrame:
    price = 1 + F.col("s_suppkey") % 13 / 40.0
    return V.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("pair"), F.sqrt(price).alias("qa"), F.sqrt(price * (1 + (F.col("s_suppkey") % 9 - 4) / 500.0)).alias("qb"))


@query("trade_estimate_dex_dex", "WITH" + _TWO + f"""SELECT pair, 'a to b' AS direction, round({_BUY.format('250.0::DOUBLE', 'qa')},6) AS moved, round({_pair_sql('250.0::DOUBLE', 'qa', 'qb')},6) AS usd_out, trunc(({_pair_sql('250.0::DOUBLE', 'qa', 'qb')}-250)/250*10000)::INT AS bps FROM z
  UNION ALL SELECT pair, 'b to a', round({_BUY.format('250.0::DOUBLE', 'qb')},6), round({_pair_sql('250.0::DOUBLE', 'qb', 'qa')},6), trunc(({_pair_sql('250.0::DOUBLE', 'qb', 'qa')}-250)/250*10000)::INT FROM z""")
def trade_estimate_dex_dex(spark, sf):
    out = D.pool_trades(_pools(spark, sf), F.lit(250.0))
    return out.select("pair", "direction", r("moved").alias("moved"), r("usd_out").alias("usd_out"), ((F.col("usd_out") - 250) / 250 * 10000).cast("int").alias("bps"))


def _search(high: str) -> str:
    """SQL of both directions' search by thirds, as rows (pair, d, lo, hi) of the last step."""
    steps = 26 if high == "15000" else 23
    f = lambda m: f"(CASE d WHEN 0 THEN {_pair_sql(m, 'qa', 'qb')} ELSE {_pair_sql(m, 'qb', 'qa')} END - {m})"
    m1, m2 = "(lo+(hi-lo)/3)", "(hi-(hi-lo)/3)"
    return f""", s AS (SELECT pair, qa, qb, d, 0 AS k, 1.0::DOUBLE AS lo, {high}.0::DOUBLE AS hi FROM z, (VALUES (0), (1)) v(d)
      UNION ALL SELECT pair, qa, qb, d, k+1, CASE WHEN {f(m1)} < {f(m2)} THEN {m1} ELSE lo END, CASE WHEN {f(m1)} < {f(m2)} THEN hi ELSE {m2} END FROM s WHERE k<{steps}), best AS (SELECT pair, qa, qb, d, (lo+hi)/2 AS size FROM s WHERE k={steps}) """


_FOUND = "WITH RECURSIVE" + _TWO + _search("15000") + f", o AS (SELECT pair, d, size, CASE d WHEN 0 THEN {_pair_sql('size', 'qa', 'qb')} ELSE {_pair_sql('size', 'qb', 'qa')} END - size AS profit FROM best) "


@query("ternary_search", _FOUND + "SELECT pair, CASE d WHEN 0 THEN 'a to b' ELSE 'b to a' END AS direction, round(size,1) AS size FROM o")
def ternary_search(spark, sf):
    return D.best_pool_trades(_pools(spark, sf)).select("pair", "direction", r("size", 1).alias("size"))


@query("find_optimal_dex_arb", _FOUND + "SELECT pair, CASE d WHEN 0 THEN 'a to b' ELSE 'b to a' END AS direction, round(size,1) AS size, round(profit,4) AS profit, trunc(profit/size*10000)::INT AS bps FROM o QUALIFY row_number() OVER (PARTITION BY pair ORDER BY profit DESC, d)=1")
def find_optimal_dex_arb(spark, sf):
    best = D.best_direction(D.best_pool_trades(_pools(spark, sf)), "pair")
    return best.select("pair", "direction", r("size", 1).alias("size"), r("profit", 4).alias("profit"), (F.col("profit") / F.col("size") * 10000).cast("int").alias("bps"))


@query("argmax_direction", _FOUND + "SELECT pair, CASE d WHEN 0 THEN 'a to b' ELSE 'b to a' END AS direction FROM o QUALIFY row_number() OVER (PARTITION BY pair ORDER BY profit DESC, d)=1")
def argmax_direction(spark, sf):
    """Most profitable direction; of equal ones the first listed."""
    return D.best_direction(D.best_pool_trades(_pools(spark, sf)), "pair").select("pair", "direction")


@query("positive_profit_filter", _FOUND + "SELECT pair, d, round(profit,4) AS profit FROM o WHERE profit>0")
def positive_profit_filter(spark, sf):
    return D.best_pool_trades(_pools(spark, sf)).filter("profit > 0").select("pair", F.when(F.col("direction") == "a to b", 0).otherwise(1).alias("d"), r("profit", 4).alias("profit"))


_DEX_CURVE = "WITH RECURSIVE" + _TWO + _search("15000") + f""", top AS (SELECT pair, max(greatest(5000, trunc(1.5*size)))::INT AS upto FROM best GROUP BY 1), g AS (SELECT z.*, unnest(range(1, upto+1)) AS size FROM z JOIN top USING (pair)),
  c AS (SELECT pair, size, round({_pair_sql('size', 'qa', 'qb')}-size,7) AS a_to_b, round({_pair_sql('size', 'qb', 'qa')}-size,7) AS b_to_a FROM g) """


@query("profit_curve_dex_dex", _DEX_CURVE + "SELECT pair, size::BIGINT AS size, a_to_b, b_to_a FROM c")
def profit_curve_dex_dex(spark, sf):
    """Profit of both directions at every size up to 5,000 or one and a half times the best one."""
    return D.pool_curve(_pools(spark, sf)).select("pair", "size", r("a_to_b", 7).alias("a_to_b"), r("b_to_a", 7).alias("b_to_a"))


# A book per supplier and a pool priced at its mid: levels with the amount before each.

_BOOK = """, k AS (SELECT book_id, side, price/1000 AS price, amount, sum(amount) OVER (PARTITION BY book_id, side ORDER BY CASE side WHEN 'ask' THEN price ELSE -price END, level_id, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM levels),
  bk AS (SELECT book_id, list(struct_pack(p:=price,a:=amount,b:=coalesce(ahead,0)) ORDER BY coalesce(ahead,0)) FILTER (WHERE side='bid') AS bids, avg(price) AS mid FROM k GROUP BY 1 HAVING count(DISTINCT side)=2), t AS (SELECT book_id, bids, sqrt(1/mid*(1+(book_id%9-4)/100.0::DOUBLE)) AS q FROM bk) """
_WALK = "(list_sum(list_transform(bids, lambda l: greatest(0, least(l.a, {0}-l.b))*l.p))*0.999::DOUBLE)"


@query("book_buy_estimate", _BOOK + f"SELECT book_id, round({_WALK.format('75.0::DOUBLE')},4) AS bought FROM t", "levels")
def book_buy_estimate(spark, sf):
    return D.book_trades(D.books_with_pools(V.levels(spark, sf)), F.lit(75.0)).select("book_id", r(F.coalesce("moved", F.lit(0.0)), 4).alias("bought"))


@query("holdings_value", _BOOK + f"SELECT book_id, round({_WALK.format('(10.0::DOUBLE+book_id%50)')},4) AS in_book, round({_SELL.format('(10.0::DOUBLE+book_id%50)', 'q')},4) AS in_pool FROM t", "levels")
def holdings_value(spark, sf):
    held = 10.0 + F.col("book_id") % 50
    made = D.book_trades(D.books_with_pools(V.levels(spark, sf)), held)
    return made.select("book_id", r("moved", 4).alias("in_book"), r(K.swap_0_for_1(held, F.lit(2e4), F.col("q"), 0.0005), 4).alias("in_pool"))


# --- routes and balances ---------------------------------------------------------------------------

_CAND = """, cand AS (SELECT s_suppkey AS id, CASE s_nationkey%4 WHEN 0 THEN 'a_b' WHEN 1 THEN 'b_a' WHEN 2 THEN 'a_c' ELSE 'x_y' END AS direction, CASE WHEN s_nationkey%4=1 THEN 'b' ELSE 'a' END AS buy, CASE s_nationkey%4 WHEN 0 THEN 'b' WHEN 1 THEN 'a' ELSE 'c' END AS sell, s_acctbal AS size, s_acctbal*0.01::DOUBLE AS profit, (s_suppkey%10)*2.0::DOUBLE AS gas FROM supplier),
  bal AS (SELECT * FROM (VALUES ('a', 3000.0::DOUBLE, 90.0::DOUBLE), ('b', 6000.0::DOUBLE, 400.0::DOUBLE), ('d', 1.0::DOUBLE, 1.0::DOUBLE)) t(venue, stable, base)), routes AS (SELECT * FROM (VALUES ('a_b','a','b'),('b_a','b','a'),('a_c','a','c')) t(direction, buy_leg, sell_leg)) """.replace(", cand", "WITH cand", 1)
ROUTES = [("a_b", "a", "b"), ("b_a", "b", "a"), ("a_c", "a", "c")]
BALANCES = [("a", 3000.0, 90.0), ("b", 6000.0, 400.0), ("d", 1.0, 1.0)]


def _candidates(spark, sf) -> DataFrame:
    kind = F.col("s_nationkey") % 4
    return V.read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.when(kind == 0, "a_b").when(kind == 1, "b_a").when(kind == 2, "a_c").otherwise("x_y").alias("direction"), F.when(kind == 1, "b").otherwise("a").alias("buy"),
        F.when(kind == 0, "b").when(kind == 1, "a").otherwise("c").alias("sell"), F.col("s_acctbal").alias("size"), (F.col("s_acctbal") * 0.01).alias("profit"), (F.col("s_suppkey") % 10 * 2.0).alias("gas"),
    )


def _registry(spark) -> DataFrame:
    return spark.createDataFrame(ROUTES, "direction string, buy_leg string, sell_leg string")


def _balances(spark) -> DataFrame:
    return spark.createDataFrame(BALANCES, "venue string, stable double, base double")


@query("lookup_route", _CAND + "SELECT id, direction FROM cand JOIN routes USING (direction) WHERE buy=buy_leg AND sell=sell_leg")
def lookup_route(spark, sf):
    return D.routed(_candidates(spark, sf), _registry(spark)).select("id", "direction")


@query("lookup_balances", _CAND + "SELECT id, x.stable AS buy_stable, y.base AS sell_base FROM cand LEFT JOIN bal x ON x.venue=buy LEFT JOIN bal y ON y.venue=sell")
def lookup_balances(spark, sf):
    return D.with_balances(_candidates(spark, sf), _balances(spark)).select("id", "buy_stable", "sell_base")


_CAPPED = _CAND + ", f AS (SELECT cand.*, x.stable AS s, y.base AS b FROM cand JOIN routes USING (direction) JOIN bal x ON x.venue=buy JOIN bal y ON y.venue=sell WHERE buy=buy_leg AND sell=sell_leg AND x.stable>0 AND y.base>0), w AS (SELECT *, least(size, s, 2500.0::DOUBLE, b*20) AS cap FROM f), g AS (SELECT *, profit*cap/size-gas AS net FROM w WHERE cap>0) "


@query("route_cap", _CAPPED + "SELECT id, round(cap,4) AS cap FROM w")
def route_cap(spark, sf):
    return D.capped(D.with_balances(D.routed(_candidates(spark, sf), _registry(spark)), _balances(spark)), 2500.0, 20.0).select("id", r("cap", 4).alias("cap"))


@query("route_guard_filters", _CAPPED + "SELECT id, round(net,6) AS net FROM g WHERE net>=1 AND isfinite(net)")
def route_guard_filters(spark, sf):
    return D.guarded(_capped(spark, sf), 1.0).select("id", r("net").alias("net"))


def _capped(spark, sf) -> DataFrame:
    return D.capped(D.with_balances(D.routed(_candidates(spark, sf), _registry(spark)), _balances(spark)), 2500.0, 20.0)


_SCORED = _CAPPED + """, i AS (SELECT *, (base0+s)*pow(base0/(base0+s)-0.5,2) - (base0+cap+s-cap)*pow((base0+cap)/(base0+s)-0.5,2) AS up FROM (SELECT *, b*10 AS base0 FROM g WHERE net>=1)), sc AS (SELECT id, direction, net, up, net+0.02::DOUBLE*up AS score FROM i) """


@query("route_score", _SCORED + "SELECT id, round(up,4) AS improvement, round(score,4) AS score FROM sc")
def route_score(spark, sf):
    """Net profit and a weight of how much the trade brings the account's halves together."""
    return D.scored(D.guarded(_capped(spark, sf), 1.0), 0.02).select("id", r("improvement", 4).alias("improvement"), r("score", 4).alias("score"))


@query("argmax_route", _SCORED + "SELECT direction, id, round(score,4) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY direction ORDER BY score DESC, net DESC, id)=1")
def argmax_route(spark, sf):
    best = D.scored(D.guarded(_capped(spark, sf), 1.0), 0.02).groupBy("direction").agg(F.max_by(F.struct("id", "score"), F.struct("score", "net", -F.col("id"))).alias("b"))
    return best.select("direction", "b.id", r("b.score", 4).alias("score"))


@query("low_inventory_flag", "SELECT c_custkey, c_acctbal<500 AS low FROM customer")
def low_inventory_flag(spark, sf):
    return V.read(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") < 500).alias("low"))


@query("cex_balance_alerts", "SELECT n_name AS venue, 'low:'||n_name||':'||m.token AS dedupe_key, round(b,2) AS balance FROM (SELECT c_nationkey, 'USD' AS token, min(c_acctbal) AS b FROM customer GROUP BY 1) h JOIN (VALUES ('USD', -900.0::DOUBLE)) m(token, least) USING (token) JOIN nation ON c_nationkey=n_nationkey WHERE b<m.least")
def cex_balance_alerts(spark, sf):
    held = V.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("b")).withColumn("token", F.lit("USD"))
    least = spark.createDataFrame([("USD", -900.0)], "token string, least double")
    low = held.join(F.broadcast(least), "token").filter("b < least").join(V.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return low.select(F.col("n_name").alias("venue"), F.concat_ws(":", F.lit("low"), "n_name", "token").alias("dedupe_key"), r("b", 2).alias("balance"))


@query("normalize_ngn_usd", "SELECT id, round(CASE WHEN bid<1 THEN 1/ask ELSE bid END,5) AS bid, round(CASE WHEN ask<1 THEN 1/bid ELSE ask END,5) AS ask, round(CASE WHEN mid<1 THEN 1/mid ELSE mid END,5) AS mid FROM (SELECT id, mid*0.999::DOUBLE AS bid, mid*1.001::DOUBLE AS ask, mid, source FROM quotes) WHERE mid>0 AND bid<>0 AND ask<>0 AND source<>'error'", "quotes")
def normalize_ngn_usd(spark, sf):
    """Quotes of a convertible pair per dollar: below 1 the pair is inverted and the sides change places."""
    valid = V.quotes(spark, sf).filter("source <> 'error'").select("id", "bid", "ask", "mid").filter("mid > 0 and bid <> 0 and ask <> 0")
    flip = lambda value, by: r(F.when(F.col(value) < 1, 1 / F.col(by)).otherwise(F.col(value)), 5).alias(value)
    return valid.select("id", flip("bid", "ask"), flip("ask", "bid"), flip("mid", "mid"))


@query("anchor_delta_bps", ", b AS (SELECT source, ts_ms//3600000 AS hour, max_by(mid, struct_pack(a:=ts_ms,b:=id)) AS mid FROM quotes WHERE mid>0 GROUP BY 1,2), l AS (SELECT *, lag(mid) OVER (PARTITION BY source ORDER BY hour) AS before FROM b) SELECT source, hour, round((mid-before)/before*10000,3) AS bps, abs((mid-before)/before*10000)>=25 AS requote FROM l WHERE before>0", "quotes")
def anchor_delta_bps(spark, sf):
    hourly = V.quotes(spark, sf).filter("mid > 0").groupBy("source", F.floor(F.col("ts_ms") / K.HOUR).alias("hour")).agg(F.max_by("mid", F.struct("ts_ms", "id")).alias("mid"))
    before = F.lag("mid").over(Window.partitionBy("source").orderBy("hour"))
    moved = (F.col("mid") - F.col("before")) / F.col("before") * 10000
    return hourly.withColumn("before", before).filter("before > 0").select("source", "hour", r(moved, 3).alias("bps"), (F.abs(moved) >= 25).alias("requote"))


@query("anchor_reference", "SELECT c_custkey, CASE c_custkey%3 WHEN 0 THEN (CASE WHEN c_acctbal>0 THEN c_acctbal END) WHEN 1 THEN (CASE WHEN c_acctbal*2>0 THEN round(1/(c_acctbal*2),12) END) ELSE (CASE WHEN c_nationkey>0 THEN c_nationkey::DOUBLE END) END AS reference FROM customer")
def anchor_reference(spark, sf):
    """By the source an account names: its blend, the inverse of its book's mid, or the pools' mean."""
    choice = F.col("c_custkey") % 3
    positive = lambda x: F.when(x > 0, x)
    chosen = F.when(choice == 0, positive(F.col("c_acctbal"))).when(choice == 1, r(K.inverted(F.col("c_acctbal") * 2), 12)).otherwise(positive(F.col("c_nationkey").cast("double")))
    return V.read(spark, sf, "customer").select("c_custkey", chosen.alias("reference"))


@query("avg_valid_rates", "SELECT p_partkey, (SELECT avg(x) FROM (SELECT unnest([CASE WHEN p_size%4<>0 THEN p_retailprice END, CASE WHEN p_size%3<>0 THEN 1/p_retailprice END, CASE WHEN p_size%5<>0 THEN p_retailprice*2 END, NULL]) AS x)) AS rate FROM part")
def avg_valid_rates(spark, sf):
    return _rates(spark, sf).select("p_partkey", D.mean_of(F.col("rates")).alias("rate"))


def _rates(spark, sf) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    rates = F.array(F.when(size % 4 != 0, price), F.when(size % 3 != 0, 1 / price), F.when(size % 5 != 0, price * 2), F.lit(None).cast("double"))
    return V.read(spark, sf, "part").select("p_partkey", rates.alias("rates"))


@query("src_multi_route_rate", """, x AS (SELECT id, unnest(json_extract(payload,'$.routes[*]')) AS y FROM rate_payloads), z AS (SELECT id, TRY_CAST(json_extract_string(y,'$.rate') AS DOUBLE) AS rate, json_extract_string(y,'$.invert')='true' AS flip FROM x)
  SELECT id, count(*) FILTER (WHERE rate>0)::INT AS valid, round(avg(CASE WHEN flip THEN 1/nullif(rate,0) ELSE rate END) FILTER (WHERE rate>0),9) AS mean FROM z GROUP BY 1""", "rate_payloads")
def src_multi_route_rate(spark, sf):
    """Rates of a preview's routes, inverted where stated; the mean of the valid ones."""
    return O.route_rates(V.RELATIONS["rate_payloads"](spark, sf)).select("id", "valid", r("mean", 9).alias("mean"))


@query("src_rfq_preview", "SELECT p_partkey, round(p_retailprice/1000,9) AS sell, round(1/(p_retailprice/1000*1.002::DOUBLE),9) AS buy FROM part")
def src_rfq_preview(spark, sf):
    """Both directions' rates, scaled by 10**27 in the payload."""
    ray = lambda x: F.concat(F.lit('{"rateRay":"'), F.format_string("%.0f", x * 1e27), F.lit('"}'))
    rate = lambda x: P.number(F.get_json_object(x, "$.rateRay")) / 1e27
    price = F.col("p_retailprice") / 1000
    return V.read(spark, sf, "part").select("p_partkey", r(rate(ray(price)), 9).alias("sell"), r(1 / rate(ray(price * 1.002)), 9).alias("buy"))


@query("src_pool_cache", ", p AS (SELECT pool, max_by(struct_pack(u:=usd,t:=ts_ms), struct_pack(a:=ts_ms,b:=id)) AS s FROM swaps WHERE usd>0 GROUP BY 1) SELECT pool, s.t AS ts_ms, round(1/s.u,9) AS mid FROM p", "swaps")
def src_pool_cache(spark, sf):
    latest = V.swaps(spark, sf).filter("usd > 0").groupBy("pool").agg(F.max_by(F.struct("usd", "ts_ms"), F.struct("ts_ms", "id")).alias("s"))
    return latest.select("pool", "s.ts_ms", r(1 / F.col("s.usd"), 9).alias("mid"))


@query("join_left_lookup_volume", ", v AS (SELECT pool, sum(usd) AS volume FROM swaps GROUP BY 1) SELECT q.id, v.pool IS NOT NULL AS known, round(v.volume,2) AS volume FROM quotes q LEFT JOIN v ON q.id%4=v.pool", "swaps", "quotes")
def join_left_lookup_volume(spark, sf):
    volumes = V.swaps(spark, sf).groupBy("pool").agg(F.sum("usd").alias("volume"))
    return V.quotes(spark, sf).select("id").join(volumes, F.col("id") % 4 == F.col("pool"), "left").select("id", F.col("pool").isNotNull().alias("known"), r("volume", 2).alias("volume"))


@query("two_sided_depth", "SELECT id, round(volume*(mid*0.999::DOUBLE)+volume*2,3) AS depth FROM quotes", "quotes")
def two_sided_depth(spark, sf):
    return V.quotes(spark, sf).select("id", r(F.col("volume") * F.col("bid") + F.col("volume") * 2, 3).alias("depth"))


# --- filters, orders and sets ------------------------------------------------------------------------


@query("filter_eq_pair", "SELECT id, status FROM attempts WHERE pipeline='book_pool' AND direction='1-URGENT'", "attempts")
def filter_eq_pair(spark, sf):
    return V.attempts(spark, sf).filter((F.col("pipeline") == "book_pool") & (F.col("direction") == "1-URGENT")).select("id", "status")


@query("typed_view_cex", "SELECT * FROM attempts WHERE pipeline='book_pool'", "attempts")
def typed_view_cex(spark, sf):
    return V.attempts(spark, sf).filter("pipeline = 'book_pool'")


@query("typed_view_dex", "SELECT * FROM attempts WHERE pipeline='pool_pool'", "attempts")
def typed_view_dex(spark, sf):
    return V.attempts(spark, sf).filter("pipeline = 'pool_pool'")


@query("include_set", "SELECT id, source FROM quotes WHERE source IN ('click','view')", "quotes")
def include_set(spark, sf):
    return V.quotes(spark, sf).filter(F.col("source").isin("click", "view")).select("id", "source")


@query("source_map_exact", "SELECT id, CASE source WHEN 'click' THEN 'pool' WHEN 'signup' THEN 'ramp' ELSE source END AS venue, CASE source WHEN 'click' THEN 'A/B' WHEN 'signup' THEN 'B/A' ELSE '' END AS pair FROM quotes", "quotes")
def source_map_exact(spark, sf):
    names = spark.createDataFrame([("click", "pool", "A/B"), ("signup", "ramp", "B/A")], "source string, venue string, pair string")
    return V.quotes(spark, sf).join(F.broadcast(names), "source", "left").select("id", F.coalesce("venue", "source").alias("venue"), F.coalesce("pair", F.lit("")).alias("pair"))


@query("visible_venue_filter", "SELECT n_nationkey, n_name FROM nation WHERE lower(n_name)<>'china'")
def visible_venue_filter(spark, sf):
    return V.read(spark, sf, "nation").filter(F.lower("n_name") != "china").select("n_nationkey", "n_name")


@query("status_tab_filter", "SELECT 'all' AS tab, count(*)::BIGINT AS n FROM attempts UNION ALL SELECT status, count(*) FROM attempts WHERE status IN ('completed','half_open') GROUP BY 1", "attempts")
def status_tab_filter(spark, sf):
    tabs = F.array(F.lit("all"), F.when(F.col("status").isin("completed", "half_open"), F.col("status")))
    return V.attempts(spark, sf).select(F.explode(tabs).alias("tab")).filter("tab is not null").groupBy("tab").agg(F.count("*").alias("n"))


@query("severity_filter", "SELECT id, severity FROM alerts WHERE severity='critical'", "alerts")
def severity_filter(spark, sf):
    return V.alerts(spark, sf).filter("severity = 'critical'").select("id", "severity")


@query("last_n_global", "SELECT id, ts_ms, row_number() OVER (ORDER BY ts_ms, id)::INT AS place FROM (SELECT id, ts_ms FROM quotes ORDER BY ts_ms DESC, id DESC LIMIT 100)", "quotes")
def last_n_global(spark, sf):
    """The latest 100 in time order; the window is over these."""
    last = relations.top_n(V.quotes(spark, sf), [F.col("ts_ms").desc(), F.col("id").desc()], 100).select("id", "ts_ms")
    return last.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("ts_ms", "id")))


@query("reverse_after_limit", "SELECT id, row_number() OVER (ORDER BY ts_ms, id)::INT AS place FROM (SELECT id, ts_ms FROM quotes WHERE source='view' ORDER BY ts_ms DESC, id DESC LIMIT 50)", "quotes")
def reverse_after_limit(spark, sf):
    page = relations.top_n(V.quotes(spark, sf).filter("source = 'view'"), [F.col("ts_ms").desc(), F.col("id").desc()], 50)
    return page.select("id", F.row_number().over(Window.partitionBy().orderBy("ts_ms", "id")).alias("place"))


@query("sparkline", "SELECT source, ts_ms//30000*30000 AS bucket, round(min_by(mid, struct_pack(a:=ts_ms,b:=id)),9) AS mid FROM quotes GROUP BY 1,2", "quotes")
def sparkline(spark, sf):
    return V.quotes(spark, sf).groupBy("source", K.bucket(F.col("ts_ms"), 30_000).alias("bucket")).agg(r(F.min_by("mid", F.struct("ts_ms", "id")), 9).alias("mid"))


@query("union_sources", "SELECT 'account' AS kind, c_custkey AS id, NULL AS error FROM customer UNION ALL SELECT 'exchange', s_suppkey, NULL FROM supplier UNION ALL SELECT 'exchange', n_nationkey+1000000, 'Holdings unavailable' FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal>9000)")
def union_sources(spark, sf):
    source = lambda df, kind, id_: df.select(F.lit(kind).alias("kind"), id_.alias("id"), F.lit(None).cast("string").alias("error"))
    rich = V.read(spark, sf, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    failed = V.read(spark, sf, "nation").join(rich, "n_nationkey", "left_anti")
    out = source(V.read(spark, sf, "customer"), "account", F.col("c_custkey")).unionByName(source(V.read(spark, sf, "supplier"), "exchange", F.col("s_suppkey")))
    return out.unionByName(source(failed, "exchange", F.col("n_nationkey") + 1000000).withColumn("error", F.lit("Holdings unavailable")))


@query("set_difference", "SELECT DISTINCT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus='P'")
def set_difference(spark, sf):
    seen = V.read(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return V.read(spark, sf, "customer").select("c_custkey").distinct().join(seen, "c_custkey", "left_anti")


@query("set_intersect", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal<0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal<0")
def set_intersect(spark, sf):
    poor = lambda table, key, value: V.read(spark, sf, table).filter(F.col(value) < 0).select(F.col(key).alias("nation"))
    return poor("customer", "c_nationkey", "c_acctbal").intersect(poor("supplier", "s_nationkey", "s_acctbal"))


@query("antijoin_active_lp", "SELECT s_suppkey FROM supplier WHERE s_acctbal<0 AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity>=50 AND l_discount>=0.1 AND l_tax>=0.08)")
def antijoin_active_lp(spark, sf):
    """Accounts that need a refill and hold no active position."""
    active = V.read(spark, sf, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.1 and l_tax >= 0.08").select(F.col("l_suppkey").alias("s_suppkey"))
    return V.read(spark, sf, "supplier").filter("s_acctbal < 0").join(active, "s_suppkey", "left_anti").select("s_suppkey")


@query("lp_ownership", """WITH m AS (SELECT l_partkey AS token, (l_suppkey*7+l_linenumber)%50 AS sender, l_suppkey%50 AS owner, epoch_us(l_shipdate)//1000 AS ts, l_orderkey AS o, l_linenumber AS n FROM lineitem), c AS (SELECT sender AS owner, token FROM m UNION SELECT owner, token FROM m),
  h AS (SELECT token, max_by(owner, struct_pack(a:=ts,b:=o,c:=n,d:=owner)) AS held FROM m GROUP BY 1) SELECT owner, count(*)::BIGINT AS candidates, count(*) FILTER (WHERE held=owner)::BIGINT AS owned FROM c JOIN h USING (token) GROUP BY 1""")
def lp_ownership(spark, sf):
    """Tokens that came to or left an owner are candidates; owned are those whose latest transfer went to it."""
    moves = V.read(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("token"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 50).alias("sender"), (F.col("l_suppkey") % 50).alias("owner"), F.struct(V.millis("l_shipdate"), "l_orderkey", "l_linenumber", F.col("l_suppkey") % 50).alias("at")
    )
    return relations.ownership(moves).groupBy("owner").agg(F.count("*").alias("candidates"), F.count_if("owned").alias("owned"))


@query("merge_status_updates", "WITH u AS (SELECT o_custkey, max_by(o_orderstatus, struct_pack(a:=o_orderdate,b:=o_orderkey)) AS status FROM orders WHERE o_orderpriority='1-URGENT' GROUP BY 1) SELECT c_custkey, coalesce(u.status, c_mktsegment) AS status FROM customer LEFT JOIN u ON o_custkey=c_custkey")
def merge_status_updates(spark, sf):
    updates = V.read(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    return V.read(spark, sf, "customer").join(updates, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("status", "c_mktsegment").alias("status"))


# --- keyed writes and rollups ------------------------------------------------------------------------


@query("patch_update", """, e AS (SELECT attempt_id, event_type, ts_ms, event_id, CASE WHEN event_type<>'routed' THEN expected END AS profit, CASE WHEN event_type='failed' THEN reason END AS why FROM lifecycle)
  SELECT attempt_id, max_by(event_type, struct_pack(a:=ts_ms,b:=event_id)) AS status, max_by(profit, struct_pack(a:=ts_ms,b:=event_id)) FILTER (WHERE profit IS NOT NULL) AS profit, max_by(why, struct_pack(a:=ts_ms,b:=event_id)) FILTER (WHERE why IS NOT NULL) AS why FROM e GROUP BY 1""", "lifecycle")
def patch_update(spark, sf):
    """Each change sets only what it states."""
    log = V.lifecycle(spark, sf).select("attempt_id", "ts_ms", "event_id", F.col("event_type").alias("status"), F.when(F.col("event_type") != "routed", F.col("expected")).alias("profit"), F.when(F.col("event_type") == "failed", F.col("reason")).alias("why"))
    return relations.upsert_coalesce(log, "attempt_id", ["ts_ms", "event_id"], ["status", "profit", "why"], [])


@query("upsert_partial_parent", "SELECT attempt_id, min_by(event_type, struct_pack(a:=ts_ms,b:=event_id)) AS status, min(ts_ms) AS detected, max_by(size, struct_pack(a:=ts_ms,b:=event_id)) AS size, max_by(expected, struct_pack(a:=ts_ms,b:=event_id)) AS expected FROM lifecycle GROUP BY 1", "lifecycle")
def upsert_partial_parent(spark, sf):
    """The first event makes the parent; later ones change its route columns only."""
    at = F.struct("ts_ms", "event_id")
    return V.lifecycle(spark, sf).groupBy("attempt_id").agg(F.min_by("event_type", at).alias("status"), F.min("ts_ms").alias("detected"), F.max_by("size", at).alias("size"), F.max_by("expected", at).alias("expected"))


@query("wallet_struct", "SELECT o_orderkey, o_custkey%3=0 AS empty, CASE WHEN o_custkey%3<>0 THEN coalesce(CASE WHEN o_custkey%2=0 THEN o_clerk_ END,'-') END AS sender FROM (SELECT *, 'clerk '||o_custkey AS o_clerk_ FROM orders)")
def wallet_struct(spark, sf):
    """One struct of three columns, null if all are."""
    some, even = F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 2 == 0
    clerk = F.concat(F.lit("clerk "), F.col("o_custkey").cast("string"))
    made = relations.struct_or_null(a=F.when(some & even, clerk), b=F.when(some, F.col("o_orderkey")), c=F.when(some, F.col("o_totalprice")))
    return V.read(spark, sf, "orders").withColumn("w", made).select("o_orderkey", F.col("w").isNull().alias("empty"), F.when(F.col("w").isNotNull(), F.coalesce("w.a", F.lit("-"))).alias("sender"))


@query("map_lower_merge", "SELECT p_partkey, lower(k) AS token, sum(v)::DOUBLE AS amount FROM (SELECT p_partkey, 'USDT' AS k, p_size*1.0::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 'usdt', 2.5 FROM part UNION ALL SELECT p_partkey, 'Base', p_retailprice FROM part) GROUP BY 1,2")
def map_lower_merge(spark, sf):
    held = V.read(spark, sf, "part").select("p_partkey", F.create_map(F.lit("USDT"), F.col("p_size").cast("double"), F.lit("usdt"), F.lit(2.5), F.lit("Base"), F.col("p_retailprice")).alias("m"))
    return held.withColumn("m", relations.lower_merged(F.col("m"))).select("p_partkey", F.explode("m").alias("token", "amount"))


@query("venue_value_rollup", "SELECT n_name AS venue, round(sum(c_acctbal),2) AS value, count(*)::BIGINT AS roles FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1")
def venue_value_rollup(spark, sf):
    roles = V.read(spark, sf, "customer").join(V.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return roles.groupBy(F.col("n_name").alias("venue")).agg(r(F.sum("c_acctbal"), 2).alias("value"), F.count("*").alias("roles"))


@query("portfolio_errors", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment||' failed', '; ' ORDER BY c_mktsegment||' failed') FILTER (WHERE c_acctbal<0) AS errors FROM customer GROUP BY 1")
def portfolio_errors(spark, sf):
    failed = F.when(F.col("c_acctbal") < 0, F.concat("c_mktsegment", F.lit(" failed")))
    out = V.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set(failed)).alias("e"))
    return out.select("c_nationkey", F.when(F.size("e") > 0, F.array_join("e", "; ")).alias("errors"))


@query("refill_count", "SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal<1000)::BIGINT AS n FROM customer GROUP BY 1")
def refill_count(spark, sf):
    return V.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") < 1000).alias("n"))


@query("fallback_rate", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal>5000 THEN c_acctbal-5000 END, CASE WHEN c_acctbal>0 THEN c_acctbal END, CASE WHEN c_nationkey>3 THEN c_nationkey::DOUBLE END, CASE WHEN c_custkey%2=0 THEN 1.0::DOUBLE/c_custkey END) AS rate FROM customer")
def fallback_rate(spark, sf):
    """The first positive one of three averages and the venues' marks."""
    balance, mark = F.col("c_acctbal"), F.when(F.col("c_custkey") % 2 == 0, 1.0 / F.col("c_custkey"))
    return V.read(spark, sf, "customer").select("c_custkey", P.first_positive(balance - 5000, balance, F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("double")), mark).alias("rate"))


_HOLD = "WITH h AS (SELECT c_nationkey, CASE WHEN count(*) FILTER (WHERE c_acctbal<-990)=0 THEN sum(greatest(c_acctbal,0)) END AS base, count(*)*100.0::DOUBLE AS usd FROM customer GROUP BY 1), v AS (SELECT *, CASE WHEN base IS NOT NULL THEN usd+base*0.5::DOUBLE END AS value FROM h) "


def _holdings(spark, sf) -> DataFrame:
    unread = F.count_if(F.col("c_acctbal") < -990) > 0
    held = V.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.when(~unread, F.sum(F.greatest("c_acctbal", F.lit(0.0)))).alias("base"), (F.count("*") * 100.0).alias("usd"))
    return held.withColumn("value", F.col("usd") + F.col("base") * 0.5)


@query("portfolio_share", _HOLD + "SELECT c_nationkey, round(CASE WHEN value IS NULL THEN NULL WHEN value=0 OR base=0 THEN 0 ELSE base*0.5/value END,9)::DOUBLE AS share FROM v")
def portfolio_share(spark, sf):
    """Share of the base token; 0 where there is none, null where a balance is unknown."""
    known = F.when((F.col("value") == 0) | (F.col("base") == 0), 0.0).otherwise(F.col("base") * 0.5 / F.col("value"))
    return _holdings(spark, sf).select("c_nationkey", r(F.when(F.col("value").isNotNull(), known), 9).alias("share"))


@query("portfolio_value", _HOLD + "SELECT round(sum(usd) FILTER (WHERE c_nationkey%3=0),2) AS book_usd, round(sum(base*0.5) FILTER (WHERE c_nationkey%3=0),2) AS book_base_usd, round(sum(usd) FILTER (WHERE c_nationkey%3=1),2) AS pool_a_usd, round(sum(base*0.5) FILTER (WHERE c_nationkey%3=1),2) AS pool_a_base_usd, round(sum(usd) FILTER (WHERE c_nationkey%3=2),2) AS pool_b_usd, round(sum(base*0.5) FILTER (WHERE c_nationkey%3=2),2) AS pool_b_base_usd FROM v")
def portfolio_value(spark, sf):
    """Six fields in one row: both tokens' value at each of three venues."""
    fields = []
    for k, name in enumerate(("book", "pool_a", "pool_b")):
        own = F.col("c_nationkey") % 3 == k
        fields += [r(F.sum(F.when(own, F.col("usd"))), 2).alias(f"{name}_usd"), r(F.sum(F.when(own, F.col("base") * 0.5)), 2).alias(f"{name}_base_usd")]
    return _holdings(spark, sf).agg(*fields)


@query("stale_fallback", "SELECT desk, max(ts_ms) AS last, max(ts_ms) < (SELECT max(ts_ms) FROM trades)-60000 AS stale, min(CASE WHEN size>50 THEN 1 ELSE 0 END)=0 AND max(ts_ms) < (SELECT max(ts_ms) FROM trades)-60000 AS poll FROM trades GROUP BY 1", "trades")
def stale_fallback(spark, sf):
    """Polling starts for a stream that has been silent for a minute and is not marked healthy."""
    log = V.trades(spark, sf)
    newest = log.agg(F.max("ts_ms").alias("newest"))
    by = log.groupBy("desk").agg(F.max("ts_ms").alias("last"), (F.min(F.when(F.col("size") > 50, 1).otherwise(0)) == 0).alias("unhealthy")).join(F.broadcast(newest))
    stale = F.col("last") < F.col("newest") - 60_000
    return by.select("desk", "last", stale.alias("stale"), (F.col("unhealthy") & stale).alias("poll"))
