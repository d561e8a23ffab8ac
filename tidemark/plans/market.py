"""Registered market queries with the SQL they equal. Floats are rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import books, orders, prices, relations, trades
from ..sources import views as V
from ..sources.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
AS_OF = 1_706_659_200_000  # 2024-01-31, after the last event
ORDERS_AS_OF = 1_000_000_000_000


def query(name: str, sql: str, *relations_: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        ORACLES[name] = with_views(sql, *relations_) if relations_ else sql
        return fn

    return register


def r(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


# --- relations -----------------------------------------------------------------------------------


@query("arb_stats", """SELECT count(*)::BIGINT AS detected, count(*) FILTER (WHERE status='completed')::BIGINT AS executed,
  round(coalesce(sum(actual_profit) FILTER (WHERE status='completed'),0),2) AS profit, round(coalesce(sum(coalesce(executed_size,0)) FILTER (WHERE status='completed'),0),2) AS volume FROM attempts""", "attempts")
def arb_stats(spark, sf):
    return trades.attempt_stats(V.attempts(spark, sf)).withColumns({"profit": r("profit", 2), "volume": r("volume", 2)})


_YEAR = ORDERS_AS_OF - 31_536_000_000


@query("arb_status", f"""SELECT count(*)::BIGINT AS detected, count(*) FILTER (WHERE detected_ms>={_YEAR})::BIGINT AS recent, count(*) FILTER (WHERE status='completed')::BIGINT AS executed, count(*) FILTER (WHERE status='completed' AND detected_ms>={_YEAR})::BIGINT AS recent_executed,
  round(coalesce(sum(actual_profit) FILTER (WHERE status='completed'),0),2) AS profit, round(coalesce(sum(actual_profit) FILTER (WHERE status='completed' AND detected_ms>={_YEAR}),0),2) AS recent_profit,
  round(coalesce(sum(executed_size) FILTER (WHERE status='completed'),0),2) AS volume, round(coalesce(sum(executed_size) FILTER (WHERE status='completed' AND detected_ms>={_YEAR}),0),2) AS recent_volume FROM attempts""", "attempts")
def arb_status(spark, sf):
    """Counts, profit and volume of all time and of a recent span, in one pass."""
    recent, done = F.col("detected_ms") >= _YEAR, F.col("status") == "completed"
    total = lambda on, value: r(F.coalesce(F.sum(F.when(on, F.col(value))), F.lit(0.0)), 2)
    sums = [total(on, value).alias(name) for value, names in (("actual_profit", ("profit", "recent_profit")), ("executed_size", ("volume", "recent_volume"))) for on, name in zip((done, done & recent), names)]
    return V.attempts(spark, sf).agg(F.count("*").alias("detected"), F.count_if(recent).alias("recent"), F.count_if(done).alias("executed"), F.count_if(done & recent).alias("recent_executed"), *sums)


@query("optional_filters", """SELECT id, status, detected_ms FROM attempts WHERE status='completed' AND detected_ms>=800000000000 ORDER BY detected_ms DESC, id DESC LIMIT 100""", "attempts")
def optional_filters(spark, sf):
    out = relations.optional_filters(V.attempts(spark, sf), "detected_ms", status="completed", from_ts=800000000000)
    return relations.top_n(out, [F.col("detected_ms").desc(), F.col("id").desc()], 100).select("id", "status", "detected_ms")


@query("filter_in_list", "SELECT id, venue, ts_ms, value FROM positions WHERE venue IN ('CHINA','FRANCE','NATION_3','NATION_7') AND ts_ms>=700000000000 AND value IS NOT NULL", "positions")
def filter_in_list(spark, sf):
    return V.positions(spark, sf).filter(F.col("venue").isin("CHINA", "FRANCE", "NATION_3", "NATION_7") & (F.col("ts_ms") >= 700000000000) & F.col("value").isNotNull())


@query("filter_contains_ci", "SELECT id, source, ts_ms FROM quotes WHERE source ILIKE '%IGN%'", "quotes")
def filter_contains_ci(spark, sf):
    return V.quotes(spark, sf).filter(F.col("source").ilike("%IGN%")).select("id", "source", "ts_ms")


@query("filter_between_ts", "SELECT id, source FROM quotes WHERE ts_ms BETWEEN 1704200000000 AND 1704900000000", "quotes")
def filter_between_ts(spark, sf):
    return V.quotes(spark, sf).filter(F.col("ts_ms").between(1704200000000, 1704900000000)).select("id", "source")


@query("point_lookup", "SELECT id, pipeline, status FROM attempts WHERE id=77 AND pipeline IN ('book_pool','pool_pool')", "attempts")
def point_lookup(spark, sf):
    return V.attempts(spark, sf).filter((F.col("id") == 77) & F.col("pipeline").isin("book_pool", "pool_pool")).select("id", "pipeline", "status")


@query("top_n_desc", "SELECT id, ts_ms FROM quotes ORDER BY ts_ms DESC, id DESC LIMIT 50", "quotes")
def top_n_desc(spark, sf):
    return relations.top_n(V.quotes(spark, sf), [F.col("ts_ms").desc(), F.col("id").desc()], 50).select("id", "ts_ms")


@query("oldest_n_window", "SELECT id, ts_ms FROM quotes WHERE ts_ms>=1704200000000 ORDER BY ts_ms, id LIMIT 500", "quotes")
def oldest_n_window(spark, sf):
    return relations.top_n(V.quotes(spark, sf).filter("ts_ms >= 1704200000000"), [F.col("ts_ms"), F.col("id")], 500).select("id", "ts_ms")


@query("last_n_per_source", "SELECT id, source, ts_ms FROM quotes QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts_ms DESC, id DESC) <= 5", "quotes")
def last_n_per_source(spark, sf):
    return relations.n_per_key(V.quotes(spark, sf), ["source"], [F.col("ts_ms").desc(), F.col("id").desc()], 5).select("id", "source", "ts_ms")


@query("latest_per_key", "SELECT pool, id, ts_ms, round(usd,6) AS usd FROM swaps QUALIFY row_number() OVER (PARTITION BY pool ORDER BY ts_ms DESC, id DESC)=1", "swaps")
def latest_per_key(spark, sf):
    return relations.latest_per_key(V.swaps(spark, sf), ["pool"], ["ts_ms", "id"]).select("pool", "id", "ts_ms", r("usd").alias("usd"))


@query("active_attempt", "SELECT direction, id, detected_ms FROM attempts WHERE status IN ('detected','half_open') QUALIFY row_number() OVER (PARTITION BY direction ORDER BY detected_ms DESC, id DESC)=1", "attempts")
def active_attempt(spark, sf):
    return relations.latest_per_key(V.attempts(spark, sf).filter(F.col("status").isin("detected", "half_open")), ["direction"], ["detected_ms", "id"]).select("direction", "id", "detected_ms")


@query("expire_stale", f"""SELECT CASE WHEN status IN ('detected','executing') AND detected_ms<{ORDERS_AS_OF}-60000 THEN 'expired' ELSE status END AS status,
  CASE WHEN status IN ('detected','executing') AND detected_ms<{ORDERS_AS_OF}-60000 THEN 'Timeout' END AS reason, count(*)::BIGINT AS n FROM attempts GROUP BY 1,2""", "attempts")
def expire_stale(spark, sf):
    return relations.expire_stale(V.attempts(spark, sf), F.lit(ORDERS_AS_OF), 60_000).groupBy("status", "reason").agg(F.count("*").alias("n"))


@query("history_topn", "SELECT attempt_id, max(ts_ms) AS latest FROM lifecycle JOIN attempts ON id=attempt_id WHERE pipeline='book_pool' GROUP BY 1 HAVING max(ts_ms)>=800000000000 ORDER BY latest DESC, attempt_id DESC LIMIT 30", "lifecycle", "attempts")
def history_topn(spark, sf):
    own = V.attempts(spark, sf).filter("pipeline = 'book_pool'").select(F.col("id").alias("attempt_id"))
    out = V.lifecycle(spark, sf).join(own, "attempt_id").groupBy("attempt_id").agg(F.max("ts_ms").alias("latest")).filter("latest >= 800000000000")
    return relations.top_n(out, [F.col("latest").desc(), F.col("attempt_id").desc()], 30)


@query("history_items", """, e AS (SELECT l.*, a.pipeline, a.direction FROM lifecycle l JOIN attempts a ON a.id=l.attempt_id WHERE l.ts_ms<=900000000000),
 f AS (SELECT attempt_id, pipeline, direction, count(*) AS n_events,
   coalesce(min_by(struct_pack(t:=ts_ms,s:=size), struct_pack(a:=ts_ms,b:=event_id)) FILTER (WHERE event_type='routed'), min_by(struct_pack(t:=ts_ms,s:=size), struct_pack(a:=ts_ms,b:=event_id))) AS routed,
   coalesce(max_by(expected, struct_pack(a:=ts_ms,b:=event_id)) FILTER (WHERE event_type IN ('executed','failed')), max_by(expected, struct_pack(a:=ts_ms,b:=event_id))) AS result,
   max_by(struct_pack(e:=event_type,t:=ts_ms,r:=reason,b:=buy_venue,s:=sell_venue,h:=tx_hash), struct_pack(a:=ts_ms,b:=event_id)) AS latest,
   coalesce(min_by(wallet, struct_pack(a:=ts_ms,b:=event_id)) FILTER (WHERE event_type='routed'), min_by(wallet, struct_pack(a:=ts_ms,b:=event_id))) AS wallet,
   coalesce(max_by(struct_pack(g:=gain,m:=moved), struct_pack(a:=ts_ms,b:=event_id)) FILTER (WHERE event_type IN ('executed','failed')), max_by(struct_pack(g:=gain,m:=moved), struct_pack(a:=ts_ms,b:=event_id))) AS ended FROM e GROUP BY 1,2,3)
 SELECT latest.b AS buy_venue, latest.s AS sell_venue, latest.h AS tx_hash, wallet, ended.g AS actual_profit, ended.m AS moved, attempt_id, pipeline, direction, routed.t AS routed_at, routed.s AS size, result, latest.e AS last_event, latest.t AS last_at, latest.r AS reason, n_events::BIGINT AS n_events
 FROM f WHERE latest.t>=700000000000 ORDER BY latest.t DESC, attempt_id DESC LIMIT 200""", "lifecycle", "attempts")
def history_items(spark, sf):
    return trades.history(V.lifecycle(spark, sf), V.attempts(spark, sf), 200, from_ts=700000000000, to_ts=900000000000)


@query("upsert_last_wins", "SELECT venue, ts_ms, id, value FROM positions QUALIFY row_number() OVER (PARTITION BY venue, ts_ms ORDER BY id DESC)=1", "positions")
def upsert_last_wins(spark, sf):
    return relations.latest_per_key(V.positions(spark, sf), ["venue", "ts_ms"], ["id"])


@query("upsert_coalesce", "SELECT venue, max_by(value,id) FILTER (WHERE value IS NOT NULL) AS value, max(id) AS last_id FROM positions GROUP BY venue", "positions")
def upsert_coalesce(spark, sf):
    log = V.positions(spark, sf).withColumn("last_id", F.col("id"))
    return relations.upsert_coalesce(log, "venue", ["id"], ["value"], ["last_id"])


@query("insert_ignore", "SELECT idempotency_key, min(id) AS id FROM actions WHERE idempotency_key IS NOT NULL GROUP BY 1", "actions")
def insert_ignore(spark, sf):
    keyed = V.actions(spark, sf).filter("idempotency_key is not null").select("idempotency_key", "id")
    return relations.first_per_key(keyed, ["idempotency_key"], "id")


@query("idempotent_insert", """SELECT idempotency_key, min(id) AS id, max_by(amount, id) AS amount, count(*)::BIGINT AS n FROM actions WHERE idempotency_key IS NOT NULL GROUP BY 1
  UNION ALL SELECT NULL, id, amount, 1 FROM actions WHERE idempotency_key IS NULL""", "actions")
def idempotent_insert(spark, sf):
    log = V.actions(spark, sf)
    keyed = log.filter("idempotency_key is not null").groupBy("idempotency_key").agg(F.min("id").alias("id"), F.max_by("amount", "id").alias("amount"), F.count("*").alias("n"))
    return keyed.unionByName(log.filter("idempotency_key is null").select("idempotency_key", "id", "amount", F.lit(1).cast("bigint").alias("n")))


@query("delete_key", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def delete_key(spark, sf):
    return V.read(spark, sf, "customer").join(V.read(spark, sf, "events"), F.col("c_custkey") == F.col("user_id"), "left_anti").select("c_custkey")


@query("alert_rollup", "SELECT dedupe_key, count(*)::BIGINT AS occurrences, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen, max_by(severity, struct_pack(a:=ts_ms,b:=id)) AS severity FROM alerts GROUP BY 1", "alerts")
def alert_rollup(spark, sf):
    return V.alerts(spark, sf).groupBy("dedupe_key").agg(F.count("*").alias("occurrences"), F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("last_seen"), F.max_by("severity", F.struct("ts_ms", "id")).alias("severity"))


@query("severity_counts", "SELECT severity, count(*)::BIGINT AS n FROM alerts GROUP BY 1", "alerts")
def severity_counts(spark, sf):
    return V.alerts(spark, sf).groupBy("severity").agg(F.count("*").alias("n"))


@query("status_counts", "SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE status='completed')::BIGINT AS completed, count(*) FILTER (WHERE status='half_open')::BIGINT AS half_open FROM attempts", "attempts")
def status_counts(spark, sf):
    return V.attempts(spark, sf).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "half_open").alias("half_open"))


@query("paginate", "SELECT id, detected_ms FROM attempts ORDER BY detected_ms DESC, id LIMIT 20 OFFSET 40", "attempts")
def paginate(spark, sf):
    return relations.page(V.attempts(spark, sf), [F.col("detected_ms").desc(), F.col("id")], 3, 20).select("id", "detected_ms")


# --- prices --------------------------------------------------------------------------------------


@query("pair_dispatch_normalize", "SELECT id, source, round(CASE WHEN source='signup' THEN 1/mid ELSE mid END,9) AS price FROM quotes WHERE (source='signup' AND mid>0) OR (source<>'signup' AND mid>0 AND mid<1)", "quotes")
def pair_dispatch_normalize(spark, sf):
    return prices.normalised(V.quotes(spark, sf)).select("id", "source", r("price", 9).alias("price"))


@query("range_heuristic_normalize", "SELECT id, round(CASE WHEN mid<=0 THEN NULL WHEN mid<1 THEN mid WHEN mid>100 THEN 1/mid END,9) AS price FROM quotes", "quotes")
def range_heuristic_normalize(spark, sf):
    return V.quotes(spark, sf).select("id", r(K.normalised_by_range(F.col("mid")), 9).alias("price"))


_NORMAL = ", n AS (SELECT *, CASE WHEN source='signup' THEN 1/mid ELSE mid END AS price FROM quotes WHERE (source='signup' AND mid>0) OR (source<>'signup' AND mid>0 AND mid<1)) "


@query("vwap", _NORMAL + "SELECT source, round(coalesce(sum(price*volume)/nullif(sum(volume),0),0),9) AS vwap FROM n GROUP BY source", "quotes")
def vwap(spark, sf):
    return prices.normalised(V.quotes(spark, sf)).groupBy("source").agg(r(prices.weighted_mean(F.col("price"), F.col("volume")), 9).alias("vwap"))


@query("twap", f""", w AS (SELECT *, greatest(coalesce(lead(ts_ms) OVER (ORDER BY ts_ms, id), {AS_OF})-ts_ms,1) AS weight FROM quotes)
  SELECT round(sum(CASE WHEN source='signup' THEN 1/mid ELSE mid END*weight)/sum(weight),8) AS twap FROM w WHERE source<>'error' AND ((source='signup' AND mid>0) OR (source<>'signup' AND mid>0 AND mid<1))""", "quotes")
def twap(spark, sf):
    return prices.twap(V.quotes(spark, sf), F.lit(AS_OF)).select(r("twap", 8).alias("twap"))


_SPANS = {"twap_5m": 300_000, "twap_1h": K.HOUR}
_TWAPS = ", w AS (SELECT *, greatest(coalesce(lead(ts_ms) OVER (ORDER BY ts_ms, id),(SELECT max(ts_ms) FROM quotes))-ts_ms,1) AS weight FROM quotes)" + "".join(
    f""", {name}_ AS (SELECT coalesce(sum(CASE WHEN source='signup' THEN 1/mid ELSE mid END*weight)/sum(weight),0) AS x FROM w WHERE ts_ms>(SELECT max(ts_ms) FROM quotes)-{ms} AND source<>'error' AND ((source='signup' AND mid>0) OR (source<>'signup' AND mid>0 AND mid<1)))"""
    for name, ms in _SPANS.items()
)


@query("blended_price", _NORMAL + """, v AS (SELECT sum(price*volume)/sum(volume) AS vwap, count(DISTINCT source)::BIGINT AS sources FROM n WHERE source<>'error'),
  k AS (SELECT (SELECT count(DISTINCT source) FROM quotes)-1 AS attempted)""" + _TWAPS + """
  SELECT round(vwap,8) AS vwap, round(CASE WHEN twap_5m_.x=0 THEN vwap ELSE twap_5m_.x END,8) AS twap_5m, round(CASE WHEN twap_1h_.x=0 THEN vwap ELSE twap_1h_.x END,8) AS twap_1h, sources, round(least(0.9,greatest(0,0.9-0.2*(attempted-sources))),6)::DOUBLE AS confidence,
   round(CASE WHEN vwap>0 THEN 1/round(vwap,8) ELSE 0 END,6) AS inverse FROM v, k, twap_5m_, twap_1h_""", "quotes")
def blended_price(spark, sf):
    """Volume mean of now and time means of two spans before the newest quote; a span without quotes takes
    the volume mean. All parts are single rows."""
    every = V.quotes(spark, sf)
    quotes = every.filter(~F.col("source").isin(*prices.EXCLUDED))
    attempted = quotes.agg(F.countDistinct("source").alias("attempted"))
    out = prices.normalised(quotes).agg(prices.weighted_mean(F.col("price"), F.col("volume")).alias("vwap"), F.countDistinct("source").alias("sources")).join(attempted)
    newest = every.agg(F.max("ts_ms").alias("newest"))
    weighed = prices.time_weights(every.join(F.broadcast(newest)), F.col("newest"))
    priced = prices.normalised(weighed).filter(~F.col("source").isin(*prices.EXCLUDED))
    for name, span in _SPANS.items():
        out = out.join(priced.filter(F.col("ts_ms") > F.col("newest") - span).agg(prices.weighted_mean(F.col("price"), F.col("weight")).alias(name)))
    or_vwap = lambda name: r(F.when(F.col(name) == 0, F.col("vwap")).otherwise(F.col(name)), 8).alias(name)
    vwap = F.round("vwap", 8)
    return out.select(vwap.alias("vwap"), *map(or_vwap, _SPANS), "sources", r(K.confidence(F.col("attempted") - F.col("sources"))).cast("double").alias("confidence"), r(F.when(F.col("vwap") > 0, 1 / vwap).otherwise(0.0)).alias("inverse"))


@query("upper_median", _NORMAL + """SELECT source, round(price,9) AS median FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY price, id) AS k, count(*) OVER (PARTITION BY source) AS c FROM n) WHERE k=c//2+1""", "quotes")
def upper_median(spark, sf):
    return prices.upper_median(prices.normalised(V.quotes(spark, sf)), ["source"], "price").select("source", r("median", 9).alias("median"))


@query("modal_price", """, v AS (SELECT source, round_even(mid*1000,0) AS v, count(*) AS c, min(struct_pack(t:=ts_ms,i:=id)) AS f FROM quotes GROUP BY 1,2)
  SELECT source, v AS mode FROM v QUALIFY row_number() OVER (PARTITION BY source ORDER BY c DESC, f)=1""", "quotes")
def modal_price(spark, sf):
    quotes = V.quotes(spark, sf).withColumns({"x": F.col("mid") * 1000, "_at": F.col("ts_ms") * 1_000_000 + F.col("id")})
    return prices.modal(quotes, ["source"], "x", "_at")


@query("deviation_filter", _NORMAL + """, m AS (SELECT source, price AS median FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY price, id) AS k, count(*) OVER (PARTITION BY source) AS c FROM n) WHERE k=c//2+1),
  d AS (SELECT n.*, abs(price-median)/median<=0.02 AS keep FROM n JOIN m USING (source)), e AS (SELECT *, count(*) FILTER (WHERE keep) OVER (PARTITION BY source) AS ins FROM d)
  SELECT id, source FROM e WHERE keep OR ins<2""", "quotes")
def deviation_filter(spark, sf):
    return prices.within_deviation(prices.normalised(V.quotes(spark, sf)), "source", "price", 0.02).select("id", "source")


@query("bucket_first", "SELECT source, ts_ms//3600000*3600000 AS bucket, round(max_by(mid, struct_pack(a:=ts_ms,b:=id)),9) AS mid FROM quotes GROUP BY 1,2", "quotes")
def bucket_first(spark, sf):
    return prices.bucketed(V.quotes(spark, sf), K.HOUR, "mid").select("source", "bucket", r("mid", 9).alias("mid"))


@query("bucket_last", "SELECT venue, ts_ms//604800000*604800000 AS bucket, round(max_by(value, struct_pack(a:=ts_ms,b:=id)),6) AS value FROM positions WHERE value IS NOT NULL GROUP BY 1,2", "positions")
def bucket_last(spark, sf):
    out = V.positions(spark, sf).filter("value is not null").withColumnRenamed("venue", "source")
    return prices.bucketed(out, 7 * K.DAY, "value").select(F.col("source").alias("venue"), "bucket", r("value").alias("value"))


_BUCKETS = _NORMAL + ", b AS (SELECT source, ts_ms//3600000*3600000 AS bucket, max_by(price, struct_pack(a:=ts_ms,b:=id)) AS price FROM n GROUP BY 1,2) "


@query("spread_series", _BUCKETS + "SELECT bucket, round((max(price)-min(price))/min(price)*10000,3) AS spread, count(*)::BIGINT AS venues FROM b GROUP BY 1 HAVING count(*)>=2", "quotes")
def spread_series(spark, sf):
    b = prices.bucketed(prices.normalised(V.quotes(spark, sf)), K.HOUR, "price")
    out = b.groupBy("bucket").agg(r((F.max("price") - F.min("price")) / F.min("price") * 10000, 3).alias("spread"), F.count("*").alias("venues"))
    return out.filter("venues >= 2")


@query("delta_series", _BUCKETS + "SELECT source, bucket, round(price - avg(price) OVER (PARTITION BY bucket),9) AS delta FROM b", "quotes")
def delta_series(spark, sf):
    b = prices.bucketed(prices.normalised(V.quotes(spark, sf)), K.HOUR, "price")
    return b.select("source", "bucket", r(F.col("price") - F.avg("price").over(Window.partitionBy("bucket")), 9).alias("delta"))


@query("spread_bps", ", b AS (SELECT book_id, max(price) FILTER (WHERE side='bid') AS bid, min(price) FILTER (WHERE side='ask') AS ask FROM levels GROUP BY 1) SELECT book_id, floor((ask-bid)/((bid+ask)/2)*10000+0.5)::INT AS bps, trunc((ask-bid)/((bid+ask)/2)*10000)::INT AS logged FROM b WHERE bid IS NOT NULL AND ask IS NOT NULL", "levels")
def spread_bps(spark, sf):
    """Spread of each book's best quotes, rounded half up for pages and truncated for logs."""
    mid = (F.col("bid") + F.col("ask")) / 2
    quoted = books.best_quotes(V.levels(spark, sf)).filter("bid IS NOT NULL")
    return quoted.select("book_id", K.spread_bps(F.col("bid"), F.col("ask"), mid).alias("bps"), ((F.col("ask") - F.col("bid")) / mid * 10000).cast("int").alias("logged"))


@query("ewma", """RECURSIVE n AS (SELECT event_type AS source, CASE WHEN event_type='signup' THEN 1/(1000+value) ELSE value/1000 END AS price, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts)//1000, event_id) AS k
   FROM events WHERE event_type='signup' OR (value>0 AND value<1000)),
  f AS (SELECT source, k, price AS mean, 0.0::DOUBLE AS var FROM n WHERE k=1 UNION ALL
   SELECT f.source, n.k, 0.975::DOUBLE*f.mean+(1-0.975::DOUBLE)*n.price, 0.975::DOUBLE*f.var+(1-0.975::DOUBLE)*(n.price-f.mean)*(n.price-f.mean) FROM f JOIN n ON n.source=f.source AND n.k=f.k+1)
  SELECT source, round(mean,9) AS mean, round(var,9) AS var FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY k DESC)=1""")
def ewma(spark, sf):
    return prices.ewma(prices.normalised(V.quotes(spark, sf))).select("source", r("mean", 9).alias("mean"), r("var", 9).alias("var"))


ORACLES["ewma"] = "WITH " + ORACLES["ewma"]


# --- books ---------------------------------------------------------------------------------------


@query("cum_depth", """, k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY price, level_id, part) AS rank FROM levels WHERE side='ask'), d AS (SELECT *, sum(amount) OVER (PARTITION BY book_id ORDER BY rank) AS depth FROM k WHERE rank<=15)
  SELECT book_id, rank::INT AS rank, round(depth,6) AS depth, round(depth/max(depth) OVER (PARTITION BY book_id),6) AS ratio FROM d""", "levels")
def cum_depth(spark, sf):
    return books.depth(V.levels(spark, sf), "ask").select("book_id", "rank", r("depth").alias("depth"), r("ratio").alias("ratio"))


def _walk_sql(side: str, cap: str, gain: str, size: float, fee: float) -> str:
    order = "price" if side == "ask" else "price DESC"
    return f""", c AS (SELECT *, {cap} AS cap FROM levels WHERE side='{side}'), t AS (SELECT *, greatest(0,least(cap,{size}::DOUBLE-coalesce(sum(cap) OVER (PARTITION BY book_id ORDER BY {order}, level_id, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))) AS take FROM c)
  SELECT book_id, round(sum({gain})*(1-{fee}::DOUBLE),1) AS out, round(sum(take),1) AS used FROM t GROUP BY 1"""


def _walked(df: DataFrame) -> DataFrame:
    return df.select("book_id", r("out", 1).alias("out"), r("used", 1).alias("used"))


@query("walk_asks", _walk_sql("ask", "amount*price", "take/price", 250000.0, 0.001), "levels")
def walk_asks(spark, sf):
    return _walked(books.walk_asks(V.levels(spark, sf), 250000.0))


@query("walk_bids", _walk_sql("bid", "amount", "take*price", 300.0, 0.001), "levels")
def walk_bids(spark, sf):
    return _walked(books.walk_bids(V.levels(spark, sf), 300.0))


@query("book_inverse", _walk_sql("bid", "amount*price", "take/price", 99900.0 / 0.999, 0.0), "levels")
def book_inverse(spark, sf):
    return _walked(books.book_inverse(V.levels(spark, sf), 99900.0))


@query("best_bid_ask", "SELECT book_id, round(CASE WHEN count(*) FILTER (WHERE side='ask')>0 THEN max(price) FILTER (WHERE side='bid') END,6) AS bid, round(CASE WHEN count(*) FILTER (WHERE side='bid')>0 THEN min(price) FILTER (WHERE side='ask') END,6) AS ask FROM levels GROUP BY 1", "levels")
def best_bid_ask(spark, sf):
    return books.best_quotes(V.levels(spark, sf)).select("book_id", r("bid").alias("bid"), r("ask").alias("ask"))


# --- pools and routes ----------------------------------------------------------------------------


@query("amm_swap_0_for_1", "SELECT p_partkey, round((1e6::DOUBLE*sqrt(p_retailprice)*(p_size*0.9995::DOUBLE*sqrt(p_retailprice)))/(1e6::DOUBLE+p_size*0.9995::DOUBLE*sqrt(p_retailprice)),5) AS out FROM part")
def amm_swap_0_for_1(spark, sf):
    root, x = F.sqrt("p_retailprice"), F.col("p_size").cast("double")
    return V.read(spark, sf, "part").select("p_partkey", r(K.swap_0_for_1(x, F.lit(1e6), root, 0.0005), 5).alias("out"))


@query("amm_swap_1_for_0", "SELECT p_partkey, round((p_size*0.9995::DOUBLE)/(sqrt(p_retailprice)*(sqrt(p_retailprice)+p_size*0.9995::DOUBLE/1e6::DOUBLE)),9) AS out FROM part")
def amm_swap_1_for_0(spark, sf):
    root, x = F.sqrt("p_retailprice"), F.col("p_size").cast("double")
    return V.read(spark, sf, "part").select("p_partkey", r(K.swap_1_for_0(x, F.lit(1e6), root, 0.0005), 9).alias("out"))


@query("tick_to_price", "SELECT p_partkey, round(pow(1.0001::DOUBLE,p_size),9) AS price, trunc(ln(p_retailprice)/ln(1.0001::DOUBLE))::INT AS tick FROM part")
def tick_to_price(spark, sf):
    return V.read(spark, sf, "part").select("p_partkey", r(K.tick_price(F.col("p_size")), 9).alias("price"), K.price_tick(F.col("p_retailprice")).alias("tick"))


_CURVE = """, x AS (SELECT range AS size FROM range(1,5001)), p AS (SELECT s_suppkey, sqrt(900+s_suppkey%97) AS q FROM supplier),
  c AS (SELECT s_suppkey, size, (2e4::DOUBLE*q*(size*0.9995::DOUBLE*q))/(2e4::DOUBLE+size*0.9995::DOUBLE*q) - size*q*q*0.99::DOUBLE AS profit FROM p, x) """


def _curve(spark, sf) -> DataFrame:
    """Sizes 1 to 5000, a grid by definition, for a pool of each supplier."""
    pools = V.read(spark, sf, "supplier").select("s_suppkey", F.sqrt(900 + F.col("s_suppkey") % 97).alias("q"))
    grid = pools.select("s_suppkey", "q", F.explode(F.sequence(F.lit(1), F.lit(5000))).alias("size"))
    got = K.swap_0_for_1(F.col("size").cast("double"), F.lit(2e4), F.col("q"), 0.0005)
    return grid.select("s_suppkey", F.col("size").cast("bigint").alias("size"), (got - F.col("size") * F.col("q") * F.col("q") * 0.99).alias("profit"))


@query("profit_curve", "WITH" + _CURVE[1:] + "SELECT s_suppkey, size, round(profit,4) AS profit FROM c")
def profit_curve(spark, sf):
    return _curve(spark, sf).select("s_suppkey", "size", r("profit", 4).alias("profit"))


@query("inventory_projection", "SELECT c_custkey, round((c_acctbal+100)/(c_acctbal+1100)-0.5,6) AS deviation, round((c_acctbal+1100)*pow((c_acctbal+100)/(c_acctbal+1100)-0.5,2),4) AS cost FROM customer WHERE c_acctbal>0")
def inventory_projection(spark, sf):
    deviation = (F.col("c_acctbal") + 100) / (F.col("c_acctbal") + 1100) - 0.5
    return V.read(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", r(deviation).alias("deviation"), r((F.col("c_acctbal") + 1100) * F.pow(deviation, F.lit(2)), 4).alias("cost"))


# --- risk and portfolio --------------------------------------------------------------------------


@query("rolling_24h", "SELECT id, desk, round(sum(size) OVER (PARTITION BY desk ORDER BY ts_ms RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW),4) AS volume FROM trades", "trades")
def rolling_24h(spark, sf):
    summed = relations.rolling_sum(V.trades(spark, sf), "desk", "ts_ms", "size", K.DAY, "volume")
    return summed.select("id", "desk", r("volume", 4).alias("volume"))


@query("daily_pnl", "SELECT desk, ts_ms//86400000 AS day, round(coalesce(sum(profit) FILTER (WHERE profit>=0),0),4) AS profit, round(coalesce(sum(-profit) FILTER (WHERE profit<0),0),4) AS loss FROM trades GROUP BY 1,2", "trades")
def daily_pnl(spark, sf):
    return trades.daily_pnl(V.trades(spark, sf)).select("desk", "day", r("profit", 4).alias("profit"), r("loss", 4).alias("loss"))


_STREAK = """WITH RECURSIVE trades AS (""" + V.SQL["trades"] + """), t AS (SELECT *, ts_ms//86400000 AS day FROM trades), i AS (SELECT *, count(*) FILTER (WHERE NOT failed AND profit>=0) OVER (PARTITION BY desk, day ORDER BY ts_ms, id) AS isl FROM t),
  s AS (SELECT *, count(*) FILTER (WHERE failed) OVER (PARTITION BY desk, day, isl ORDER BY ts_ms, id) AS own, coalesce(sum(CASE WHEN NOT failed AND profit<0 THEN -profit END) OVER (PARTITION BY desk, day ORDER BY ts_ms, id ROWS UNBOUNDED PRECEDING),0) AS loss FROM i),
  g AS (SELECT desk, day, row_number() OVER (PARTITION BY desk ORDER BY day) AS k, coalesce(max(own) FILTER (WHERE isl=0),0) AS before, max(isl)>0 AS ended, coalesce(max(own) FILTER (WHERE isl>0),0) AS most, max_by(own, struct_pack(a:=ts_ms,b:=id)) AS last, max(loss) AS loss FROM s GROUP BY 1,2),
  f AS (SELECT desk, k, day, 0::BIGINT AS carried, (CASE WHEN before>=2 OR most>=2 OR loss>=60 THEN 0 ELSE last END)::BIGINT AS onward FROM g WHERE k=1
   UNION ALL SELECT g.desk, g.k, g.day, f.onward, (CASE WHEN (f.onward+g.before>=2 AND g.before>0) OR g.most>=2 OR g.loss>=60 THEN 0 WHEN g.ended THEN g.last ELSE f.onward+g.last END)::BIGINT FROM f JOIN g ON g.desk=f.desk AND g.k=f.k+1),
  x AS (SELECT s.*, own + CASE WHEN isl=0 THEN carried ELSE 0 END AS streak FROM s JOIN f USING (desk, day)) """


@query("failure_streak", _STREAK + "SELECT id, desk, streak::BIGINT AS streak FROM x")
def failure_streak(spark, sf):
    return trades.breaker(V.trades(spark, sf), 2, 60.0).select("id", "desk", "streak")


@query("breaker_state", _STREAK + "SELECT id, bool_or((failed AND streak>=2) OR loss>=60) OVER (PARTITION BY desk, day ORDER BY ts_ms, id ROWS UNBOUNDED PRECEDING) AS active FROM x")
def breaker_state(spark, sf):
    return trades.breaker(V.trades(spark, sf), 2, 60.0).select("id", "active")


@query("imbalance_usd", "SELECT c_nationkey, round(sum((c_acctbal-5000)*0.0006),6) AS imbalance FROM customer GROUP BY 1")
def imbalance_usd(spark, sf):
    return V.read(spark, sf, "customer").groupBy("c_nationkey").agg(r(F.sum((F.col("c_acctbal") - 5000) * 0.0006)).alias("imbalance"))


@query("portfolio_totals", "SELECT c_nationkey, round(CASE WHEN count(CASE WHEN c_acctbal>=0 THEN 1 END)=count(*) THEN sum(c_acctbal) END,4) AS total, count(*)::BIGINT AS sources FROM customer GROUP BY 1")
def portfolio_totals(spark, sf):
    known = V.read(spark, sf, "customer").withColumn("balance", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return trades.null_safe_totals(known, ["c_nationkey"], "balance").select("c_nationkey", r("total", 4).alias("total"), "sources")


_VENUES = """WITH v AS (SELECT c_nationkey, c_custkey%3 AS venue, sum(CASE WHEN c_acctbal>9500 THEN c_acctbal ELSE 0 END) AS base, sum(CASE WHEN c_acctbal>9000 THEN 100.0::DOUBLE ELSE 0 END) AS usd, min(c_acctbal)>0 AS priced FROM customer GROUP BY 1,2),
  w AS (SELECT *, usd+base*(CASE WHEN priced THEN 0.5::DOUBLE ELSE 0.00066::DOUBLE END) AS value FROM v) """


@query("allocation_share", _VENUES + "SELECT c_nationkey, venue, round(value,4)::DOUBLE AS value, round(CASE WHEN sum(value) OVER (PARTITION BY c_nationkey)=0 THEN CASE WHEN venue=2 THEN 33.4 ELSE 33.3 END ELSE value/nullif(sum(value) OVER (PARTITION BY c_nationkey),0)*100 END,6)::DOUBLE AS share FROM w")
def allocation_share(spark, sf):
    """Share of three venues in an account's value: the exact valuation where base tokens are priced, else an estimate
    at the spot default; thirds where there is no value at all."""
    held = V.read(spark, sf, "customer").groupBy("c_nationkey", (F.col("c_custkey") % 3).alias("venue")).agg(
        F.sum(F.when(F.col("c_acctbal") > 9500, F.col("c_acctbal")).otherwise(0.0)).alias("base"), F.sum(F.when(F.col("c_acctbal") > 9000, 100.0).otherwise(0.0)).alias("usd"), (F.min("c_acctbal") > 0).alias("priced")
    )
    made = trades.allocation_shares(held.withColumn("exact", F.when(F.col("priced"), F.col("usd") + F.col("base") * 0.5)), "c_nationkey", "venue")
    return made.select("c_nationkey", "venue", r("value", 4).alias("value"), r("share").alias("share"))


@query("join_full_outer_status", "SELECT coalesce(u.user_id, c.c_custkey) AS venue, u.user_id IS NOT NULL AS priced, c.c_custkey IS NOT NULL AS configured FROM (SELECT DISTINCT user_id FROM events) u FULL OUTER JOIN (SELECT c_custkey FROM customer WHERE c_acctbal>=0) c ON u.user_id=c.c_custkey")
def join_full_outer_status(spark, sf):
    users = V.read(spark, sf, "events").select("user_id").distinct()
    configured = V.read(spark, sf, "customer").filter("c_acctbal >= 0").select("c_custkey")
    out = users.join(configured, F.col("user_id") == F.col("c_custkey"), "full_outer")
    return out.select(F.coalesce("user_id", "c_custkey").alias("venue"), F.col("user_id").isNotNull().alias("priced"), F.col("c_custkey").isNotNull().alias("configured"))


@query("antijoin_missing_accounts", "SELECT c_custkey AS role, 'not read' AS error FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P')")
def antijoin_missing_accounts(spark, sf):
    return V.read(spark, sf, "customer").join(V.read(spark, sf, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("role"), F.lit("not read").alias("error"))


@query("join_in_keys", "SELECT attempt_id, count(*)::BIGINT AS n FROM lifecycle WHERE attempt_id IN (SELECT id FROM attempts WHERE status='half_open') GROUP BY 1", "lifecycle", "attempts")
def join_in_keys(spark, sf):
    keys = V.attempts(spark, sf).filter("status = 'half_open'").select(F.col("id").alias("attempt_id"))
    return V.lifecycle(spark, sf).join(keys, "attempt_id", "left_semi").groupBy("attempt_id").agg(F.count("*").alias("n"))


@query("reconcile_orders", """SELECT o.id, CASE WHEN l.n IS NULL THEN 'missing' WHEN o.status='completed' THEN 'drop' ELSE 'update' END AS action FROM attempts o LEFT JOIN (SELECT attempt_id, count(*) AS n FROM lifecycle GROUP BY 1) l ON l.attempt_id=o.id""", "attempts", "lifecycle")
def reconcile_orders(spark, sf):
    remote = V.lifecycle(spark, sf).groupBy(F.col("attempt_id").alias("id")).agg(F.count("*").alias("n"))
    action = F.when(F.col("n").isNull(), "missing").when(F.col("status") == "completed", "drop").otherwise("update")
    return V.attempts(spark, sf).join(remote, "id", "left").select("id", action.alias("action"))


@query("pnl_realised", "SELECT attempt_id, round(sum(CASE WHEN event_type='executed' THEN expected ELSE -expected END),4) AS pnl FROM lifecycle WHERE event_type<>'routed' GROUP BY 1", "lifecycle")
def pnl_realised(spark, sf):
    signed = F.when(F.col("event_type") == "executed", F.col("expected")).otherwise(-F.col("expected"))
    return V.lifecycle(spark, sf).filter("event_type <> 'routed'").groupBy("attempt_id").agg(r(F.sum(signed), 4).alias("pnl"))


@query("pool_volume_24h", "SELECT pool, round(sum(usd),4) AS usd, count(*)::BIGINT AS n FROM (SELECT * FROM swaps WHERE uid IS NULL UNION ALL SELECT * FROM (SELECT * FROM swaps WHERE uid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pool, uid ORDER BY ts_ms, id)=1)) WHERE ts_ms>(SELECT max(ts_ms) FROM swaps)-86400000 GROUP BY 1", "swaps")
def pool_volume_24h(spark, sf):
    log = V.swaps(spark, sf)
    keyed = log.filter("uid is not null").withColumn("_at", F.struct("ts_ms", "id"))
    once = relations.first_per_key(keyed, ["pool", "uid"], "_at").drop("_at")
    newest = F.broadcast(log.agg(F.max("ts_ms").alias("newest")))  # one row
    fresh = log.filter("uid is null").unionByName(once).join(newest).filter(F.col("ts_ms") > F.col("newest") - K.DAY)
    return fresh.groupBy("pool").agg(r(F.sum("usd"), 4).alias("usd"), F.count("*").alias("n"))


# --- text ----------------------------------------------------------------------------------------


@query("market_match", """, m AS (SELECT id, CASE WHEN venue%6<>0 THEN json_extract_string(payload,'$.market') END AS market, CASE WHEN venue%2=0 THEN 'usdt/coin' ELSE 'coin-usdt' END AS wanted FROM order_payloads)
  SELECT id, market IS NULL OR regexp_replace(lower(market),'[^a-z0-9]','','g')=regexp_replace(wanted,'[^a-z0-9]','','g') AS ours FROM m""", "order_payloads")
def market_match(spark, sf):
    """Whether an order belongs to the wanted market."""
    market = F.when(F.col("venue") % 6 != 0, F.get_json_object("payload", "$.market"))
    wanted = F.when(F.col("venue") % 2 == 0, "usdt/coin").otherwise("coin-usdt")
    return V.RELATIONS["order_payloads"](spark, sf).select("id", K.market_matches(market, wanted).alias("ours"))


@query("normalize_address", "SELECT s_suppkey, lpad(lower(s_suppkey::VARCHAR),40,'0') AS address FROM supplier")
def normalize_address(spark, sf):
    return V.read(spark, sf, "supplier").select("s_suppkey", K.address(F.concat(F.lit("0x"), F.col("s_suppkey").cast("string"))).alias("address"))


@query("refill_reasons", "SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal>=0 AND c_acctbal<1000 THEN 'stable low' END, CASE WHEN c_acctbal>=0 AND c_acctbal<100 THEN 'gas low' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM customer")
def refill_reasons(spark, sf):
    known = F.col("c_acctbal") >= 0
    parts = F.array(F.when(known & (F.col("c_acctbal") < 1000), "stable low"), F.when(known & (F.col("c_acctbal") < 100), "gas low"))
    return V.read(spark, sf, "customer").select("c_custkey", F.array_join(F.filter(parts, lambda x: x.isNotNull()), "; ").alias("reasons"))


@query("swap_event_id", """SELECT event_id, h||':'||('0x'||x)::INT AS uid FROM (SELECT event_id, CASE WHEN user_id%7<>0 THEN '0x'||md5(event_id::VARCHAR) END AS h, CASE WHEN user_id%11<>0 THEN lower(hex(CAST(json_extract_string(props,'$.k') AS INT)+9)) END AS x FROM events)""")
def swap_event_id(spark, sf):
    """Transaction hash (prefixed or not, in either case) and hexadecimal log index of a log."""
    digest, index = F.md5(F.col("event_id").cast("string")), F.hex(V.prop() + 9)
    tx = F.when(F.col("user_id") % 7 != 0, F.when(F.col("user_id") % 2 == 0, F.upper(digest)).otherwise(F.concat(F.lit("0x"), digest)))
    logged = F.when(F.col("user_id") % 11 != 0, F.when(F.col("user_id") % 3 == 0, index).otherwise(F.concat(F.lit("0x"), F.lower(index))))
    return V.read(spark, sf, "events").select("event_id", K.event_id(tx, logged).alias("uid"))


@query("short_address", "SELECT event_id, CASE WHEN length(a)>10 THEN a[1:6]||'...'||right(a,6) WHEN a<>'' THEN a END AS logged, CASE WHEN length(a)>14 THEN a[1:8]||'...'||right(a,6) ELSE a END AS shown FROM (SELECT event_id, md5(event_id::VARCHAR)[1:user_id%20] AS a FROM events)")
def short_address(spark, sf):
    """Addresses of all lengths, as logs and as pages shorten them."""
    a = F.left(F.md5(F.col("event_id").cast("string")), (F.col("user_id") % 20).cast("int"))
    return V.read(spark, sf, "events").select("event_id", K.short_address(a).alias("logged"), K.shown_address(a).alias("shown"))


@query("relative_time", f"SELECT id, CASE WHEN s<60 THEN s||'s' WHEN s<3600 THEN (s//60)||'m' WHEN s<86400 THEN (s//3600)||'h' ELSE (s//86400)||'d' END||' ago' AS age FROM (SELECT id, ({AS_OF}-ts_ms)//1000 AS s FROM quotes)", "quotes")
def relative_time(spark, sf):
    return V.quotes(spark, sf).select("id", K.age_text(F.lit(AS_OF) - F.col("ts_ms")).alias("age"))


@query("utc_day", "SELECT ts_ms//86400000 AS day, count(*)::BIGINT AS n FROM quotes GROUP BY 1", "quotes")
def utc_day(spark, sf):
    return V.quotes(spark, sf).groupBy(F.floor(F.col("ts_ms") / K.DAY).alias("day")).agg(F.count("*").alias("n"))


# --- filters and predicates over routes and positions ---------------------------------------------


@query("freshness_filter", f"SELECT id FROM quotes WHERE {AS_OF}-ts_ms BETWEEN 0 AND 172800000", "quotes")
def freshness_filter(spark, sf):
    return V.quotes(spark, sf).filter((F.lit(AS_OF) - F.col("ts_ms")).between(0, 2 * K.DAY)).select("id")


@query("exclude_set", "SELECT id, source FROM quotes WHERE source NOT IN ('error','view')", "quotes")
def exclude_set(spark, sf):
    return V.quotes(spark, sf).filter(~F.col("source").isin("error", "view")).select("id", "source")


@query("source_to_venue", "SELECT id, CASE WHEN contains(lower(source),'sign') THEN 'ramp' WHEN contains(lower(source),'click') THEN 'pool' ELSE source END AS venue FROM quotes", "quotes")
def source_to_venue(spark, sf):
    low = F.lower("source")
    return V.quotes(spark, sf).select("id", F.when(low.contains("sign"), "ramp").when(low.contains("click"), "pool").otherwise(F.col("source")).alias("venue"))


@query("reputation_filter", """, i AS (SELECT id, unnest(json_extract(payload,'$.result.items[*]')) AS x FROM ad_payloads) SELECT id, CAST(json_extract_string(x,'$.price') AS DOUBLE) AS price FROM i
  WHERE CAST(json_extract_string(x,'$.recentOrderNum') AS INT)>=100 AND CAST(json_extract_string(x,'$.recentExecuteRate') AS DOUBLE)>=90 AND CAST(json_extract_string(x,'$.releaseTime') AS INT)<=900 AND json_extract_string(x,'$.isOnline')='true'""", "ad_payloads")
def reputation_filter(spark, sf):
    """Advertisements whose makers have orders, completion and speed enough, and are online."""
    return orders.reputable(orders.p2p_ads(V.RELATIONS["ad_payloads"](spark, sf))).select("id", "price")


@query("wallet_log_match", """SELECT e.event_id, c.c_custkey FROM events e JOIN customer c ON e.user_id=c.c_custkey WHERE e.event_type='click'
  UNION SELECT e.event_id, c.c_custkey FROM events e JOIN customer c ON CAST(json_extract_string(e.props,'$.k') AS INT)=c.c_custkey WHERE e.event_type='click'""")
def wallet_log_match(spark, sf):
    """The or-condition as two equi-joins and a distinct: a nested loop would compare all pairs."""
    logs = V.read(spark, sf, "events").filter("event_type = 'click'").select("event_id", "user_id", V.prop().cast("bigint").alias("to"))
    wallets = V.read(spark, sf, "customer").select("c_custkey")
    sent, got = (logs.join(wallets, F.col(c) == F.col("c_custkey")).select("event_id", "c_custkey") for c in ("user_id", "to"))
    return sent.unionByName(got).distinct()


@query("custom_order", "SELECT n_nationkey, row_number() OVER (ORDER BY CASE n_regionkey WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END, n_name)::INT AS place FROM nation")
def custom_order(spark, sf):
    order = Window.partitionBy().orderBy(F.when(F.col("n_regionkey") == 2, 0).when(F.col("n_regionkey") == 0, 1).otherwise(2), "n_name")
    return V.read(spark, sf, "nation").select("n_nationkey", F.row_number().over(order).alias("place"))


@query("set_dedupe", "SELECT pool, count(DISTINCT uid)::BIGINT AS ids FROM swaps GROUP BY 1", "swaps")
def set_dedupe(spark, sf):
    return V.swaps(spark, sf).groupBy("pool").agg(F.countDistinct("uid").alias("ids"))


@query("incident_key", "SELECT venue, string_agg(id::VARCHAR, ',' ORDER BY id) AS key, count(*)::BIGINT AS n FROM positions WHERE value>400000 GROUP BY 1 HAVING count(*)>1", "positions")
def incident_key(spark, sf):
    big = V.positions(spark, sf).filter("value > 400000").groupBy("venue").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("key"), F.count("*").alias("n"))
    return big.filter("n > 1")


@query("rate_band", "SELECT p_partkey, round(CASE WHEN p_retailprice/1000<1.003 OR p_retailprice/1000>1.005 THEN 1.003 END,6)::DOUBLE AS target FROM part")
def rate_band(spark, sf):
    return V.read(spark, sf, "part").select("p_partkey", r(K.rate_band(F.col("p_retailprice") / 1000, F.lit(1.0))).alias("target"))


@query("gas_cost_usd", "SELECT p_partkey, round(CASE WHEN p_size*10000<=300000 THEN p_size*200000/1e9::DOUBLE*p_retailprice END,6) AS gas FROM part")
def gas_cost_usd(spark, sf):
    return V.read(spark, sf, "part").select("p_partkey", r(K.gas_cost(F.col("p_size"), F.col("p_retailprice"), F.col("p_size") * 10000)).alias("gas"))


@query("range_distance_pct", "SELECT p_partkey, round(CASE WHEN p_retailprice<1000 THEN (1000-p_retailprice)/1000*100 WHEN p_retailprice>1500 THEN (p_retailprice-1500)/1500*100 ELSE 0 END,6)::DOUBLE AS distance FROM part")
def range_distance_pct(spark, sf):
    return V.read(spark, sf, "part").select("p_partkey", r(K.range_distance(F.col("p_retailprice"), F.lit(1000.0), F.lit(1500.0))).alias("distance"))


@query("lp_token_amounts", """SELECT p_partkey, round(1e4*(1/least(greatest(sqrt(p_retailprice),31::DOUBLE),36::DOUBLE)-1/36::DOUBLE),6) AS amount0,
  round(1e4*(least(greatest(sqrt(p_retailprice),31::DOUBLE),36::DOUBLE)-31),6) AS amount1 FROM part""")
def lp_token_amounts(spark, sf):
    a0, a1 = K.position_amounts(F.lit(1e4), F.sqrt("p_retailprice"), F.lit(31.0), F.lit(36.0))
    return V.read(spark, sf, "part").select("p_partkey", r(a0).alias("amount0"), r(a1).alias("amount1"))


@query("can_trade", "SELECT c_custkey, CASE WHEN c_custkey%7=0 THEN 'breaker' WHEN c_acctbal*2+c_nationkey*10>10000 THEN 'volume' WHEN c_acctbal<-500 THEN 'daily_loss' WHEN c_acctbal<10 THEN 'low_inventory' END AS reason FROM customer")
def can_trade(spark, sf):
    reason = trades.can_trade(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") * 2, F.col("c_nationkey") * 10, -F.col("c_acctbal") - 0.000001, F.col("c_acctbal"), 10000, 500, 10)
    return V.read(spark, sf, "customer").select("c_custkey", reason.alias("reason"))


@query("source_valuation", "SELECT n_regionkey, round(sum(c_acctbal)*0.5,4) AS value, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1")
def source_valuation(spark, sf):
    joined = V.read(spark, sf, "customer").join(V.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_regionkey").agg(r(F.sum("c_acctbal") * 0.5, 4).alias("value"), F.count("*").alias("n"))


@query("consecutive_failures", _STREAK + "SELECT desk, max(streak)::BIGINT AS longest FROM x GROUP BY 1")
def consecutive_failures(spark, sf):
    return trades.breaker(V.trades(spark, sf), 2, 60.0).groupBy("desk").agg(F.max("streak").alias("longest"))


@query("union_live_tracked", "SELECT id, 'live' AS origin FROM attempts WHERE status='detected' UNION ALL SELECT DISTINCT attempt_id, 'tracked' FROM lifecycle WHERE attempt_id NOT IN (SELECT id FROM attempts WHERE status='detected')", "attempts", "lifecycle")
def union_live_tracked(spark, sf):
    live = V.attempts(spark, sf).filter("status = 'detected'").select("id", F.lit("live").alias("origin"))
    tracked = V.lifecycle(spark, sf).select(F.col("attempt_id").alias("id")).distinct().join(live, "id", "left_anti")
    return live.unionByName(tracked.withColumn("origin", F.lit("tracked")))
