"""Registered queries that run streams: tables are replayed in several arrivals, results are compared as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import views as V
from ..sources.scratch import shared_folder
from ..streaming import incidents, logs, streams, volume
from .market import query

SWAPS = "pool bigint, id bigint, ts_ms bigint, usd double, uid string, block bigint, at timestamp"
HOUR = 3_600_000


def _swaps(spark, sf) -> DataFrame:
    """Clicks as swaps: a pool for each 16th part of the users; ids come again, some are missing."""
    k = V.prop()
    uid = F.when(k % 10 != 0, F.concat((F.col("user_id") % 64).cast("string"), F.lit(":"), (k % 4).cast("string")))
    ts = V.millis("ts")
    return V.read(spark, sf, "events").filter("event_type = 'click'").select(
        (F.col("user_id") % 16).alias("pool"), F.col("event_id").alias("id"), ts.alias("ts_ms"), F.col("value").alias("usd"), uid.alias("uid"), F.floor(ts / 2000).alias("block"), F.timestamp_millis(ts).alias("at")
    )


_S = """WITH k AS (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS p FROM events WHERE event_type='click'),
  sw AS (SELECT user_id%16 AS pool, event_id AS id, epoch_us(ts)//1000 AS ts_ms, round(value*1000000)::BIGINT AS micros, CASE WHEN p%10<>0 THEN (user_id%64)||':'||(p%4) END AS uid, epoch_us(ts)//1000//2000 AS block FROM k WHERE round(value*1000000)>0) """
#: Greedy: of one id, the first swap counts, then the first one more than 24 hours after the last that counted.
_KEPT = """, ch AS (SELECT pool, uid, list_reduce(list(struct_pack(a:=ts_ms, b:=id) ORDER BY ts_ms, id), lambda s, x: CASE WHEN x.a - s[-1].a > 86400000 THEN list_append(s, x) ELSE s END, [struct_pack(a:=-1000000000000::BIGINT, b:=-1::BIGINT)]) AS xs FROM sw WHERE uid IS NOT NULL GROUP BY ALL),
  ok AS (SELECT pool, x.b AS id FROM (SELECT pool, unnest(xs) AS x FROM ch)), kept AS (SELECT sw.* FROM sw WHERE uid IS NULL OR EXISTS (SELECT 1 FROM ok WHERE ok.pool=sw.pool AND ok.id=sw.id)),
  roll AS (SELECT *, sum(micros) OVER w AS volume, count(*) OVER w AS swaps FROM kept WINDOW w AS (PARTITION BY pool ORDER BY ts_ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW)) """
_LAST = ", fin AS (SELECT pool, max(ts_ms) AS newest FROM kept GROUP BY 1) "


def _heartbeat(rows: DataFrame) -> DataFrame:
    """One row far behind the last swap, without an amount: all swaps before it are settled."""
    at = F.max("ts_ms") + volume.DAY
    return rows.agg(at.alias("t")).select(F.lit(-1).cast("bigint").alias("pool"), F.lit(-1).cast("bigint").alias("id"), F.col("t").alias("ts_ms"), F.lit(None).cast("double").alias("usd"), F.lit(None).cast("string").alias("uid"), F.lit(None).cast("bigint").alias("block"), F.timestamp_millis("t").alias("at"))


def _arrival(rows: DataFrame) -> DataFrame:
    """``arrives``: event time and up to two hours of delay by id."""
    return rows.withColumn("arrives", F.col("ts_ms") + F.pmod(F.xxhash64("id"), F.lit(2 * HOUR)))


def _middle(rows: DataFrame) -> int:
    low, high = rows.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    return (low + high) // 2 if low is not None else 0


def _send(rows: DataFrame, folder: str) -> None:
    rows.select("pool", "id", "ts_ms", "usd", "uid", "block", "at").write.mode("append").parquet(folder)


@query("rolling_24h_stream", _S + _KEPT + "SELECT DISTINCT pool, ts_ms, volume::BIGINT AS volume, swaps::BIGINT AS swaps FROM roll")
def rolling_24h_stream(spark, sf):
    """Two arrivals with rows up to two hours out of order; the stream stops and goes on between them."""
    work, rows = shared_folder(spark, "rolling"), _arrival(_swaps(spark, sf))
    half = _middle(rows)
    for part in (rows.filter(F.col("arrives") < half), rows.filter(F.col("arrives") >= half).unionByName(_arrival(_heartbeat(rows)))):
        _send(part, f"{work}/in")
        volume.run(spark, f"{work}/in", SWAPS, f"{work}/out", f"{work}/checkpoint")
    return spark.read.schema(volume.RollingVolume.OUTPUT).parquet(f"{work}/out")


_TOTAL = """, nw AS (SELECT pool, max(ts_ms) AS newest FROM sw GROUP BY 1), tot AS (SELECT nw.pool, coalesce(sum(micros) FILTER (WHERE ts_ms>=newest-86400000),0)::BIGINT AS volume, count(micros) FILTER (WHERE ts_ms>=newest-86400000)::BIGINT AS swaps FROM nw LEFT JOIN kept ON kept.pool=nw.pool GROUP BY 1) """
_HALF = ", md AS (SELECT (min(ts_ms)+max(ts_ms))//2 AS half, max(ts_ms)-43200000 AS noon FROM sw0)"
_SEEDED = _S.replace("sw AS (", "sw0 AS (", 1) + _HALF + """, cu AS (SELECT pool, max(block) AS cursor, max(ts_ms) AS seen FROM sw0, md WHERE ts_ms<half GROUP BY 1), sw AS (SELECT sw0.* FROM sw0 LEFT JOIN cu ON cu.pool=sw0.pool WHERE cursor IS NULL OR block>cursor OR ts_ms>=seen-86400000)""" + _KEPT + _TOTAL


def _settled(spark, rows: DataFrame, work: str, name: str, start: DataFrame | None) -> str:
    """A query over ``rows`` and a heartbeat behind them, run to its end; its checkpoint."""
    _send(rows.unionByName(_heartbeat(rows)), f"{work}/{name}-in")
    volume.run(spark, f"{work}/{name}-in", SWAPS, f"{work}/{name}-out", f"{work}/{name}", start)
    return f"{work}/{name}"


@query("seed_gate", _SEEDED + "SELECT pool, CASE WHEN pool%5<>4 THEN volume::DOUBLE END AS volume, CASE WHEN pool%5<>4 THEN swaps::DOUBLE END AS swaps FROM tot")
def seed_gate(spark, sf):
    """A batch backfill to each pool's cursor and a stream from there on; pools whose backfill fails (every fifth)
    stay hidden although their swaps stream in."""
    work, rows = shared_folder(spark, "seeds"), _swaps(spark, sf).filter(volume.micros(F.col("usd")) > 0)
    half = _middle(rows)
    cursors = rows.filter(F.col("ts_ms") < half).groupBy("pool").agg(F.max("block").alias("cursor"))
    first = rows.select("pool").distinct().join(cursors, "pool", "left")  # a pool without swaps so far is seeded empty
    start = volume.backfilled(rows, first.filter("pool % 5 <> 4"))
    live = rows.join(cursors, "pool", "left").filter("cursor IS NULL OR block > cursor OR (block = cursor AND uid IS NOT NULL)").drop("cursor")
    checkpoint = _settled(spark, live, work, "live", start)
    return volume.volumes(spark, checkpoint).filter("pool >= 0").select("pool", F.col("volume").cast("double"), F.col("swaps").cast("double"))


def _before(spark, sf, work: str) -> tuple[DataFrame, DataFrame]:
    """All swaps, and the state saved as JSON by a query that was ended twelve hours before the last one."""
    rows = _swaps(spark, sf).filter(volume.micros(F.col("usd")) > 0)
    noon = rows.agg(F.max("ts_ms")).first()[0]
    seen = rows.filter(F.col("ts_ms") < (noon or 0) - 12 * HOUR)
    checkpoint = _settled(spark, seen, work, "first", None)
    volume.saved(spark, checkpoint).filter("pool >= 0").write.json(f"{work}/saved")
    return rows, spark.read.schema(volume.SAVED).json(f"{work}/saved")


_NOON = _S.replace("sw AS (", "sw0 AS (", 1) + _HALF + ", sw AS (SELECT * FROM sw0 WHERE ts_ms<(SELECT noon FROM md))" + _KEPT


@query("sink_json_state", _NOON + """, nw AS (SELECT pool, max(ts_ms) AS newest FROM sw GROUP BY 1), cu AS (SELECT pool, max(block) AS cursor FROM kept GROUP BY 1)
  SELECT pool, cursor::BIGINT AS cursor, ts_ms, id, micros, uid FROM nw JOIN cu USING (pool) LEFT JOIN kept USING (pool) WHERE ts_ms>=newest-86400000""")
def sink_json_state(spark, sf):
    """What a query holds, saved as JSON and read again: entries of the last 24 hours and the cursor, by pool."""
    return _before(spark, sf, shared_folder(spark, "state"))[1].select("pool", "cursor", "ts_ms", "id", "micros", "uid")


@query("cursor_resume", _S + _KEPT + _TOTAL + "SELECT pool, volume, swaps FROM tot")
def cursor_resume(spark, sf):
    """A new query goes on from saved state, at each pool's last swap seen: totals are those of all swaps. Pools
    without saved state start empty."""
    work = shared_folder(spark, "resume")
    rows, state = _before(spark, sf, work)
    gap = volume.after(rows, state.select("pool", "cursor", "seen").distinct())
    fresh = rows.select("pool").distinct().join(state, "pool", "left_anti").withColumn("cursor", F.lit(None).cast("bigint"))
    start = volume.restored(state).unionByName(volume.backfilled(rows, fresh))
    return volume.volumes(spark, _settled(spark, gap, work, "second", start)).filter("pool >= 0").select("pool", "volume", "swaps")


@query("alert_dedupe_stream", """, a AS (SELECT id, ts_ms, coalesce(dedupe_key, 'row '||id) AS key, severity FROM (SELECT id, ts_ms, CASE WHEN id%10<>0 THEN dedupe_key END AS dedupe_key, severity FROM alerts)),
  b AS (SELECT *, CASE WHEN ts_ms-lag(ts_ms) OVER w<14400000 THEN 0 ELSE 1 END AS opens FROM a WINDOW w AS (PARTITION BY key ORDER BY ts_ms, id)), c AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY ts_ms, id) AS n FROM b)
  SELECT key, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen, count(*)::BIGINT AS occurrences, max_by(severity, struct_pack(a:=ts_ms,b:=id)) AS severity, max(ts_ms)+14400000 AS closed FROM c GROUP BY key, n""", "alerts")
def alert_dedupe_stream(spark, sf):
    """Incidents: alerts of one key at most four hours apart; each comes out once, when its cool-down is over."""
    work = shared_folder(spark, "alerts")
    rows = V.alerts(spark, sf).withColumn("dedupe_key", F.when(F.col("id") % 10 != 0, F.col("dedupe_key"))).withColumn("at", F.timestamp_millis("ts_ms"))
    beat = rows.agg(F.timestamp_millis(F.max("ts_ms") + 2 * volume.DAY).alias("at"))
    rows.unionByName(beat, allowMissingColumns=True).write.parquet(f"{work}/in")
    incidents.run(spark, f"{work}/in", rows.schema, f"{work}/out", f"{work}/checkpoint", "4 hours")
    return spark.read.parquet(f"{work}/out")


@query("src_chain_logs_stream", "SELECT id, pool, block, length(data)::INT AS chars FROM pool_logs", "pool_logs")
def src_chain_logs_stream(spark, sf):
    """All logs by ranges of blocks; the query stops half way and goes on from its checkpoint."""
    work, rows = shared_folder(spark, "logs"), V.RELATIONS["pool_logs"](spark, sf)
    rows = rows.select("id", "pool", "block", "data")
    half = rows.agg(((F.min("block") + F.max("block")) / 2).cast("bigint")).first()[0] or 0
    for part in (F.col("block") <= half, F.col("block") > half):
        rows.filter(part).repartitionByRange("block").sortWithinPartitions("block").write.mode("append").parquet(f"{work}/in")
        stream = logs.chain_logs(spark, f"{work}/in".removeprefix("file:"), "id bigint, pool bigint, block bigint, data string", blocks_per_batch=max(half // 2, 1), blocks_per_read=max(half // 8, 1))
        logs.drain(stream.select("id", "pool", "block", F.length("data").alias("chars")), f"{work}/out", f"{work}/checkpoint")
    return spark.read.schema("id bigint, pool bigint, block bigint, chars int").parquet(f"{work}/out")


def _in_two(spark, rows: DataFrame, work: str, query_of) -> None:
    """Runs ``query_of`` (a stream to a started query) over two arrivals of ``rows``."""
    half = _middle(rows)
    for part in (F.col("ts_ms") < half, F.col("ts_ms") >= half):
        rows.filter(part).write.mode("append").parquet(f"{work}/in")
        query_of(streams.event_stream(spark, f"{work}/in", rows.schema)).awaitTermination()


@query("pool_state_upsert", _S + "SELECT pool, max_by(id, struct_pack(a:=block, b:=id)) AS id, max(block)::BIGINT AS block FROM sw GROUP BY 1")
def pool_state_upsert(spark, sf):
    """The last log of each pool, kept up by a stream that writes only what a batch changes."""
    work, rows = shared_folder(spark, "pools"), _swaps(spark, sf).filter(volume.micros(F.col("usd")) > 0)
    sink = streams.upsert_into(f"{work}/state", ["pool"], ["block", "id"])
    _in_two(spark, rows, work, lambda s: s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start())
    return streams.upserted(spark, f"{work}/state", ["pool"], ["block", "id"]).select("pool", "id", "block")


@query("dedup_event_id", _S + "SELECT pool, uid, CASE WHEN uid IS NULL THEN count(*) ELSE 1 END::BIGINT AS n FROM sw GROUP BY 1,2")
def dedup_event_id(spark, sf):
    """Each id of a pool once within the span of the watermark; rows without an id are never dropped."""
    work, rows = shared_folder(spark, "once"), _swaps(spark, sf).filter(volume.micros(F.col("usd")) > 0)
    once = lambda s: streams.deduplicated(s.select("pool", "id", "uid", "at"), ["pool", "uid"], "at", "60 days")
    _in_two(spark, rows, work, lambda s: once(s).writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start())
    return spark.read.parquet(f"{work}/out").groupBy("pool", "uid").agg(F.count("*").alias("n"))


@query("retained_last_value", _S + "SELECT pool, max_by(id, struct_pack(a:=ts_ms, b:=id)) AS id, max(ts_ms)::BIGINT AS ts_ms FROM sw GROUP BY 1")
def retained_last_value(spark, sf):
    """The last swap of each pool from the query's own state, written out after every batch that changes it."""
    work, rows = shared_folder(spark, "last"), _swaps(spark, sf).filter(volume.micros(F.col("usd")) > 0)
    sink = streams.upsert_into(f"{work}/state", ["pool"], ["ts_ms", "id"])
    last = lambda s: streams.retained(s, ["pool"], ["ts_ms", "id"])
    _in_two(spark, rows, work, lambda s: last(s).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start())
    return streams.upserted(spark, f"{work}/state", ["pool"], ["ts_ms", "id"]).select("pool", "id", "ts_ms")
