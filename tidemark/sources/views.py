"""Market relations as projections of the tables at hand (see FIXTURES.md, section B)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def prop(column: str = "props") -> Column:
    return F.get_json_object(column, "$.k").cast("int")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = F.when(F.col("event_type") == "signup", 1000 + F.col("value")).otherwise(F.col("value") / 1000)
    out = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), millis("ts").alias("ts_ms"), mid.alias("mid"), prop().alias("volume"))
    return out.withColumns({"bid": F.col("mid") * 0.999, "ask": F.col("mid") * 1.001})


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    status = F.when(done, "completed").when(F.col("o_orderstatus") == "O", "detected").when(F.col("o_custkey") % 3 == 0, "half_open").otherwise("abandoned")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_custkey") % 2 == 0, "book_pool").otherwise("pool_pool").alias("pipeline"),
        F.col("o_orderpriority").alias("direction"),
        millis("o_orderdate").alias("detected_ms"),
        status.alias("status"),
        F.when(done, F.col("o_totalprice") * 0.001 - 100).alias("actual_profit"),
        F.when(done & (F.col("o_custkey") % 5 != 0), F.col("o_totalprice")).alias("executed_size"),
    )


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "N", "routed").when(F.col("l_returnflag") == "A", "executed").otherwise("failed")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("attempt_id"), kind.alias("event_type"), millis("l_shipdate").alias("ts_ms"),
        (F.col("l_linenumber") * 10**12 + F.col("l_partkey") * 10**5 + F.col("l_suppkey")).cast("bigint").alias("event_id"),
        F.col("l_quantity").alias("size"), F.col("l_extendedprice").alias("expected"), F.col("l_discount").alias("reason"),
        (F.col("l_partkey") % 5).alias("buy_venue"), (F.col("l_suppkey") % 7).alias("sell_venue"), F.concat(F.lit("w"), (F.col("l_suppkey") % 31).cast("string")).alias("wallet"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("0x"), F.hex(F.col("l_partkey") * 1000 + F.col("l_linenumber")))).alias("tx_hash"),
        F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("gain"), (F.col("l_quantity") * 1500).alias("moved"),
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("book_id"), F.when(F.col("l_linestatus") == "O", "ask").otherwise("bid").alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("amount"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("level_id"), F.col("l_partkey").alias("part"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("value") > 100, "critical").when(F.col("value") > 20, "warning").otherwise("info")
    return read(spark, sf_dir, "events").filter("event_type = 'error'").select(
        F.col("event_id").alias("id"), millis("ts").alias("ts_ms"), F.concat(F.lit("error:"), (F.col("user_id") % 20).cast("string")).alias("dedupe_key"), severity.alias("severity"),
    )


def swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = F.when(prop() % 10 != 0, F.concat(F.col("user_id").cast("string"), F.lit(":"), prop().cast("string")))
    return read(spark, sf_dir, "events").filter("event_type = 'click'").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 2).alias("pool"), millis("ts").alias("ts_ms"), uid.alias("uid"), F.col("value").alias("usd"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(prop() % 3 != 0, F.concat(F.col("user_id").cast("string"), F.lit(":"), prop().cast("string")))
    return read(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), millis("ts").alias("ts_ms"), key.alias("idempotency_key"), F.col("value").alias("amount"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").filter("event_type = 'purchase'").select(
        F.col("event_id").alias("id"), millis("ts").alias("ts_ms"), (F.col("user_id") % 3).alias("desk"), F.col("value").alias("size"), (F.col("value") - 20).alias("profit"), (F.col("value") < 8).alias("failed"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    value = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return joined.select(F.col("o_orderkey").alias("id"), F.col("n_name").alias("venue"), millis("o_orderdate").alias("ts_ms"), value.alias("value"))


#: The same relations for an independent SQL engine; each entry is the body of a common table expression.
SQL = {
    "quotes": """SELECT event_id AS id, event_type AS source, epoch_us(ts)//1000 AS ts_ms,
      CASE WHEN event_type='signup' THEN 1000+value ELSE value/1000 END AS mid, CAST(json_extract_string(props,'$.k') AS INT) AS volume FROM events""",
    "attempts": """SELECT o_orderkey AS id, CASE WHEN o_custkey%2=0 THEN 'book_pool' ELSE 'pool_pool' END AS pipeline, o_orderpriority AS direction,
      epoch_us(o_orderdate)//1000 AS detected_ms, CASE WHEN o_orderstatus='F' THEN 'completed' WHEN o_orderstatus='O' THEN 'detected' WHEN o_custkey%3=0 THEN 'half_open' ELSE 'abandoned' END AS status,
      CASE WHEN o_orderstatus='F' THEN o_totalprice*0.001::DOUBLE-100 END AS actual_profit, CASE WHEN o_orderstatus='F' AND o_custkey%5<>0 THEN o_totalprice END AS executed_size FROM orders""",
    "lifecycle": """SELECT l_orderkey AS attempt_id, CASE l_returnflag WHEN 'N' THEN 'routed' WHEN 'A' THEN 'executed' ELSE 'failed' END AS event_type, epoch_us(l_shipdate)//1000 AS ts_ms,
      (l_linenumber::BIGINT*1000000000000 + l_partkey*100000 + l_suppkey)::BIGINT AS event_id, l_quantity AS size, l_extendedprice AS expected, l_discount AS reason,
      l_partkey%5 AS buy_venue, l_suppkey%7 AS sell_venue, 'w'||(l_suppkey%31) AS wallet, CASE WHEN l_returnflag<>'N' THEN '0x'||hex(l_partkey*1000+l_linenumber) END AS tx_hash,
      CASE WHEN l_returnflag<>'N' THEN l_extendedprice*(l_discount-0.05::DOUBLE) END AS gain, l_quantity*1500 AS moved FROM lineitem""",
    "levels": """SELECT l_suppkey AS book_id, CASE WHEN l_linestatus='O' THEN 'ask' ELSE 'bid' END AS side, l_extendedprice/l_quantity AS price, l_quantity AS amount,
      l_orderkey*1000+l_linenumber AS level_id, l_partkey AS part FROM lineitem""",
    "alerts": """SELECT event_id AS id, epoch_us(ts)//1000 AS ts_ms, 'error:'||(user_id%20) AS dedupe_key, CASE WHEN value>100 THEN 'critical' WHEN value>20 THEN 'warning' ELSE 'info' END AS severity
      FROM events WHERE event_type='error'""",
    "swaps": """SELECT event_id AS id, user_id%2 AS pool, epoch_us(ts)//1000 AS ts_ms, CASE WHEN CAST(json_extract_string(props,'$.k') AS INT)%10<>0 THEN user_id||':'||CAST(json_extract_string(props,'$.k') AS INT) END AS uid,
      value AS usd FROM events WHERE event_type='click'""",
    "actions": """SELECT event_id AS id, epoch_us(ts)//1000 AS ts_ms, CASE WHEN CAST(json_extract_string(props,'$.k') AS INT)%3<>0 THEN user_id||':'||CAST(json_extract_string(props,'$.k') AS INT) END AS idempotency_key,
      value AS amount FROM events WHERE event_type='purchase'""",
    "trades": "SELECT event_id AS id, epoch_us(ts)//1000 AS ts_ms, user_id%3 AS desk, value AS size, value-20 AS profit, value<8 AS failed FROM events WHERE event_type='purchase'",
    "positions": """SELECT o_orderkey AS id, n_name AS venue, epoch_us(o_orderdate)//1000 AS ts_ms, CASE WHEN o_orderstatus<>'P' THEN o_totalprice END AS value
      FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey""",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` after the named relations; SQL that starts with a comma adds its own before its SELECT."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + sql


def _mutual(text: str, table: str):
    """A relation whose projection reads alike in both dialects: (DataFrame maker, SQL)."""
    return (lambda spark, sf_dir: read(spark, sf_dir, table).selectExpr(*_columns(text))), f"SELECT {text} FROM {table}"


def _columns(text: str) -> list[str]:
    """Columns stand on lines of their own; lines that go on are indented."""
    return re.split(r",\n(?! )", text)


_MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS STRING)"
_VOLUME = "CAST(o_custkey % 50 AS STRING)"

#: Payloads as venues send them, made of the tables' columns.
_PAYLOADS = {
    "order_payloads": (
        "o_orderkey AS id,\no_custkey % 40 AS venue,\n"
        """concat('{"id":"', CAST(o_orderkey AS STRING), '","market":"USDT_', CASE WHEN o_custkey % 2 = 0 THEN 'COIN' ELSE 'Coin' END,
          '","side":"', CASE WHEN o_custkey % 17 = 0 THEN 'hold' WHEN o_orderkey % 2 = 0 THEN 'Buy' ELSE 'sell' END,
          '","', CASE WHEN o_custkey % 2 = 0 THEN 'state' ELSE 'status' END, '":"', CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'Wait' ELSE 'pending_cancel' END,
          '","price":', CASE WHEN o_custkey % 3 = 0 THEN concat('{"amount":"', """ + _MONEY.format("o_totalprice") + """, '"}') WHEN o_custkey % 19 = 0 THEN '0' ELSE concat('"', """ + _MONEY.format("o_totalprice") + """, '"') END,
          CASE WHEN o_custkey % 4 = 0 THEN '' ELSE concat(',"volume":"', """ + _VOLUME + """, '"') END,
          CASE WHEN o_custkey % 5 = 0 THEN '' ELSE concat(',"remaining_volume":"', CAST(o_custkey % 7 AS STRING), '"') END,
          ',"origin_volume":"', CAST(o_custkey % 30 AS STRING), '","executed_volume":{"value":"', CAST(o_custkey % 11 AS STRING), '"}',
          ',"created_at":', CASE WHEN o_orderkey % 3 = 0 THEN CAST(1600000000 + o_orderkey AS STRING) WHEN o_orderkey % 3 = 1 THEN concat('"', CAST(1600000000000 + o_orderkey AS STRING), '"') ELSE 'null' END, '}') AS payload""",
        "orders",
    ),
    "ticker_payloads": (
        "event_id AS id,\nevent_type AS source,\n"
        """concat('{"ticker":{"buy":"', CASE WHEN user_id % 5 = 0 THEN '0' ELSE CAST(CAST(1000 + value AS DECIMAL(18,2)) AS STRING) END, '"',
          CASE WHEN user_id % 7 < 2 THEN '' ELSE concat(',"sell":"', CAST(CAST(1001 + value AS DECIMAL(18,2)) AS STRING), '"') END,
          CASE WHEN user_id % 3 = 0 THEN '' ELSE concat(',"last":"', CAST(CAST(999 + value AS DECIMAL(18,2)) AS STRING), '"') END, '}}') AS payload""",
        "events",
    ),
    "book_payloads": (
        "p_partkey AS id,\n"
        """concat('{"status":"', CASE WHEN p_size % 9 = 0 THEN 'error' ELSE 'success' END, '","data":{"bids":[["', """ + _MONEY.format("p_retailprice") + """, '","', CAST(p_size AS STRING), '"],["0","5"]],"asks":[["',
          CAST(CAST(p_retailprice AS DECIMAL(18,2)) + 3 AS STRING), '","', CAST(p_size + 2 AS STRING), '"],["', CAST(CAST(p_retailprice AS DECIMAL(18,2)) + 4 AS STRING), '","1.5"]]}}') AS payload""",
        "part",
    ),
    "ramp_payloads": (
        "s_suppkey AS id,\n"
        """concat('[{"side":"sell","rate":"', """ + _MONEY.format("s_acctbal") + """, '","balanceUsd":"', CAST(s_nationkey * 20 AS STRING), '"},{"side":"buy","rate":"', """ + _MONEY.format("s_acctbal") + """, '5","balanceUsd":"100"},',
          '{"side":"sell","rate":"many","balanceUsd":"900"},{"side":"buy","balanceUsd":"900"},{"side":"sell","rate":"1500","balanceUsd":"', CASE WHEN s_nationkey % 2 = 0 THEN '250' ELSE '' END, '"}]') AS payload""",
        "supplier",
    ),
    "chain_payloads": (
        "p_partkey AS id,\n"
        """concat('{"bids":[{"desired_amount":"', CAST(p_size + 1 AS STRING), '","filled_amount":"', CAST(p_size % 7 AS STRING), '","spot_contract":{"ui_intent":{"price":"', """ + _MONEY.format("p_retailprice") + """, '","size":"', CAST(p_size * 3 AS STRING), '"}}}],"asks":[{"desired_amount":"4","spot_contract":{"ui_intent":{"price":"',
          CAST(CAST(p_retailprice AS DECIMAL(18,2)) + 2 AS STRING), '","size":"40"}}}]}') AS payload""",
        "part",
    ),
    "ad_payloads": (
        "c_custkey AS id,\n"
        """concat('{"result":{"count":', CAST(c_nationkey * 10 + 2 AS STRING), ',"items":[{"price":"', """ + _MONEY.format("c_acctbal") + """, '","recentOrderNum":', CAST(c_nationkey * 9 AS STRING), ',"recentExecuteRate":', CAST(c_custkey % 101 AS STRING), ',"releaseTime":', CAST(c_nationkey * 60 AS STRING), ',"isOnline":', CASE WHEN c_custkey % 3 = 0 THEN 'false' ELSE 'true' END, ',"lastQuantity":"12.5"},{"price":"',
          CAST(CAST(c_acctbal AS DECIMAL(18,2)) + 1 AS STRING), '","lastQuantity":"7.25"}]}}') AS payload""",
        "customer",
    ),
    "kv_payloads": (
        "c_custkey AS id,\n"
        """CASE c_custkey % 5 WHEN 0 THEN concat('{"rate":"', CAST(c_nationkey AS STRING), '"}') WHEN 1 THEN concat('{"value":', CAST(c_nationkey AS STRING), ',"price":7}') WHEN 2 THEN concat('{"price":', CAST(c_nationkey AS STRING), '.5}')
          WHEN 3 THEN CAST(c_nationkey AS STRING) ELSE 'not {json' END AS payload""",
        "customer",
    ),
    "raw_times": (
        "event_id AS id,\n"
        """CASE user_id % 5 WHEN 0 THEN CAST(1700000000 + event_id AS STRING) WHEN 1 THEN CAST(1700000000000 + event_id AS STRING) WHEN 2 THEN concat('2024-01-0', CAST(1 + event_id % 9 AS STRING), 'T00:00:0', CAST(event_id % 10 AS STRING), 'Z') WHEN 3 THEN '' ELSE 'soon' END AS raw""",
        "events",
    ),
    "raw_errors": (
        "l_orderkey AS id,\nl_linenumber AS line,\n"
        """concat(CASE (l_partkey + l_suppkey) % 13 WHEN 0 THEN 'HTTPSConnectionPool: Read timed out' WHEN 1 THEN 'ConnectionRefusedError' WHEN 2 THEN 'ERC20: transfer amount exceeds balance' WHEN 3 THEN 'Insufficient balance' WHEN 4 THEN 'InsufficientAllowance(1)'
          WHEN 5 THEN 'AllowanceExpired' WHEN 6 THEN 'LOK' WHEN 7 THEN 'PoolNotInitialized()' WHEN 8 THEN 'Paused' WHEN 9 THEN 'Broken pipe' WHEN 10 THEN 'balance too odd' WHEN 11 THEN '' ELSE 'slippage' END, CASE WHEN l_suppkey % 2 = 0 THEN ': 0x08c379a0ff' ELSE '' END) AS error""",
        "lineitem",
    ),
    "swap_logs": (
        "event_id AS id,\nuser_id % 3 AS pool,\nevent_id * 7 AS block,\n"
        """concat('0x', CASE WHEN user_id % 11 = 0 THEN '00ff' ELSE concat(lpad(lower(hex(user_id * 1000)), 64, '0'), CASE WHEN user_id % 2 = 0 THEN lpad(lower(hex(event_id)), 64, '0') ELSE concat(repeat('f', 52), lpad(lower(hex(281474976710656 - 1000 - event_id)), 12, '0')) END, repeat('0', 256)) END) AS data""",
        "events",
    ),
}
_MESSAGE = "concat('order ', CAST(l_partkey AS STRING), ' refused')"
_PAYLOADS["reverts"] = (
    "l_orderkey AS id,\nl_linenumber AS line,\n"
    """CASE (l_partkey + l_suppkey) % 9 WHEN 0 THEN concat('0x08c379a0', lpad('20', 64, '0'), lpad(lower(hex(length({m}))), 64, '0'), rpad(lower(hex({m})), 128, '0'))
          WHEN 1 THEN '0x08c379a0ff' WHEN 2 THEN concat('0x08c379a0', lpad('20', 64, '0'), lpad('ffff', 64, '0'), '61') WHEN 3 THEN '' WHEN 4 THEN 'execution reverted: SPL: 0x08c379a000' WHEN 5 THEN 'reverted:  0xABCDEF0123' ELSE 'nonce too low' END AS error""".replace("{m}", _MESSAGE),
    "lineitem",
)
_RATE = "CASE WHEN {} % {} = 0 THEN {} ELSE CAST(CAST({} AS DECIMAL(18,2)) AS STRING) END"
_PAYLOADS["rate_payloads"] = (
    "p_partkey AS id,\n"
    "concat('{\"routes\":[{\"rate\":\"', " + _RATE.format("p_size", 4, "'0'", "p_retailprice") + ", '\",\"invert\":true},{\"rate\":\"', " + _RATE.format("p_size", 3, "''", "p_retailprice + 2")
    + ", '\",\"invert\":true},{\"rate\":\"0.00', CAST(p_size AS STRING), '\"},{\"rate\":', " + _RATE.format("p_size", 5, "'null'", "p_size") + ", ',\"invert\":false}]}') AS payload",
    "part",
)
#: Two pools per book and the coins of a wallet: root prices, liquidity, fees and gas; some are not known.
_COIN = "(3 + CAST(s_suppkey % 13 AS DOUBLE) / 4)"
_PAYLOADS["pool_states"] = (
    "s_suppkey AS book_id,\n"
    f"CASE WHEN s_suppkey % 17 <> 16 THEN sqrt({_COIN}) END AS qa,\nsqrt((1 + (CAST(s_suppkey % 9 AS DOUBLE) - 4) / 100) / {_COIN}) AS qb,\n"
    "20000 + abs(s_acctbal) * 5 AS la,\n15000 + abs(s_acctbal) * 3 AS lb,\nCAST(5 AS DOUBLE) / 10000 AS fee_a,\nCAST(3 AS DOUBLE) / 1000 AS fee_b,\n"
    "CASE WHEN s_suppkey % 23 <> 22 THEN CAST(1 + s_nationkey % 5 AS DOUBLE) / 50 END AS gas_a,\nCAST(1 + s_nationkey % 3 AS DOUBLE) * 3 / 10 AS gas_b,\ns_acctbal AS wallet",
    "supplier",
)
#: Logs of swaps with all six words: amounts of both signs and at their bounds, prices and liquidity of full width.
_HEX = "lpad(lower(hex({})), 64, '0')"
_MINUS = "concat(repeat('f', 52), lpad(lower(hex(281474976710655 - ({}))), 12, '0'))"
_HASH = "md5(CAST(event_id AS STRING))"
_PAYLOADS["pool_logs"] = (
    "event_id AS id,\nuser_id % 16 AS pool,\nevent_id * 7 AS block,\n"
    "concat('0x', CASE WHEN user_id % 29 = 0 THEN repeat('0a', 100) ELSE concat("
    f"CASE user_id % 5 WHEN 0 THEN {_HEX.format('event_id * 1000003')} WHEN 1 THEN {_MINUS.format('event_id')} WHEN 2 THEN concat(repeat('f', 32), '8', repeat('0', 31)) WHEN 3 THEN concat(repeat('0', 32), '7', repeat('f', 31)) ELSE repeat('f', 64) END, "
    f"CASE WHEN user_id % 2 = 0 THEN concat(repeat('f', 33), right({_HASH}, 31)) ELSE concat(repeat('0', 33), right({_HASH}, 31)) END, "
    f"concat(repeat('0', 24), CASE WHEN user_id % 7 = 0 THEN repeat('f', 40) ELSE concat(left({_HASH}, 8), {_HASH}) END), "
    f"concat(repeat('0', 32), CASE WHEN user_id % 13 = 0 THEN repeat('f', 32) ELSE {_HASH} END), "
    f"CASE WHEN user_id % 3 = 0 THEN {_HEX.format('event_id % 887273')} ELSE {_MINUS.format('event_id % 887272')} END, "
    f"{_HEX.format('user_id * 31')}) END) AS data",
    "events",
)
RELATIONS = {}
for _name, (_text, _table) in _PAYLOADS.items():
    RELATIONS[_name], SQL[_name] = _mutual(_text, _table)
