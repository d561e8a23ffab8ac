"""The log source by blocks, over restarts; feeds that fall silent."""

import time

from pyspark.sql import functions as F

from tidemark.streaming import logs

SHAPE = "id bigint, block bigint"


def test_every_log_once_over_restarts(spark, tmp_path):
    rows = spark.range(500).select("id", (F.col("id") * 7 + 100).alias("block"))
    for low, high, start in ((0, 200, 100), (200, 350, 100), (350, 500, 100)):
        rows.filter((F.col("id") >= low) & (F.col("id") < high)).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):  # the second run finds nothing new
            stream = logs.chain_logs(spark, f"{tmp_path}/in", SHAPE, blocks_per_batch=300, blocks_per_read=70, start_block=start)
            logs.drain(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
        got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
        assert sorted(got) == [(i, i * 7 + 100) for i in range(high)]


def test_ranges_cover_all_blocks():
    assert logs.ranges(9, 20, 4) == [(10, 13), (14, 17), (18, 20)] and logs.ranges(5, 5, 4) == []
    reader = logs.ChainLogReader({"path": "x", "start_block": "10", "blocks_per_batch": "5"}, ["block"])
    reader._bounds = lambda: (3, 17)
    assert reader.initialOffset() == {"block": 9}
    assert [reader.latestOffset()["block"] for _ in range(3)] == [14, 17, 17]
    reader = logs.ChainLogReader({"path": "x"}, ["block"])
    reader._bounds = lambda: (0, -1)
    assert reader.initialOffset() == {"block": -1} and reader.latestOffset() == {"block": -1}


def test_one_row_for_each_silence(spark, tmp_path):
    def send(i, *feeds):
        spark.createDataFrame([(f,) for f in feeds], "feed string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    send(0, "a", "b")
    query = logs.watch(spark.readStream.schema("feed string").parquet(f"{tmp_path}/in"), 6000, f"{tmp_path}/out", f"{tmp_path}/cp")
    try:
        counts = lambda: {r["feed"]: r["count"] for r in spark.read.schema(logs.Silence.OUTPUT).parquet(f"{tmp_path}/out").groupBy("feed").count().collect()}
        deadline = time.time() + 90
        while counts() != {"a": 1, "b": 1} and time.time() < deadline:
            time.sleep(1)
        assert counts() == {"a": 1, "b": 1}
        time.sleep(7)
        assert counts() == {"a": 1, "b": 1}  # still silent: nothing more
        send(1, "a")
        while counts() != {"a": 2, "b": 1} and time.time() < deadline:
            time.sleep(1)
        assert counts() == {"a": 2, "b": 1}
    finally:
        query.stop()
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        assert r["silent_since"] == r["last_ms"] + 6000
