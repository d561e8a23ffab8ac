from pyspark.sql import functions as F

from tidemark.sources import views
from tidemark.streaming import streams


def run(frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)


def test_dedup_and_retained_equal_batch(spark, sf, tmp_path):
    swaps = views.swaps(spark, sf).withColumn("ts", F.timestamp_millis("ts_ms"))
    swaps.coalesce(1).orderBy("ts_ms").write.parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), swaps.schema)
    run(streams.deduplicated(stream, ["pool", "uid"], "ts", "60 days"), "once")
    keyed = swaps.filter("uid is not null").select("pool", "uid").distinct().count()
    assert spark.table("once").count() == keyed + swaps.filter("uid is null").count()
    run(streams.retained(stream, ["pool"], ["ts_ms", "id"]), "kept", "complete")
    want = {r["pool"]: r["id"] for r in swaps.groupBy("pool").agg(F.max_by("id", F.struct("ts_ms", "id")).alias("id")).collect()}
    assert {r["pool"]: r["id"] for r in spark.table("kept").collect()} == want
    query = stream.writeStream.foreachBatch(streams.upsert_into(str(tmp_path / "state"), ["pool"], ["ts_ms", "id"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    state = spark.read.parquet(str(tmp_path / "state" / "version=0"))
    assert {r["pool"]: r["id"] for r in state.collect()} == want


def test_versions_fold_to_the_last_rows(spark, tmp_path):
    write, last = streams.upsert_into(str(tmp_path / "s"), ["k"], ["at"], every=3), {}
    for number in range(8):
        rows = [(k, number * 10 + k % 3, f"v{number}") for k in range(number % 4, number % 4 + 3)]
        last |= {k: v for k, _, v in rows}
        for _ in range(2):  # a batch that runs again
            write(spark.createDataFrame(rows, "k int, at int, v string"), number)
        got = streams.upserted(spark, str(tmp_path / "s"), ["k"], ["at"], every=3)
        assert {r["k"]: r["v"] for r in got.collect()} == last
    assert spark.read.parquet(str(tmp_path / "s" / "version=7")).count() == 3


def test_sliding_volume(spark, sf, tmp_path):
    swaps = views.swaps(spark, sf).withColumn("ts", F.timestamp_millis("ts_ms"))
    swaps.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), swaps.schema)
    run(streams.sliding_volume(stream, "pool", "ts", "usd"), "volume", "complete")
    first = spark.table("volume").orderBy("span.start", "pool").first()
    low, high = (int(first["span"][k].timestamp() * 1000) for k in ("start", "end"))
    rows = [r["usd"] for r in swaps.filter((F.col("pool") == first["pool"]) & (F.col("ts_ms") >= low) & (F.col("ts_ms") < high)).collect()]
    assert abs(sum(rows) - first["volume"]) < 1e-6 and len(rows) == first["events"]
