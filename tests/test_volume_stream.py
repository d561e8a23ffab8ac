"""The volume stream against a plain sliding fold: restarts, late and missing ids, seams, hidden pools."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans.streams import SWAPS
from tidemark.streaming import incidents, volume

HOUR = 3_600_000


def plain(rows):
    """Totals by (pool, ms), and those at the end, of (pool, id, ts, micros, uid) in any order."""
    by, out, last = {}, {}, {}
    for pool, id_, ts, micros, uid in sorted(rows, key=lambda r: (r[2], r[1])):
        held = by.setdefault(pool, [])
        held[:] = [h for h in held if h[0] >= ts - volume.DAY]
        if uid is None or all(h[2] != uid for h in held):
            held.append((ts, micros, uid))
            out[pool, ts] = sum(h[1] for h in held)
        last[pool] = (sum(h[1] for h in held), len(held))
    return out, last


def frame(spark, rows):
    made = spark.createDataFrame([(p, i, ts, None if m is None else m / 1e6, u, ts // 2000) for p, i, ts, m, u in rows], "pool bigint, id bigint, ts_ms bigint, usd double, uid string, block bigint")
    return made.withColumn("at", F.timestamp_millis("ts_ms"))


def beat(rows):
    return (-1, -1, max(r[2] for r in rows) + volume.DAY, None, None)


def swaps(n, seed, pools=3):
    rng = random.Random(seed)
    return [(rng.randrange(pools), i, HOUR + rng.randrange(4 * 24 * HOUR), rng.randrange(1, 10**7), rng.choice([None, *(f"u{k}" for k in range(n // 6))])) for i in range(n)]


def send(spark, rows, tmp, start=None, name="a"):
    frame(spark, rows).write.mode("append").parquet(f"{tmp}/{name}-in")
    volume.run(spark, f"{tmp}/{name}-in", SWAPS, f"{tmp}/{name}-out", f"{tmp}/{name}", start)


def totals(spark, tmp, name="a"):
    return {r["pool"]: (r["volume"], r["swaps"]) for r in volume.volumes(spark, f"{tmp}/{name}").collect() if r["pool"] >= 0}


def test_order_restarts_and_late_rows(spark, tmp_path):
    rows = swaps(240, 1)
    want, last = plain(rows)
    rng = random.Random(2)
    arrived = sorted(rows, key=lambda r: r[2] + rng.randrange(2 * HOUR))
    send(spark, arrived[:150], tmp_path)
    late = (0, 10**6, 60_000, 5, "late")  # days behind the newest swap
    send(spark, [*arrived[150:], late, beat(rows), (1, 10**6 + 1, 10 * HOUR, -7, None)], tmp_path)
    got = {(r["pool"], r["ts_ms"]): r["volume"] for r in spark.read.parquet(f"{tmp_path}/a-out").collect()}
    assert got == want and totals(spark, tmp_path) == last
    volume.run(spark, f"{tmp_path}/a-in", SWAPS, f"{tmp_path}/a-out", f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a-out").count() == len(want)


def test_ids_return_after_a_day_and_missing_ids_stay(spark, tmp_path):
    start, end = 10**9, 10**9 + volume.DAY
    rows = [(0, 1, start, 1, "x"), (0, 2, end, 10, "x"), (0, 3, end + 1, 100, "x"), (0, 4, end + 1, 1000, None), (0, 5, end + 1, 1000, None)]
    send(spark, [*rows, beat(rows)], tmp_path)
    got = {(r["pool"], r["ts_ms"]): r["volume"] for r in spark.read.parquet(f"{tmp_path}/a-out").collect()}
    assert got == plain(rows)[0] == {(0, start): 1, (0, end + 1): 2100}


def test_saved_state_goes_on_and_failed_or_old_state_hides(spark, tmp_path):
    rows = swaps(200, 3)
    _, last = plain(rows)
    cut = 3 * 24 * HOUR
    first = [r for r in rows if r[2] < cut]
    send(spark, [*first, beat(first)], tmp_path)
    volume.saved(spark, f"{tmp_path}/a").write.json(f"{tmp_path}/saved")
    state = spark.read.schema(volume.SAVED).json(f"{tmp_path}/saved").filter("pool >= 0")
    gap = volume.after(frame(spark, rows), state.select("pool", "cursor").distinct(), blocks_a_day=10**9)
    again = [(r["pool"], r["id"], r["ts_ms"], round(r["usd"] * 1e6), r["uid"]) for r in gap.collect()]
    assert len(rows) - len(first) <= len(again) < len(rows)
    start = volume.restored(state).filter("pool <> 2")  # the backfill of pool 2 failed
    send(spark, [*again, beat(rows)], tmp_path, start, "b")
    assert totals(spark, tmp_path, "b") == {0: last[0], 1: last[1], 2: (None, None)}
    legacy = volume.restored(state.drop("id", "uid"))
    assert {r["seeded"] for r in legacy.filter("ts_ms IS NOT NULL").collect()} == {False}
    clamped = volume.after(frame(spark, rows), state.select("pool", "cursor").limit(0))
    assert clamped.count() == sum(r[2] // 2000 >= max(x[2] // 2000 for x in rows if x[0] == r[0]) - 43_200 for r in rows)


def test_duplicates_behind_the_cursor_are_not_read_again(spark, tmp_path):
    """The last duplicate before the state is saved pushes out the first entry of x, which an earlier duplicate, behind
    the cursor, repeats; a swap without an id in the last block seen comes after it."""
    rows = [(0, 1, HOUR, 1, "x"), (0, 2, 21 * HOUR, 10, "y"), (0, 3, 24 * HOUR, 100, "x"), (0, 4, 26 * HOUR, 1000, "y")]
    first, rows = list(rows), [*rows, (0, 5, 26 * HOUR + 1, 10_000, None), (0, 6, 27 * HOUR, 100_000, "z"), (1, 7, 27 * HOUR, 7, "n")]
    send(spark, [*first, beat(first)], tmp_path)
    volume.saved(spark, f"{tmp_path}/a").write.json(f"{tmp_path}/saved")
    state = spark.read.schema(volume.SAVED).json(f"{tmp_path}/saved").filter("pool >= 0")
    gap = volume.after(frame(spark, rows), state.select("pool", "cursor", "seen").distinct())
    assert sorted(r["id"] for r in gap.collect()) == [5, 6, 7]
    start = volume.restored(state).unionByName(volume.backfilled(frame(spark, rows), spark.createDataFrame([(1, None)], "pool bigint, cursor bigint")))
    again = [r for r in rows if r[1] in (5, 6, 7)]
    send(spark, [*again, beat(rows)], tmp_path, start, "b")
    assert totals(spark, tmp_path, "b") == plain(rows)[1] == {0: (110_010, 3), 1: (7, 1)}


def test_backfill_meets_stream(spark, tmp_path):
    rows = [(0, i, i * HOUR + HOUR, 1 << i, f"u{i % 5}" if i % 3 else None) for i in range(40)]
    cursor = 21 * HOUR // 2000
    start = volume.backfilled(frame(spark, rows), spark.createDataFrame([(0, cursor), (7, cursor)], "pool bigint, cursor bigint"))
    assert start.filter("ts_ms IS NOT NULL").count() == 21
    live = [r for r in rows if r[2] > 21 * HOUR or (r[2] == 21 * HOUR and r[4])]
    send(spark, [*live, beat(rows)], tmp_path, start)
    assert totals(spark, tmp_path)[0] == plain(rows)[1][0]


class Asked(dict):
    """A state variable that counts what is asked of it."""

    def __init__(self):
        self.asked = 0

    def __getattribute__(self, name):
        if name in ("getValue", "containsKey", "updateValue", "removeKey"):
            self.asked += 1
        return super().__getattribute__(name)

    def getValue(self, key):
        return self.get(key)

    def containsKey(self, key):
        return key in self

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


def test_state_is_asked_by_steps_and_ids_not_by_swaps():
    """3,000 swaps in parts of ten, in a random order: one step that all parts have, and another a day later."""
    from types import SimpleNamespace

    import pandas as pd

    rng, timers, held, meta = random.Random(5), [], {}, SimpleNamespace(value=None)
    meta.get, meta.update = lambda: meta.value, lambda value: setattr(meta, "value", value)
    handle = SimpleNamespace(getValueState=lambda *_: meta, getMapState=lambda name, *_: held.setdefault(name, Asked()), registerTimer=timers.append)
    rows = [(0, i, HOUR * 30 + rng.randrange(volume.STEP) + i % 2 * volume.DAY, rng.randrange(1, 10**7), rng.choice([None, *"abcdefgh"])) for i in range(3000)]
    fold = volume.RollingVolume(False)
    fold.init(handle)
    parts = (pd.DataFrame([(*r, r[2] // 2000) for r in rows[at : at + 10]], columns=["pool", "id", "ts_ms", "micros", "uid", "block"]) for at in range(0, 3000, 10))
    made = list(fold.handleInputRows((0,), parts, None))
    assert held["waiting"].asked <= 8 and len(timers) == 2
    for at in sorted(timers):
        made += fold.handleExpiredTimer((0,), None, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
    want, last = plain(rows)
    assert {(r.pool, r.ts_ms): r.volume for m in made for r in m.itertuples()} == want and meta.value[:2] == last[0]
    assert held["ids"].asked <= 40 and not held["waiting"] and {k[0] for k in held["ids"]} <= set("abcdefgh")
    again = volume.RollingVolume(False)  # another task goes on from what was written
    again.init(handle)
    later = (0, 9000, max(r[2] for r in rows), 5, "a")
    list(again.handleInputRows((0,), [pd.DataFrame([(*later, 1)], columns=["pool", "id", "ts_ms", "micros", "uid", "block"])], None))
    list(again.handleExpiredTimer((0,), None, SimpleNamespace(getExpiryTimeInMs=lambda: timers[-1])))
    assert meta.value[:2] == plain([*rows, later])[1][0]


def test_incidents_open_close_and_open_again(spark, tmp_path):
    day = 24 * HOUR
    rows = [(1, 1, "k", "info"), (2, HOUR, "k", "critical"), (3, 6 * HOUR, "k", "warning"), (4, HOUR, None, "info"), (5, HOUR, None, "info")]
    shape = "id bigint, ts_ms bigint, dedupe_key string, severity string"
    alerts = spark.createDataFrame(rows, shape).withColumn("at", F.timestamp_millis("ts_ms"))
    last = spark.createDataFrame([(None, None, None, None, day * 3)], f"{shape}, t bigint").withColumn("at", F.timestamp_millis("t")).drop("t")
    for part in (alerts, last):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        incidents.run(spark, f"{tmp_path}/in", alerts.schema, f"{tmp_path}/out", f"{tmp_path}/cp", "4 hours")
    got = sorted((r["key"], r["first_seen"], r["last_seen"], r["occurrences"], r["severity"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("k", 1, HOUR, 2, "critical"), ("k", 6 * HOUR, 6 * HOUR, 1, "warning"), ("row 4", HOUR, HOUR, 1, "info"), ("row 5", HOUR, HOUR, 1, "info")]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tidemark.sources.scratch import shared_folder

    def session(master, **conf):
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://host:7077"), "x")
    assert shared_folder(session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs:/work/"}), "x").startswith("hdfs:/work/x-")
    assert "tidemark-" in shared_folder(session("local[4]"), "x")
