"""Exact volume of the last 24 hours per pool as a stream with keyed state and event-time timers.

Swaps (pool, id, ts_ms, usd, uid, block, and ``at``, the same time as a timestamp) may arrive in any order within
``late`` of each other. A swap waits until the watermark has passed its ten minutes and is then counted in order of
time: entries older than 24 hours leave first, then a swap whose id is still held is a duplicate and is dropped
(ids that have left may return), then it is added. Swaps without an id are never duplicates. Amounts are whole
micro-dollars, so that totals do not drift; amounts that are not positive do not count.

Late data: a swap older than the watermark, i.e. more than ``late`` behind the newest swap of all pools, is
dropped by Spark before it reaches the state. Within ``late`` every order of arrival gives the same rows.
A row without an amount is a heartbeat: it only moves the watermark.

A pool's state is its entries by ten minutes, the ids held, the total, a cursor: the greatest block counted, and the
time of the last swap seen, counted or not: a duplicate behind the cursor pushes entries out too, and must not be read
again when the entry that it repeats has left. A pool is hidden until it is seeded: a batch backfill (``backfilled``) or saved rows (``saved``) start the
query as its initial state; swaps of a pool that has none are not counted. Where backfill and stream overlap, ids
make the seam exact. Saved rows without ids (of an older format) leave a pool unseeded, so that it is backfilled.

A pool is one key by its nature, its events are counted one after another; memory holds ten minutes of it and what they push out, the
ids that KEPT allows and, as swaps come, GATHERED of them.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.scratch import settings

#: A day, and the step of time that is settled and kept together, in milliseconds.
DAY, STEP = 86_400_000, 600_000
#: Swaps put to their steps at a time, and ids and pools that a task keeps in memory.
GATHERED, KEPT = 100_000, 10_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that start a query: one per entry held, and one without an entry for a pool that has none.
SAVED = "pool bigint, seeded boolean, cursor bigint, seen bigint, ts_ms bigint, id bigint, micros bigint, uid string"


@dataclass
class Pool:
    """A pool's ``meta``, and what a task has read of its entries by step and of its ids (whether held)."""

    total: int
    n: int
    steps: deque
    seeded: bool
    cursor: int | None
    seen: int | None
    stored: bool
    read: dict[int, deque] = field(default_factory=dict)
    ids: dict[str, bool] = field(default_factory=dict)
    #: What the state does not say yet: steps, and ids with their time (none: no longer held).
    touched: set[int] = field(default_factory=set)
    changed: dict[str, int | None] = field(default_factory=dict)


class RollingVolume(StatefulProcessor):
    """Rows (pool, ts_ms, volume, swaps): the total after all swaps of a millisecond.

    State: ``meta``; ``held`` and ``waiting``, entries [ts_ms, id, micros, uid, block] of a step of time as text;
    ``ids``. Each call writes what it changes. Within a task ``meta``, the ends of what is held and up to KEPT ids of up
    to KEPT pools are kept from call to call, so that a swap whose id is known asks the state nothing. Swaps that come
    are put to their steps by GATHERED at a time.
    """

    OUTPUT = "pool bigint, ts_ms bigint, volume bigint, swaps bigint"

    def __init__(self, gated: bool):
        self.gated = gated

    def init(self, handle) -> None:
        self.meta = handle.getValueState("meta", "total bigint, n bigint, steps string, seeded boolean, cursor bigint, seen bigint")
        self.held = handle.getMapState("held", "step bigint", "entries string")
        self.waiting = handle.getMapState("waiting", "step bigint", "entries string")
        self.ids = handle.getMapState("ids", "uid string", "ts_ms bigint")
        self.register_timer = handle.registerTimer
        self.pools = {}

    def _load(self, key: tuple) -> None:
        if key not in self.pools:
            if sum(1 + len(p.ids) for p in self.pools.values()) > KEPT:
                self.pools.clear()
            found = self.meta.get()
            total, n, steps, seeded, cursor, seen = found if found is not None else (0, 0, "[]", not self.gated, None, None)
            self.pools[key] = Pool(total, n, deque(json.loads(steps)), seeded, cursor, seen, found is not None)
        self.pool = self.pools[key]

    def _store(self) -> None:
        p = self.pool
        for step in p.touched:
            if p.read[step]:
                self.held.updateValue((step,), (json.dumps(list(p.read[step])),))
            elif self.held.containsKey((step,)):
                self.held.removeKey((step,))
        for uid, ts in p.changed.items():
            if ts is not None:
                self.ids.updateValue((uid,), (ts,))
            elif self.ids.containsKey((uid,)):
                self.ids.removeKey((uid,))
        self.meta.update((p.total, p.n, json.dumps(list(p.steps)), p.seeded, p.cursor, p.seen))
        p.touched, p.changed, p.stored = set(), {}, True
        p.read = {s: p.read[s] for s in {*list(p.steps)[:1], *list(p.steps)[-1:]} & p.read.keys()}
        if len(p.ids) > KEPT:
            p.ids.clear()

    def _entries(self, step: int) -> deque:
        read = self.pool.read
        if step not in read:
            read[step] = deque(json.loads(self.held.getValue((step,))[0]) if self.held.containsKey((step,)) else ())
        return read[step]

    def _evict(self, cutoff: int) -> None:
        p = self.pool
        while p.steps:
            entries = self._entries(p.steps[0])
            while entries and entries[0][0] < cutoff:
                ts, _, micros, uid, _ = entries.popleft()
                p.total, p.n = p.total - micros, p.n - 1
                p.touched.add(p.steps[0])
                if uid is not None:
                    p.ids[uid], p.changed[uid] = False, None
            if entries:
                return
            p.steps.popleft()

    def _count(self, entry: list) -> bool:
        """Whether the entry was added, after what is too old for its time has left."""
        ts, _, micros, uid, block = entry
        p = self.pool
        self._evict(ts - DAY)
        if uid is not None:
            if uid not in p.ids:
                p.ids[uid] = self.ids.containsKey((uid,))
            if p.ids[uid]:
                return False
            p.ids[uid], p.changed[uid] = True, ts
        step = ts // STEP
        if not p.steps or p.steps[-1] != step:
            p.steps.append(step)
        self._entries(step).append(entry)
        p.touched.add(step)
        p.total, p.n = p.total + micros, p.n + 1
        if block is not None:
            p.cursor = block if p.cursor is None else max(p.cursor, block)
        return True

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._load(key)
        p = self.pool
        p.seeded = bool(initialState["seeded"].all())
        if p.seeded:
            for r in initialState[initialState["ts_ms"].notna()].sort_values(["ts_ms", "id"]).itertuples():
                self._count([int(r.ts_ms), int(r.id), int(r.micros), None if pd.isna(r.uid) else r.uid, None])
            cursor = initialState["cursor"].max()
            p.cursor = None if pd.isna(cursor) else int(cursor)
            seen = initialState["seen"].max()
            p.seen = None if pd.isna(seen) else int(seen)
        self._store()

    def _wait(self, entries: list[list]) -> None:
        for step, own in groupby(sorted(entries, key=lambda e: e[0]), key=lambda e: e[0] // STEP):
            text = json.dumps(list(own))
            if self.waiting.containsKey((step,)):
                text = f"{self.waiting.getValue((step,))[0][:-1]}, {text[1:]}"
            else:
                self.register_timer((step + 1) * STEP - 1)
            self.waiting.updateValue((step,), (text,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load(key)
        entries: list[list] = []
        for part in rows if self.pool.seeded else ():
            part = part[part["micros"] > 0]
            ts, number, amount = (part[c].astype("int64").tolist() for c in ("ts_ms", "id", "micros"))
            uid, block = ([None if lost else x for x, lost in zip(part[c].tolist(), part[c].isna())] for c in ("uid", "block"))
            entries += ([*e, None if b is None else int(b)] for *e, b in zip(ts, number, amount, uid, block))
            if len(entries) >= GATHERED:
                self._wait(entries)
                entries = []
        self._wait(entries)
        if not self.pool.stored:
            self._store()
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        step, made = expiredTimerInfo.getExpiryTimeInMs() // STEP, {}
        self._load(key)
        p = self.pool
        for entry in sorted(json.loads(self.waiting.getValue((step,))[0]), key=lambda e: e[:2]):
            if self._count(entry):
                made[entry[0]] = (p.total, p.n)
            p.seen = entry[0] if p.seen is None else max(p.seen, entry[0])
        self.waiting.removeKey((step,))
        self._store()
        if made:
            yield pd.DataFrame([(key[0], ts, *rest) for ts, rest in made.items()], columns=["pool", "ts_ms", "volume", "swaps"]).astype("int64")


def micros(usd: Column) -> Column:
    return F.round(usd * 1_000_000).cast("bigint")


def rolling_volume(stream: DataFrame, late: str = "3 hours", start: DataFrame | None = None) -> DataFrame:
    """Totals of ``stream`` (pool, id, ts_ms, usd, uid, block, at). ``start`` has rows as SAVED and makes totals
    hidden for pools without seeded rows; without it every pool counts from its first swap."""
    rows = stream.withWatermark("at", late).select("pool", "id", "ts_ms", micros(F.col("usd")).alias("micros"), "uid", "block", "at")
    seeds = None if start is None else start.groupBy("pool")
    return rows.groupBy("pool").transformWithStateInPandas(RollingVolume(start is not None), RollingVolume.OUTPUT, "append", "eventTime", initialState=seeds)


def backfilled(swaps: DataFrame, upto: DataFrame) -> DataFrame:
    """Initial state (SAVED) from a batch of swaps: those of the 24 hours before each pool's ``cursor`` block in
    ``upto`` (pool, cursor), the cursor's block included. Pools that are not in ``upto`` are not seeded."""
    rows = swaps.join(upto, "pool").filter((F.col("block") <= F.col("cursor")) & (F.col("usd") > 0))
    newest = rows.groupBy("pool").agg(F.max("ts_ms").alias("newest"))
    kept = rows.join(newest, "pool").filter(F.col("ts_ms") >= F.col("newest") - DAY)
    entries = kept.select("pool", F.lit(True).alias("seeded"), "cursor", F.lit(None).cast("bigint").alias("seen"), "ts_ms", "id", micros(F.col("usd")).alias("micros"), "uid")
    empty = upto.select("pool", F.lit(True).alias("seeded"), "cursor", *(F.lit(None).cast(t).alias(n) for n, t in (("seen", "bigint"), ("ts_ms", "bigint"), ("id", "bigint"), ("micros", "bigint"), ("uid", "string"))))
    return entries.unionByName(empty)


def after(swaps: DataFrame, cursors: DataFrame, blocks_a_day: int = 43_200) -> DataFrame:
    """Swaps that a query which starts from ``cursors`` (pool, cursor; null: none) has to read: from the cursor's block
    on, that block included, where ids tell what is new (swaps without an id are only taken behind it), and not
    further back than a day before the pool's newest block. Where ``cursors`` has ``seen`` and it is not null, what is
    new are the swaps after that time, with and without an id: those up to it were counted or dropped."""
    if "seen" not in cursors.columns:
        cursors = cursors.withColumn("seen", F.lit(None).cast("bigint"))
    floor = swaps.groupBy("pool").agg((F.max("block") - blocks_a_day).alias("floor"))
    rows = swaps.join(cursors.select("pool", "cursor", F.col("seen").alias("_seen")), "pool", "left").join(floor, "pool")
    new = F.col("cursor").isNull() | (F.col("block") > F.col("cursor")) | ((F.col("block") == F.col("cursor")) & F.col("uid").isNotNull())
    new = F.when(F.col("_seen").isNull(), new).otherwise(F.col("ts_ms") > F.col("_seen"))
    return rows.filter(new & (F.col("block") >= F.col("floor"))).select(swaps.columns)


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def volumes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """pool, volume (micro-dollars, null while hidden), swaps, cursor: what a query's state holds, as of each
    pool's last swap."""
    v = F.col("value")
    return _state(spark, checkpoint, "meta").select(F.col("key.pool").alias("pool"), F.when(v["seeded"], v["total"]).alias("volume"), F.when(v["seeded"], v["n"]).alias("swaps"), v["cursor"].alias("cursor"))


def saved(spark: SparkSession, checkpoint: str) -> DataFrame:
    """A query's state as rows (SAVED), to be written anywhere and to start another query."""
    entry = "array<array<string>>"
    held = _state(spark, checkpoint, "held").select(F.col("key.pool").alias("pool"), F.explode(F.from_json("user_map_value.entries", entry)).alias("e"))
    value = lambda i, kind: F.get("e", F.lit(i)).cast(kind)
    entries = held.select("pool", value(0, "bigint").alias("ts_ms"), value(1, "bigint").alias("id"), value(2, "bigint").alias("micros"), value(3, "string").alias("uid"))
    meta = _state(spark, checkpoint, "meta").select(F.col("key.pool").alias("pool"), "value.seeded", "value.cursor", "value.seen")
    return meta.join(entries, "pool", "left").select("pool", "seeded", "cursor", "seen", "ts_ms", "id", "micros", "uid")


def restored(rows: DataFrame) -> DataFrame:
    """Saved rows as an initial state. Rows of the format without ids (no ``id`` or ``uid`` column, or a null id
    beside a time) cannot be told from what comes again: their pools lose the seed, and so do pools that were
    not seeded."""
    for name, kind in (("id", "bigint"), ("uid", "string"), ("seen", "bigint")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    legacy = F.bool_or(F.col("ts_ms").isNotNull() & F.col("id").isNull())
    bad = rows.groupBy("pool").agg((F.bool_and("seeded") & ~legacy).alias("whole"))
    return rows.join(bad, "pool").withColumn("seeded", F.col("whole")).select("pool", "seeded", "cursor", "seen", "ts_ms", "id", "micros", "uid")


def run(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, start: DataFrame | None = None, late: str = "3 hours") -> None:
    """Counts all files of ``folder`` that the checkpoint has not seen, and stops."""
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS):
        stream = spark.readStream.schema(schema).parquet(folder)
        made = rolling_volume(stream, late, start)
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
