"""Shared pieces of the corpus operators: word rule, scratch tables, distributed running totals."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and U+0009..U+000D.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folder of the scratch tables of the operator at work; those of operators within it go there too.
_FOLDER: ContextVar[str | None] = ContextVar("_FOLDER", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary folder if
    driver and executors are one process. A cluster without the setting is refused: nothing else is known to be
    shared, and a warehouse may be a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
        return _local_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: a cut in the lineage
    that survives lost executors and is smaller than serialized checkpoint rows."""
    spark = df.sparkSession
    path = f"{folder or _FOLDER.get() or scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote; to be called once all that reads them is stored itself."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stored inside the block are removed at its end. What it yields stores results, which stay
    (until an enclosing block ends)."""
    outer = _FOLDER.get() or scratch_dir(spark)
    own = f"{outer}/work-{uuid.uuid4().hex}"
    token = _FOLDER.set(own)
    try:
        yield lambda df, name: stored(df, name, outer)
    finally:
        _FOLDER.reset(token)
        _delete(spark, own)


def words_of(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*cols: Column | str) -> Column:
    """A double in [0, 1) that depends on the given columns only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def running_totals(
    df: DataFrame, bucket: Sequence[str], order: Sequence[Column | str], totals: dict[str, str], within: Sequence[str] = ()
) -> DataFrame:
    """Exclusive running totals over a global order without a single-task window.

    The global order is ``bucket`` columns first (ascending, nulls first), then ``order`` inside a
    bucket. Each bucket is summed once (with map-side combination), the few bucket sums are scanned
    to give every bucket its offset, and rows are then scanned inside their bucket. ``totals`` maps
    a new column to the summed column; ``within`` are leading bucket columns that restart totals.
    """
    rest = [c for c in bucket if c not in within]
    sums = df.groupBy(*bucket).agg(*(F.sum(v).alias(f"_sum_{k}") for k, v in totals.items()))
    scan = Window.partitionBy(*within).orderBy(*rest).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *(F.col(c).alias(f"_at_{c}") for c in bucket), *(F.coalesce(F.sum(f"_sum_{k}").over(scan), F.lit(0)).alias(f"_off_{k}") for k in totals)
    )
    inside = Window.partitionBy(*bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({f"_in_{k}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in totals.items()})
    on = [out[c].eqNullSafe(offsets[f"_at_{c}"]) for c in bucket]
    out = out.join(offsets, on, "left").withColumns({k: F.col(f"_off_{k}") + F.col(f"_in_{k}") for k in totals})
    return out.drop(*(f"_at_{c}" for c in bucket), *(f"{p}{k}" for k in totals for p in ("_off_", "_in_")))


#: A key is hot beyond this part of all rows, so that there are at most as many hot keys.
HOT_PART = 1000


def with_facts(rows: DataFrame, facts: DataFrame, on: Sequence[str], values: Sequence[str], n: str = "n") -> DataFrame:
    """``rows`` with the ``values`` of ``facts``, which has one row per key and ``n``, the key's number of rows.

    Spark does not split a join with an aggregate on the same key, so rows of a hot key would meet in one
    task. Keys with more than 1 / HOT_PART of all rows, of which there are at most HOT_PART, are broadcast
    instead, and their rows are dealt out evenly; the others are joined by key. Null keys are keys.
    """
    facts = stored(facts.select(*on, *values, n), "facts")
    total = facts.agg(F.sum(n)).first()[0] or 0
    named = lambda p, also: facts.select(*(F.col(c).alias(f"{p}{c}") for c in (*on, *values)), *also)
    hot = named("_h_", [F.lit(1).alias("_hot")]).where(facts[n] * HOT_PART > total)
    same = lambda p, left: [left[c].eqNullSafe(F.col(f"{p}{c}")) for c in on]
    out = rows.join(F.broadcast(hot), same("_h_", rows), "left")
    spot = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(HOT_PART)))
    out = out.withColumn("_spot", spot.cast("int"))
    # always 0, but of a column: a literal would be pushed out of the join's keys, and rows dealt by key alone
    cold = named("_c_", [F.pmod(facts[n], F.lit(1)).cast("int").alias("_at")]).where(facts[n] * HOT_PART <= total)
    out = out.join(cold, [*same("_c_", out), out["_spot"] == F.col("_at")], "left")
    made = {v: F.when(F.col("_hot").isNull(), F.col(f"_c_{v}")).otherwise(F.col(f"_h_{v}")) for v in values}
    return out.select(*(rows[c] for c in rows.columns), *(c.alias(v) for v, c in made.items()))
