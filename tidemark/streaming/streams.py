"""Structured Streaming forms: event dedup, sliding volume, last value per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.relations import latest_per_key


def event_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def deduplicated(stream: DataFrame, keys: list[str], time: str, span: str = "24 hours") -> DataFrame:
    """Drops repeated ids within the watermark; rows without an id are never duplicates.

    The span is event time (``time`` is a timestamp column); state is bounded by the watermark.
    """
    marked = stream.withWatermark(time, span)
    null_id = F.col(keys[-1]).isNull()
    once = marked.filter(~null_id).dropDuplicatesWithinWatermark(keys)
    return once.unionByName(marked.filter(null_id))


def sliding_volume(stream: DataFrame, key: str, time: str, value: str, span: str = "24 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sum of ``value`` per key and sliding window, finished windows only."""
    windows = stream.withWatermark(time, late).groupBy(F.window(time, span, step).alias("span"), key)
    return windows.agg(F.sum(value).alias("volume"), F.count("*").alias("events"))


def retained(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key so far, for update or complete mode."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def upsert_into(path: str, keys: list[str], order: list[str], every: int = 50):
    """foreachBatch sink: a Parquet table of the last row per key, one version folder per batch.

    A batch writes its own last rows only; each ``every``-th one writes the whole state, so that reading folds a
    bounded number of versions. A batch that runs again overwrites its version with the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch
        if number and number % every == 0:
            rows = upserted(batch.sparkSession, path, keys, order, number - 1, every).select(batch.columns).unionByName(batch)
        latest_per_key(rows, keys, order).write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def upserted(spark: SparkSession, path: str, keys: list[str], order: list[str], upto: int | None = None, every: int = 50) -> DataFrame:
    """The table behind ``upsert_into``: last rows per key since the latest whole version (of versions to ``upto``)."""
    rows = spark.read.parquet(path)
    rows = rows if upto is None else rows.filter(F.col("version") <= upto)
    newest = rows.agg(F.max("version")).first()[0] or 0
    return latest_per_key(rows.filter(F.col("version") >= newest // every * every).drop("version"), keys, order)
