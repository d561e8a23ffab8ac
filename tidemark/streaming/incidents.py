"""Alerts to incidents as a stream: one open incident per key, closed by a cool-down.

An incident is a session of event time: alerts of a key less than ``cool`` apart. It stays open in the state and
counts its alerts; when the watermark has passed its last alert by ``cool`` it closes and comes out once, with
the latest severity. A later alert of the key opens a new one. An alert without a key is an incident of its own.
Alerts more than ``late`` behind the newest one are dropped. Rows without a time and id only move the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def incidents(stream: DataFrame, cool: str, late: str = "3 hours") -> DataFrame:
    """key, first_seen, last_seen, occurrences, severity, closed (milliseconds) of ``stream`` (id, ts_ms,
    dedupe_key, severity, at)."""
    key = F.coalesce("dedupe_key", F.concat(F.lit("row "), F.col("id").cast("string")), F.lit(""))
    rows = stream.withWatermark("at", late).withColumn("key", key)  # a filter here would also hide rows from the watermark
    made = rows.groupBy(F.session_window("at", cool).alias("span"), "key").agg(
        F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("last_seen"), F.count("*").alias("occurrences"), F.max_by("severity", F.struct("ts_ms", "id")).alias("severity")
    )
    return made.filter("first_seen IS NOT NULL").select("key", "first_seen", "last_seen", "occurrences", "severity", F.unix_millis("span.end").alias("closed"))


def run(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str, cool: str) -> None:
    """Closes what can be closed after all files of ``folder`` that the checkpoint has not seen, and stops."""
    stream = spark.readStream.schema(schema).parquet(folder)
    incidents(stream, cool).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
