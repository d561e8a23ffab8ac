"""Sharding by balanced label propagation, balanced in bytes.

Documents with equal texts are linked through their text (a hub, never pairs). Rounds of joins move
linked documents to the shard where most of their group is, under capacity quotas; documents without
links only fill up. The labels then order all documents on a line (inside a label: free documents,
linked ones, free documents), which is cut into spans of equal bytes: the cuts fall on free documents
unless a group is larger than a shard, and sizes differ by a document at most.

Null texts have size 8 and CRC 0 and are linked with nothing. Repeated rows are separate documents
with slots of their own. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_totals, stored, unit_hash, with_facts

ROWS_PER_BUCKET = 4000


def nodes_of(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the hub (64-bit text hash; null for null texts)."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text", F.octet_length("text"))).alias("hub"),
    )


def propagate(linked: DataFrame, shards: int, total: int, rounds: int = 3, slack: float = 0.9) -> DataFrame:
    """``linked`` (hub, doc_id, size, copies, ...) with the label of each document after ``rounds`` rounds.

    A round: each hub counts its bytes by label and wants the largest; members elsewhere ask to move
    there; a label lets in the share of askers that its quota allows (``slack`` of an equal share of
    all bytes less what it holds), chosen by hash: whole groups, or single members where one group
    is more than a fiftieth of a shard. Votes are summed map-side first; what hubs of very many members
    want is broadcast, so that their members need not meet in one task.
    """
    quota = slack * total / shards
    linked = linked.withColumn("label", F.pmod(F.xxhash64("hub", F.pmod(F.xxhash64("doc_id"), F.lit(4))), F.lit(shards)).cast("int"))
    linked = stored(linked, "linked")
    for turn in range(rounds):
        votes = linked.groupBy("hub", "label").agg(F.sum("size").alias("held"), F.count("*").alias("n"))
        wanted = votes.groupBy("hub").agg(F.max_by("label", F.struct("held", F.xxhash64("hub", "label"))).alias("want"), F.sum("n").alias("n"))
        asks = with_facts(linked, wanted, ["hub"], ["want"])
        held = linked.groupBy("label").agg(F.sum("size").alias("held"))
        asked = asks.filter("label <> want").groupBy(F.col("want").alias("label")).agg(F.sum("size").alias("asked"))
        room = {r["label"]: min(1.0, max(0.0, quota - (r["held"] or 0)) / r["asked"]) for r in asked.join(held, "label", "left").collect()}
        share = F.lit(0.0)  # at most ``shards`` numbers
        for label, part in room.items():
            share = F.when(F.col("want") == label, F.lit(part)).otherwise(share)
        large = F.col("copies") * F.col("size") > quota / 50
        draw = F.when(large, unit_hash("doc_id", F.lit(turn))).otherwise(unit_hash("hub", F.lit(turn)))
        moved = F.when((F.col("label") != F.col("want")) & (draw < share), F.col("want")).otherwise(F.col("label"))
        linked = stored(asks.withColumn("label", moved).drop("want"), "linked")
    return linked


def shard(docs: DataFrame, shards: int = 24, rounds: int = 3) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), linked for each row."""
    nodes = stored(nodes_of(docs), "nodes")
    total, rows = nodes.agg(F.sum("size"), F.count("*")).first()
    hubs = nodes.filter("hub is not null").groupBy("hub").agg(F.count("*").alias("copies")).filter("copies > 1").withColumn("n", F.col("copies"))
    nodes = stored(with_facts(nodes, hubs, ["hub"], ["copies"]), "counted-nodes")
    linked = propagate(nodes.filter("copies is not null"), shards, total or 0, rounds)
    free = nodes.filter("copies is null").withColumn("copies", F.lit(1).cast("long"))
    free = free.withColumn("label", F.pmod(F.xxhash64("doc_id", F.lit("label")), F.lit(shards)).cast("int"))
    buckets = max(1, rows // (shards * ROWS_PER_BUCKET))
    spot = unit_hash("doc_id", F.lit("spot"))
    many = F.col("copies") > ROWS_PER_BUCKET
    free = free.withColumns({"part": F.when(spot < 0.5, 0).otherwise(3), "crowd": F.lit(0).cast("long"), "bucket": F.floor(spot * 2 * buckets).cast("long")})
    linked = linked.withColumns(
        {
            "part": F.when(many, 2).otherwise(1),
            "crowd": F.when(many, F.col("hub")).otherwise(F.lit(0)).cast("long"),
            "bucket": F.when(many, F.floor(spot * F.ceil(F.col("copies") / ROWS_PER_BUCKET))).otherwise(F.floor(unit_hash("hub", F.lit("spot")) * buckets)).cast("long"),
        }
    )
    cols = ["doc_id", "size", "text_crc32", "hub", "copies", "label", "part", "crowd", "bucket"]
    line = linked.select(cols).unionByName(free.select(cols)).withColumn("one", F.lit(1).cast("long"))
    line = running_totals(line, ["label", "part", "crowd", "bucket"], ["hub", "doc_id", "size", "text_crc32"], {"bytes_before": "size", "rows_before": "one"})
    middle = F.col("bytes_before") + F.col("size") / 2
    cut = F.least(F.floor(middle * shards / F.lit(max(total or 0, 1))), F.lit(shards - 1)).cast("int")
    line = stored(line.select("doc_id", "size", "text_crc32", "copies", cut.alias("shard"), "rows_before"), "line")
    first = {r["shard"]: r["first"] for r in line.groupBy("shard").agg(F.min("rows_before").alias("first")).collect()}
    start = F.lit(0)  # at most ``shards`` numbers
    for number, value in first.items():
        start = F.when(F.col("shard") == number, F.lit(value)).otherwise(start)
    return line.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rows_before") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), (F.col("copies") > 1).alias("linked")
    )
