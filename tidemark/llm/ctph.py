"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of seven code points marks piece boundaries; each piece gives one letter. The block
size (a power of two times MIN_BLOCK) is the smallest that makes about LETTERS pieces, halved while
the signature is short; a fingerprint holds the signatures at that size and at twice it. Fingerprints
are compared by edit distance at equal or adjacent block sizes, else their likeness is 0.

Null and empty texts have the fingerprint of the empty text; equal texts have equal fingerprints, and
equal fingerprints have likeness 1. Null document ids come last in order; rows with one id follow the
order of their texts. One row is its own neighbour. Empty tables give empty results. Extra columns
are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .rolling import code_points, piece_hashes, trigger

MIN_BLOCK, LETTERS = 4, 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
#: Ranges of document ids are cut from a histogram with at most so many cells.
CELLS, ROWS_PER_BUCKET = 1 << 16, 1000


def fingerprint(points: np.ndarray) -> str:
    """block:signature:signature at twice the block."""
    n = len(points)
    block = MIN_BLOCK
    while block * LETTERS < n:
        block *= 2
    if not n:
        return f"{block}::"
    rolled = trigger(points)
    marks = {}

    def ends_at(size: int) -> np.ndarray:
        if size not in marks:
            found = np.flatnonzero((rolled & np.uint32(size - 1)) == size - 1) + 1
            if len(found) >= LETTERS:
                found = found[: LETTERS - 1]
            marks[size] = found if len(found) and found[-1] == n else np.append(found, n)
        return marks[size]

    while block > MIN_BLOCK and len(ends_at(block)) < LETTERS // 2:
        block //= 2
    letters = []
    for size in (block, 2 * block):
        hashes = piece_hashes(points, ends_at(size))
        letters.append(ALPHABET[(hashes >> np.uint64(58)).astype(np.int64)].tobytes().decode())
    return f"{block}:{letters[0]}:{letters[1]}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints, by native edit distance."""
    fa, fb = F.split(a, ":"), F.split(b, ":")
    size_a, size_b = fa[0].cast("long"), fb[0].cast("long")

    def score(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(x, y) / longest)

    return (
        F.when(a == b, F.lit(1.0))
        .when(size_a == size_b, F.greatest(score(fa[1], fb[1]), score(fa[2], fb[2])))
        .when(size_a == 2 * size_b, score(fa[1], fb[2]))
        .when(size_b == 2 * size_a, score(fa[2], fb[1]))
        .otherwise(F.lit(0.0))
    )


def ranged(docs: DataFrame, key: str, text: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows of ``docs`` in consecutive buckets of descending ``key``, with each bucket followed by a
    copy (``ahead``) of the first row of the next one; after the last comes the first.

    Buckets are whole cells of a histogram of the key with at most CELLS cells, so what is broadcast
    has that bound whatever the table's size; a text moves once, bucket heads twice.
    """
    low, high = docs.agg(F.min(key), F.max(key)).first()
    low, high = (0, 0) if low is None else (low, high)
    width = (high - low) // CELLS + 1
    cell = F.coalesce(F.floor((F.lit(high).cast("decimal(38,0)") - F.col(key)) / F.lit(width)).cast("long"), F.lit(CELLS))
    cells = docs.select(cell.alias("_cell"), key).groupBy("_cell").agg(F.count("*").alias("n"), F.max(key).alias("head"))
    upto = F.sum("n").over(Window.partitionBy().orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("range", F.floor(F.coalesce(upto, F.lit(0)) / rows_per_bucket))
    number = F.dense_rank().over(Window.partitionBy().orderBy("range")) - 1
    cells = stored(cells.select("_cell", "head", number.alias("bucket")), "id-cells")
    heads = cells.groupBy("bucket").agg(F.max("head").alias("head"))
    last = heads.agg(F.max("bucket")).first()[0] or 0
    facts = cells.select("_cell", "bucket").join(heads, "bucket")
    placed = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), cell.alias("_cell")).join(F.broadcast(facts), "_cell")
    before = F.when(F.col("bucket") == 0, F.lit(last)).otherwise(F.col("bucket") - 1)
    own = F.struct(F.col("bucket"), F.lit(0).alias("ahead"))
    places = F.when(F.col("key").eqNullSafe(F.col("head")), F.array(own, F.struct(before.alias("bucket"), F.lit(1).alias("ahead")))).otherwise(F.array(own))
    out = placed.select("key", "text", F.inline(places)).repartition("bucket")
    return out.sortWithinPartitions("bucket", "ahead", F.col("key").desc_nulls_last(), "text")


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint per row.

    The edited text replaces the last half of a text by the start of the next text in descending
    key order. Rows of a bucket are read in order, one text behind: nothing else is held.
    """
    fields = "key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # bucket, key, text, points, fingerprint
        for batch in batches:
            made = []
            for bucket, ahead, key_, body in zip(batch["bucket"], batch["ahead"], batch["key"], batch["text"]):
                if held is None and ahead:
                    continue
                points = code_points(body)
                own = fingerprint(points)
                if held is not None:
                    _, old_key, old, old_points, old_print = held
                    half = len(old_points) // 2
                    edited = old[: len(old) - half] + body[:half]
                    joined = np.concatenate([old_points[: len(old_points) - half], points[:half]])
                    made.append((old_key, len(old_points), hashlib.sha256(edited.encode()).hexdigest(), old_print, fingerprint(joined), own))
                held = None if ahead else (bucket, key_, body, points, own)
            if made:
                out = pd.DataFrame(made, columns=[x.split()[0] for x in fields.split(", ")])
                out["key"] = out["key"].astype("Int64")
                yield out

    return ranged(docs, key, text).mapInPandas(run, fields).withColumnRenamed("key", key)


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """with_edits plus near_edited and near_next."""
    made = with_edits(docs, key, text)
    return made.withColumns(
        {"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint"))}
    )
