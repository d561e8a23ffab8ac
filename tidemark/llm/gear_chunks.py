"""Substring dedup by content-defined chunks of a gear rolling hash.

A boundary stands at the greatest gear hash (the last one of equals) of every SPREAD positions, so
boundaries depend on near text only and are never more than SPREAD apart, in periodic text too. A passage
of MIN_RUN code points holds a boundary together with the GRAM code points that its hash covers, wherever
it stands, so copies of it meet on a digest of these. A chunk reaches from one boundary's code points to
the next one's. The occurrence that comes first (by document id, row and start) is kept; every later one,
in other documents or in the same text, is a repeat. Repeats whose chunks have the digest of the first
occurrence's chunk join into runs without reading text. Only the two ends of a run are compared code
point by code point with the text around their first occurrence, so that spans end where the texts part.
Overlapping or adjacent runs are merged, and those of MIN_RUN code points or more are reported.

A boundary is compared with the first occurrence of its code points only. Where that occurrence is a
shorter match than a later one, a passage can be missed if none of its other boundaries leads to the
longer match. Inside a run a chunk is taken as equal by two 64-bit digests.

Null and empty texts have no spans. Rows that share a document id are rows of their own; of rows equal in
id and text, all but one are reported whole. Null ids come last and are reported as null. Empty tables
give empty results. Only the id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored
from .rolling import code_points, gear, gram_hashes, last_maxima, peaks, piece_hashes

REACH, MIN_RUN = 16, 100
#: Code points that a gear hash covers, and positions of which one is a boundary.
GRAM = 32
SPREAD = MIN_RUN - GRAM + 1
LAST = 2**63 - 1


def cuts(points: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Exclusive ends of the chunks of a text."""
    if not len(points):
        return np.zeros(0, dtype=np.int64)
    found = peaks(gear(points), reach) + 1
    return found if len(found) and found[-1] == len(points) else np.append(found, len(points))


def marks(points: np.ndarray, min_run: int = MIN_RUN) -> np.ndarray:
    """Starts of the GRAM code points before each boundary; every ``min_run`` code points hold one whole."""
    if len(points) < min_run:
        return np.zeros(0, dtype=np.int64)
    return last_maxima(gear(points)[GRAM - 1 :], min_run - GRAM + 1)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key), F.lit(LAST)).alias("doc"), F.xxhash64(key, text).alias("row"), F.col(text).alias("text"))


def boundaries(rows: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """doc, row, start, next, digest, link, own: every boundary of every whole text with the digests of its
    GRAM code points (from ``start``) and of what lies from there to the next boundary (``next``, or -1).
    Where the digest stands earlier in the same text, ``own`` is its first start there (else -1), and
    ``link`` says whether what follows is the same (1 or 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc", "row", "start", "next", "digest", "link", "own"], (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, np.int32)
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in names]
            for doc, row, value in zip(*(batch.column(i) for i in range(3))):
                points = code_points(value.as_py() or "")
                at = marks(points, min_run)
                if len(at):
                    following = np.append(at[1:], -1)
                    between = np.append(piece_hashes(points[: at[-1]], at)[1:], 0)
                    digest, link = gram_hashes(points, at, GRAM).view(np.int64), between.view(np.int64)
                    _, heads, which = np.unique(digest, return_index=True, return_inverse=True)
                    first = heads[which]
                    again = first != np.arange(len(at))
                    link = np.where(again, (link == link[first]) & (following >= 0), link)
                    made = (np.full(len(at), doc.as_py()), np.full(len(at), row.as_py()), at, following, digest, link, np.where(again, at[first], -1))
                    for part, x, kind in zip(parts, made, kinds):
                        part.append(x.astype(kind))
            if parts[0]:
                whole = pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)) for part in parts], names)
                for at in range(0, whole.num_rows, 100_000):
                    yield whole.slice(at, 100_000)

    return rows.select("doc", "row", "text").mapInArrow(run, "doc bigint, row bigint, start int, next int, digest bigint, link bigint, own int")


_RUN = "row bigint, s int, l int, firsts array<bigint>, s_row bigint, s_at int, l_row bigint, l_at int"


def _runs(matched: DataFrame) -> DataFrame:
    """Runs of each row from its matched boundaries: first and last start (``s``, ``l``), and where the code
    points of each occur first. ``matched`` has row and pairs (one per matched boundary of the row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            start, after, linked, first, first_row, first_start = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
            by = np.lexsort((start, owner))
            owner, start, after, linked, first, first_row, first_start = (x[by] for x in (owner, start, after, linked, first, first_row, first_start))
            goes_on = linked[:-1] & (owner[1:] == owner[:-1]) & (start[1:] == after[:-1])
            heads = np.flatnonzero(np.append(True, ~goes_on))
            tails = np.append(heads[1:] - 1, len(start) - 1)
            number = np.cumsum(np.append(0, ~goes_on))
            sets = np.lexsort((first, number))
            number, first = number[sets], first[sets]
            new = np.append(True, (number[1:] != number[:-1]) | (first[1:] != first[:-1]))
            ends = np.append(0, np.cumsum(np.bincount(number[new], minlength=len(heads))))
            firsts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(first[new], pa.int64()))
            rows = batch.column(0).take(pa.array(owner[heads]))
            columns = (start[heads], start[tails], first_row[heads], first_start[heads], first_row[tails], first_start[tails])
            s, l, s_row, s_at, l_row, l_at = map(pa.array, columns)  # noqa: E741
            yield pa.RecordBatch.from_arrays([rows, s, l, firsts, s_row, s_at, l_row, l_at], ["row", "s", "l", "firsts", "s_row", "s_at", "l_row", "l_at"])

    return matched.select("row", "pairs").mapInArrow(run, _RUN)


_PIECE = "own boolean, doc bigint, row bigint, s int, firsts array<bigint>, left boolean, there_row bigint, there_at int, at int, lead int, near string"


def _pieces(wanted: DataFrame, side: int) -> DataFrame:
    """Text around places of rows, whose code points stand at ``lead`` of ``near``: one piece for every
    end of a run of the row (``own``), and one for every place that ends of any row are compared with
    (then ``there_row`` and ``there_at`` are that place)."""
    schema = pa.schema([("own", pa.bool_()), ("doc", pa.int64()), ("row", pa.int64()), ("s", pa.int32()), ("firsts", pa.list_(pa.int64())), ("left", pa.bool_()), ("there_row", pa.int64()), ("there_at", pa.int32()), ("at", pa.int32()), ("lead", pa.int32()), ("near", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for doc, row, text, ends, spots in zip(*batch.columns):
                body, doc_, row_ = text.as_py(), doc.as_py(), row.as_py()
                for e in ends.as_py() or []:
                    near = body[max(0, e["at"] - side) : e["at"] + GRAM] if e["left"] else body[e["at"] : e["at"] + GRAM + side]
                    out.append(e | {"own": True, "doc": doc_, "row": row_, "lead": min(e["at"], side) if e["left"] else 0, "near": near})
                for at in spots.as_py() or []:
                    out.append({"own": False, "there_row": row_, "there_at": at, "lead": min(at, side), "near": body[max(0, at - side) : at + GRAM + side]})
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return wanted.select("doc", "row", "text", "ends", "spots").mapInArrow(run, _PIECE)


def _alike(a: str, b: str) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def grown(own: str, lead: int, theirs: str, lead_there: int) -> tuple[int, int]:
    """How far two texts agree to the left and to the right of the GRAM code points at ``lead`` and
    ``lead_there``; (-1, -1) if these differ. Where they recur in ``theirs``, as in periodic text, the
    furthest counts: boundaries of periodic passages can meet a few periods out of step."""
    gram = own[lead : lead + GRAM]
    if theirs[lead_there : lead_there + GRAM] != gram:
        return -1, -1
    before, after, left, right, at = own[:lead][::-1], own[lead + GRAM :], 0, 0, lead_there
    while at >= 0:
        left = max(left, _alike(before, theirs[:at][::-1]))
        right = max(right, _alike(after, theirs[at + GRAM :]))
        at = theirs.find(gram, at + 1)
    return left, right


def _ended(ends: DataFrame) -> DataFrame:
    """doc, row, s, firsts, start (of left ends) or end (of right ends) where the texts part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["at", "left", "lead", "near", "lead_there", "there"]).to_pydict()
            start, end = [], []
            for at, is_left, lead, near, lead_there, there in zip(*rows.values()):
                left, right = grown(near, lead, there, lead_there)
                start.append(at - left if is_left and left >= 0 else None)
                end.append(at + GRAM + right if not is_left and right >= 0 else None)
            kept = [batch.column(n) for n in ("doc", "row", "s", "firsts")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["doc", "row", "s", "firsts", "start", "end"])

    return ends.mapInArrow(run, "doc bigint, row bigint, s int, firsts array<bigint>, start int, end int")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """Spans that occur before: key, row (hash of key and text), copy, start, end, n_chars, first_doc_ids.

    One row per maximal run; ``first_doc_ids`` are the documents that keep its parts. ``copy`` numbers rows
    equal in key and text. The joins on the digest and on the first occurrence are inner joins, which
    Spark can split where very many rows share one. Texts move once, by their row; the text around each
    wanted boundary is cut out once, however many runs ask for it. Runs are merged inside one row.
    """
    with scratch(docs.sparkSession) as kept:
        rows = _rows(docs, key, text)
        # repeats inside one text need no partner: they are spread, so that a digest has one row a text at most
        spread = F.when(F.col("own") >= 0, F.col("start")).otherwise(-1)
        made = boundaries(rows, min_run).withColumn("spread", spread).repartition("digest", "spread")
        here, again = F.struct("doc", "row", "start", "next", "link", "own"), F.col("own") >= 0
        shared = made.groupBy("digest", "spread").agg(F.min(here).alias("f"), F.count("*").alias("many")).filter("many > 1 or spread >= 0").select("digest", "spread", "f")
        later = made.join(shared, ["digest", "spread"]).filter(again | (F.col("doc") != F.col("f.doc")) | (F.col("row") != F.col("f.row")) | (F.col("start") != F.col("f.start")))
        linked = F.when(again, F.col("link") == 1).otherwise((F.col("next") >= 0) & (F.col("link") == F.col("f.link")))
        first = lambda own, other, name: F.when(again, F.col(own)).otherwise(F.col(other)).alias(name)
        pair = F.struct("start", "next", linked.alias("linked"), first("doc", "f.doc", "first"), first("row", "f.row", "first_row"), first("own", "f.start", "first_start"))
        runs = stored(_runs(later.groupBy("row").agg(F.collect_set(pair).alias("pairs"))), "runs")
        end = lambda left, at, r, a: F.struct(F.lit(left).alias("left"), F.col(at).alias("at"), "s", "firsts", F.col(r).alias("there_row"), F.col(a).alias("there_at"))
        ends = runs.select("row", F.explode(F.array(end(True, "s", "s_row", "s_at"), end(False, "l", "l_row", "l_at"))).alias("end"))
        spots = runs.select(F.inline(F.array(*(F.struct(F.col(f"{x}_row").alias("row"), F.col(f"{x}_at").alias("spot")) for x in "sl")))).distinct()
        asked = ends.unionByName(spots, allowMissingColumns=True).groupBy("row").agg(F.collect_list("end").alias("ends"), F.collect_set("spot").alias("spots"))
        pieces = stored(_pieces(rows.join(asked, "row"), min_run - GRAM), "pieces")
        there = pieces.filter("not own").select("there_row", "there_at", F.col("lead").alias("lead_there"), F.col("near").alias("there"))
        lost = _ended(pieces.filter("own").join(there, ["there_row", "there_at"]))
        lost = lost.groupBy("doc", "row", "s").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("firsts").alias("firsts")).filter("start is not null and end is not null")
        along = Window.partitionBy("doc", "row").orderBy("start", "end")
        lost = lost.withColumn("_new", F.when(F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("start"), 0).otherwise(1))
        lost = lost.withColumn("_run", F.sum("_new").over(along))
        spans = lost.groupBy("doc", "row", "_run").agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("firsts")))).alias("first_doc_ids")
        )
        spans = spans.withColumn("copy", F.lit(0)).select("doc", "row", "copy", "start", "end", "first_doc_ids")
        equal = rows.groupBy("doc", "row").agg(F.count("*").cast("int").alias("n"), F.max(F.length("text")).alias("end")).filter("n > 1")
        equal = equal.select("doc", "row", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("copy"), F.lit(0).alias("start"), "end", F.array("doc").alias("first_doc_ids"))
        spans = spans.unionByName(equal).withColumn("n_chars", F.col("end") - F.col("start")).filter(F.col("n_chars") >= min_run)
        named = lambda x: F.when(x < LAST, x)
        return kept(spans.select(named(F.col("doc")).alias(key), "row", "copy", "start", "end", "n_chars", F.transform("first_doc_ids", named).alias("first_doc_ids")), "spans")


def without_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of their texts; other columns unchanged."""
    own = spans.groupBy("row", "copy").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    body = F.col(f"doc.{text}")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda i: F.substring(
            body,
            F.coalesce(F.get("spans", i - 1)["end"], F.lit(0)) + 1,
            F.coalesce(F.get("spans", i)["start"], F.length(body)) - F.coalesce(F.get("spans", i - 1)["end"], F.lit(0)),
        ),
    )
    numbered = docs.select(F.xxhash64(key, text).alias("row"), F.struct("*").alias("doc"))
    numbered = numbered.withColumn("copy", F.row_number().over(Window.partitionBy("row").orderBy(F.lit(0))) - 1)
    left = F.when(F.col("spans").isNull(), body).otherwise(F.array_join(pieces, ""))
    return numbered.join(own, ["row", "copy"], "left").withColumn("doc", F.col("doc").withField(text, left)).select("doc.*")
