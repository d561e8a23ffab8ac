"""Product codes of vectors; the nearest codebook entry is found by a geometric near-neighbour tree (GNAT).

Components become integers floor(256 * x), and vectors are cut into 16 equal consecutive parts. Each part
position has a codebook: at first that part of the 64 vectors with the smallest ids, then, in each round, the
componentwise floor of the mean of the parts nearest to an entry (an entry without parts stays).

A tree over the entries of a codebook has up to eight split points a node; every other entry belongs to its
nearest split point. For each pair (split point, child) the node stores the range of distances from the split
point to the child's entries. A query measures split points one after another; with r its best distance so
far, a child whose range lies strictly outside [d - r, d + r] of any measured split point cannot hold an entry
as near as the best one, and is left out whole, unmeasured split point included. Ranges and distances are
square roots rounded outwards, so nothing within reach is left out; entries that are measured are compared by
integer squared distances, and equal ones by index.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors of another length than
the first kept one (by id), or of a length that 16 does not divide, stay with a null code and error and take
no part in codebooks. A null id sorts last; rows of one id sort by vector. Components so large that errors
could pass a long raise OverflowError. Empty tables give empty results. Repeated vectors count as often as
they occur. Columns other than vec_id, embedding and label are not read.

At scale: vectors are not shuffled. A round scans them and sums parts inside each task; what is shuffled is
one row per part position, entry and component for each task, what comes to the driver is one for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, with_facts

PARTS, ENTRIES, ROUNDS = 16, 64, 2
ARITY, LEAF = 8, 4
#: Relative slack of a rounded square root: more than its own and the sums' rounding errors.
SLACK = 2.0**-50


def _squares(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    away = points - entry
    return np.einsum("ij,ij->i", away, away)


def _down(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float)) * (1 - SLACK)


def _up(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float)) * (1 + SLACK)


class Gnat:
    """Nearest entry of one codebook: rows of int64, ties to the lower row."""

    def __init__(self, entries: np.ndarray, members: np.ndarray | None = None):
        self.entries = entries
        members = np.arange(len(entries)) if members is None else members
        if len(members) <= LEAF:
            self.splits, self.children = members, []
            return
        spots, reach = [members[0]], _squares(entries[members], entries[members[0]])
        while len(spots) < ARITY and reach.max() > 0:
            spots.append(members[int(reach.argmax())])
            reach = np.minimum(reach, _squares(entries[members], entries[spots[-1]]))
        if len(spots) == 1:  # all entries are equal: the lowest stands for them
            self.splits, self.children = members[:1], []
            return
        self.splits = np.array(spots)
        away = np.array([_squares(entries[members], entries[s]) for s in spots])
        owner = away.argmin(axis=0)
        self.low, self.high = np.empty(2 * (len(spots),)), np.empty(2 * (len(spots),))
        self.children = []
        for child, spot in enumerate(spots):
            mine = owner == child
            self.low[:, child], self.high[:, child] = _down(away[:, mine].min(axis=1)), _up(away[:, mine].max(axis=1))
            rest = members[mine & (members != spot)]
            self.children.append(Gnat(entries, rest) if len(rest) else None)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of each point's nearest entry, and how many distances were measured."""
        best, who = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(self.entries))
        measured = self._visit(points, np.arange(len(points)), best, who)
        return who, best, measured

    def _visit(self, points: np.ndarray, rows: np.ndarray, best: np.ndarray, who: np.ndarray) -> int:
        alive, measured = np.ones((len(rows), len(self.splits)), bool), 0
        for i, spot in enumerate(self.splits):
            at = np.flatnonzero(alive[:, i])
            mine = rows[at]
            squares = _squares(points[mine], self.entries[spot])
            measured += len(at)
            nearer = (squares < best[mine]) | ((squares == best[mine]) & (spot < who[mine]))
            best[mine[nearer]], who[mine[nearer]] = squares[nearer], spot
            if self.children:
                reach = _up(best[mine])[:, None]
                outside = (_down(squares)[:, None] - reach > self.high[i]) | (_up(squares)[:, None] + reach < self.low[i])
                outside[:, i] = False if self.children[i] is None else outside[:, i]
                alive[at] &= ~outside
        for i, child in enumerate(self.children):
            mine = rows[alive[:, i]]
            if child is not None and len(mine):
                measured += child._visit(points, mine, best, who)
        return measured


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole(values: np.ndarray, length: int) -> np.ndarray:
    """Rows of integers floor(256 * x)."""
    made = np.floor(256.0 * values.astype(float)).reshape(-1, length)
    if made.size and 4 * float(np.abs(made).max()) ** 2 * length >= 2.0**63:
        raise OverflowError("components too large: the error of a vector would pass a long")
    return made.astype(np.int64)


def _parts(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """(rows, PARTS, components) of the vectors of a batch that are not null."""
    vectors = batch.column(batch.schema.get_field_index("vector"))
    return whole(vectors.flatten().to_numpy(zero_copy_only=False), length).reshape(-1, PARTS, length // PARTS)


def _coded(parts: np.ndarray, trees: list[Gnat]) -> tuple[np.ndarray, np.ndarray]:
    found = [tree.nearest(np.ascontiguousarray(parts[:, p]))[:2] for p, tree in enumerate(trees)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def means(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (PARTS, entries, components) after one round over ``vector`` of ``vectors``."""
    length = books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in books]
        sums, used = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            parts = _parts(batch, length)
            codes, _ = _coded(parts, trees)
            for p in range(PARTS):
                np.add.at(sums[p], codes[:, p], parts[:, p])
                used[p] += np.bincount(codes[:, p], minlength=books.shape[1])
        p, e, c = (axis.ravel() for axis in np.indices(sums.shape))
        there = used[p, e] > 0
        yield pa.RecordBatch.from_pydict({"p": p[there].astype(np.int32), "e": e[there].astype(np.int32), "c": c[there].astype(np.int32), "total": sums.ravel()[there], "n": used[p, e][there]})

    made = vectors.select("vector").mapInArrow(run, "p int, e int, c int, total bigint, n bigint").groupBy("p", "e", "c").agg(F.sum("total"), F.sum("n"))
    out = books.copy()
    for p, e, c, total, n in made.collect():  # at most one row a component of the codebooks
        out[p, e, c] = total // n
    return out


def codes(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept row."""
    kept = rows.filter(finite(F.col("embedding"))).select("vec_id", "label", F.col("embedding").alias("vector"))
    first = [r["vector"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()]
    length = len(first[0]) if first else 0
    first = [v for v in first if len(v) == length]
    fits = (F.size("vector") == length) & F.lit(length % PARTS == 0 and length > 0)
    books = np.zeros((PARTS, len(first), 0), np.int64)
    if length and length % PARTS == 0:
        books = whole(np.array(first, float).ravel(), length).reshape(-1, PARTS, length // PARTS).transpose(1, 0, 2)
        for _ in range(rounds):
            books = means(kept.filter(fits), books)
    books = np.ascontiguousarray(books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in books]
        for batch in batches:
            there = np.asarray(batch.column(2).is_valid())
            code, error = np.full(len(there), None, object), np.full(len(there), None, object)
            if there.any():
                found, squares = _coded(_parts(batch, length), trees)
                code[there] = [row.tobytes().hex() for row in found.astype(np.uint8)]
                error[there] = squares.sum(axis=1)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "label": batch.column(1), "code": pa.array(code, pa.string()), "error": pa.array(error, pa.int64())})

    shape = kept.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    with scratch(rows.sparkSession) as keep:
        made = keep(kept.select("vec_id", "label", F.when(fits, F.col("vector")).alias("vector")).mapInArrow(run, shape), "codes")
        out = with_facts(made, made.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), ["label"], ["label_error"])
        return keep(out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), "coded")
