"""Jaccard join of word shingles, size-aware: subsets for small sets, inverted lists for large ones.

Documents with equal shingle sets form one class and are joined once. Sets up to a boundary size meet
through fixed-size subsets: two sets of sizes s <= t link only if they share o(s, t) shingles, so both
emit all their subsets of that size (none where only equal sets reach it). Larger sets are scanned
through inverted lists of their prefix (the shingles among which a linked set must share one). The
boundary is the one with the least cost, counted over all sets: subsets to emit against list entries to
emit and scan. Prefixes follow one global order of shingles: those found frequent in a first scan last,
otherwise longest first.

Lists are never expanded into all pairs. In each list, members of like size are first compared with
one leader; links merge into components; only members that are still in different components are then
paired, and only where their places in the order leave room for enough common shingles. Members of long
lists are joined once more with rarest-first prefixes counted over those documents. Lists that stay long
hold near copies of one text that do not link with its leader: there each member is replaced by its
difference from the leader's set. Two members link only if their differences differ in few shingles, and
what the group has in common is in no difference, so prefixes of differences make short lists; where one
is still long, it gets leaders of its own, up to ROUNDS times. What can stay quadratic after that are
members of one list that are in different components although their places leave room for a link.
Every candidate is verified on the whole sets, so no link between different sets is lost or invented,
other than those implied by a component.

Null texts and texts without words have empty sets and are linked with nothing. Shingles are compared
by 58-bit hash. Rows may repeat, also with one id; a null id is never the smallest of a component that
has others. Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import itertools
import logging
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, scratch, stored
from .components import components
from .rolling import mixed, word_hashes

#: A shingle is frequent from so many prefixes on; frequent shingles come last in the global order. If
#: more than MOST_FREQUENT of them exist (8 bytes each go to every worker), none is moved, which changes
#: the cost and not the result.
FREQUENT, MOST_FREQUENT = 32, 1_000_000
#: Bits of a set's parity bitmap, 64 to a word; ids of candidate documents that may be broadcast.
BITS, MOST_CANDIDATES = 1024, 2_000_000
#: Members up to which a list is paired at once (between components): in the first passes, where each
#: entry then makes SHORT_LIST pairs at most, and among differences, where places decide. Longer lists get
#: leaders and differences, ROUNDS times at most; this changes the cost and not the result.
SHORT_LIST, LONG_LIST, ROUNDS = 64, 1000, 3

log = logging.getLogger(__name__)


def least_overlap(s: int, t: int, num: int, den: int) -> int:
    """Smallest o with o / (s + t - o) >= num / den."""
    return -(-num * (s + t) // (num + den))


def prefix_size(s: int, num: int, den: int) -> int:
    """Linked sets of a set of size s share one of its first s - ceil(s num / den) + 1 shingles."""
    return s - -(-num * s // den) + 1


def largest_partner(s: int, num: int, den: int) -> int:
    return den * s // num


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct shingle ids. The high bits hold (inverted) shingle length, so that ascending
    ids put long, rare shingles first: a fixed global order that needs no counting."""
    hashes, sizes = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        code, total = np.full(n, width, dtype=np.uint64), np.zeros(n, dtype=np.int64)
        for i in range(width):
            code = code * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
            total += sizes[i : i + n]
        code = mixed(code)
    rare = (31 - np.minimum(total // 2, 31)).astype(np.uint64)
    ids = np.sort(((rare << np.uint64(58)) | (code >> np.uint64(6))).view(np.int64))
    return ids[np.append(True, ids[1:] != ids[:-1])]


def prefix_of(ids: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """The prefix of a set in the global order: not frequent, then ascending id."""
    size = prefix_size(len(ids), num, den)
    if len(frequent):
        spot = np.minimum(np.searchsorted(frequent, ids), len(frequent) - 1)
        late = frequent[spot] == ids
        if late.any():
            ids = np.concatenate([ids[~late], ids[late]])
    return ids[:size]


def parity(ids: np.ndarray) -> np.ndarray:
    """Bitmap of a set: each shingle toggles one bit. Bits in which two bitmaps differ are at most as
    many as shingles in which the sets differ, so a pair with too many differing bits cannot link."""
    counts = np.bincount(ids & (BITS - 1), minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def frequent_shingles(docs: DataFrame, width: int, num: int, den: int) -> np.ndarray:
    """Sorted ids of shingles that stand in FREQUENT or more of the documents' leading shingles (half
    as many again as a prefix has). Counted over all documents; only the frequent ones are fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                leads = [np.zeros(0, np.int64)]
                for value in batch.column(0).slice(at, 1000):
                    ids = shingle_set(value.as_py() or "", width)
                    leads.append(ids[: 3 * prefix_size(len(ids), num, den) // 2])
                keys, count = np.unique(np.concatenate(leads), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(count, pa.int64())], ["key", "c"])

    counts = docs.select("text").mapInArrow(run, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))
    often = stored(counts.filter(F.col("c") >= FREQUENT).select("key"), "frequent")
    if often.count() > MOST_FREQUENT:
        return np.zeros(0, dtype=np.int64)
    return np.sort(often.toPandas()["key"].to_numpy(np.int64))


def shingle_sets(docs: DataFrame, width: int, num: int, den: int, frequent: np.ndarray | None = None) -> DataFrame:
    """doc_id, row (text hash), n, cls (64-bit id of the set, null if empty), ids: the whole set, or if
    ``frequent`` is given its prefix in the global order, and then ``marks`` (its parity bitmap)."""
    shared = None if frequent is None else docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts), pa.int64()))
        none = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, cls, kept, marks = [], [], [], []
                for value in part.column(2):
                    ids = shingle_set(value.as_py() or "", width)
                    n.append(len(ids))
                    cls.append(np.int64(xxhash.xxh3_64_intdigest(ids.tobytes()) - (1 << 63)) if len(ids) else None)
                    if shared is None:
                        kept.append(ids)
                    else:
                        kept.append(prefix_of(ids, shared.value, num, den) if len(ids) else none)
                        marks.append(parity(ids))
                columns = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), lists(kept)]
                names = ["doc_id", "row", "n", "cls", "ids"]
                if shared is not None:
                    columns, names = [*columns, lists(marks)], [*names, "marks"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    more = "" if frequent is None else ", marks array<bigint>"
    return rows.mapInArrow(run, f"doc_id bigint, row bigint, n bigint, cls bigint, ids array<bigint>{more}")


def size_pairs(n: int, boundary: int, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of sizes s <= t <= boundary, one of them n, that different sets may link at."""
    pairs = [(n, t) for t in range(n, min(boundary, largest_partner(n, num, den)) + 1)]
    pairs += [(s, n) for s in range(-(-num * n // den), n)]
    return [(s, t) for s, t in pairs if s < t or least_overlap(s, t, num, den) < t]


def subset_keys(small: DataFrame, boundary: int, num: int, den: int) -> DataFrame:
    """key, n, cls: a key for every subset of the size that two sets of the sizes in the key need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                keys, sizes, classes = [], [], []
                for n, cls, ids in zip(part["n"], part["cls"], part["ids"]):
                    hashed = [int(x) for x in mixed(np.array(ids, dtype=np.int64).view(np.uint64))]
                    whole = sum(hashed)
                    for s, t in size_pairs(n, boundary, num, den):
                        for out in itertools.combinations(hashed, n - least_overlap(s, t, num, den)):
                            keys.append(f"{s}:{t}:{(whole - sum(out)) & (1 << 64) - 1}")
                    sizes += [n] * (len(keys) - len(sizes))
                    classes += [cls] * (len(keys) - len(classes))
                if keys:
                    hashes = [xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in keys]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64())], ["key", "n", "cls"])

    return small.select("n", "cls", "ids").mapInArrow(run, "key bigint, n bigint, cls bigint")


def choose_boundary(tally: list[tuple[int, int, int]], num: int, den: int) -> tuple[int, int, int]:
    """(boundary, cost without subsets, least cost) from (size, sets, list entries scanned by them): the
    size up to which subsets in total cost least. A subset, a prefix entry and an entry scanned cost one
    row each. Sizes at which one set has more subsets than all lists have rows are never worth it."""
    lists_only = sum(sets * prefix_size(n, num, den) + scanned for n, sets, scanned in tally)
    best, best_gain, gain = 0, 0, 0
    for n, sets, scanned in sorted(tally):
        subsets = 0
        for s, t in size_pairs(n, largest_partner(n, num, den), num, den):
            subsets += comb(n, least_overlap(s, t, num, den))
            if subsets > lists_only:
                return best, lists_only, lists_only - best_gain
        gain += sets * prefix_size(n, num, den) + scanned - sets * subsets
        if gain > best_gain:
            best, best_gain = n, gain
    return best, lists_only, lists_only - best_gain


class _Join:
    """The steps that share a threshold, the documents and the classes (cls, n, marks, rep)."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> None:
        self.docs, self.classes, self.width, self.num, self.den = docs, classes, width, num, den

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """cls, n, ids (whole sets) of classes ``wanted`` (cls), from their first documents' texts."""
        reps = stored(self.classes.join(wanted.distinct(), "cls").select(F.col("rep").alias("_rep")).distinct(), "candidates")
        few = F.broadcast(reps) if reps.count() <= MOST_CANDIDATES else reps
        chosen = self.docs.select("doc_id", "text").join(few, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
        sets = stored(shingle_sets(chosen, self.width, self.num, self.den).filter("n > 0").select("cls", "n", "ids"), "sets")
        if sets.count() > sets.select("cls").distinct().count():  # rows that repeat
            sets = stored(sets.dropDuplicates(["cls"]), "sets")
        return sets

    def verified(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """(a, b) of those pairs of classes that link: bitmaps first, then whole sets (``sets`` or, if
        none are given, read from the documents)."""
        left = self.classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("marks").alias("x"))
        right = self.classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("y"))
        differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        marked = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
        near = stored(marked.filter((self.den + self.num) * differ <= (self.den - self.num) * (F.col("na") + F.col("nb"))).select("a", "b"), "pairs")
        if near.isEmpty():
            return near
        own = self.sets_of(near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls")))) if sets is None else sets
        left = own.select(F.col("cls").alias("a"), F.col("ids").alias("x"))
        right = own.select(F.col("cls").alias("b"), F.col("ids").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        both = near.join(left, "a").join(right, "b")
        links = stored(both.filter(self.den * common >= self.num * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")
        dropped(near, *([own] if sets is None else []))
        return links

    def banded(self, lists: DataFrame) -> DataFrame:
        """Members of linked sets are in the same size band or in neighbouring ones."""
        return lists.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(self.den / self.num)) + F.lit(1e-9)))

    def led(self, lists: DataFrame) -> DataFrame:
        """(a, b): each member of a list with the leader of its size band: the one whose prefix is
        most shared, which is the likeliest hub of a group of near copies."""
        banded = self.banded(lists)
        leaders = banded.groupBy("key", "band").agg(F.max(F.struct("shared", "cls", "n")).alias("lead"), F.count("*").alias("many")).filter("many > 1")
        pairs = banded.join(leaders, ["key", "band"]).filter(F.col("cls") != F.col("lead.cls"))
        pairs = pairs.filter(self.den * F.least("n", "lead.n") >= self.num * F.greatest("n", "lead.n"))
        return pairs.select(F.col("lead.cls").alias("a"), F.col("cls").alias("b"))

    def placed(self, lists: DataFrame) -> DataFrame:
        """(a, b): members of one list that are in different components and whose sizes and places allow
        a link. A set of size m with a common shingle at place i has at most m - i more of them."""
        left = lists.select("key", *(F.col(c).alias(f"{c}_a") for c in ("cls", "n", "m", "place", "root")))
        right = lists.select("key", *(F.col(c).alias(f"{c}_b") for c in ("cls", "n", "m", "place", "root")))
        apart = F.floor((self.den - self.num) * (F.col("n_a") + F.col("n_b")) / (self.den + self.num))
        room = 2 * (1 + F.least(F.col("m_a") - F.col("place_a"), F.col("m_b") - F.col("place_b"))) >= F.col("m_a") + F.col("m_b") - apart
        fits = self.den * F.least("n_a", "n_b") >= self.num * F.greatest("n_a", "n_b")
        on = (left["key"] == right["key"]) & (F.col("cls_a") < F.col("cls_b")) & (F.col("root_a") != F.col("root_b")) & fits & room
        return left.join(right, on).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()

    def differences(self, lists: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(lists, pairs): lists of prefixes of differences, and each leader with members of the next band.

        Members of a band and of the next one are taken against the band's leader, so that any two that
        can link share a leader. With D(x) the difference of x from it, x and y link only if D(x) and D(y)
        differ in k(x, y) shingles at most. If D(x) and D(y) together have no more than k, both link with
        the leader. Otherwise they share a shingle among the first n (1 - t) / t + 1 of each, in one order.
        """
        banded = self.banded(lists)
        leaders = banded.groupBy("key", F.col("band").alias("at")).agg(F.max(F.struct("shared", "cls")).alias("lead"))
        either = banded.select("key", "cls", "n", F.explode(F.array("band", F.col("band") - 1)).alias("at"))
        members = either.join(leaders, ["key", "at"]).select(F.col("lead.cls").alias("lead"), "cls", "n").filter("cls <> lead").distinct()
        of_lead = sets.select(F.col("cls").alias("lead"), F.col("n").alias("_n"), F.col("ids").alias("_y"))
        both = members.join(of_lead, "lead").join(sets.select("cls", F.col("ids").alias("_x")), "cls")
        own = both.select("lead", "cls", "n", "_n", F.concat(F.array_except("_x", "_y"), F.array_except("_y", "_x")).alias("own"))
        own = stored(own, "differences")
        entries = own.select("lead", "cls", "n", F.size("own").alias("m"), F.explode("own").alias("_s")).withColumn("key", F.xxhash64("lead", "_s"))
        counts = entries.groupBy("key").agg(F.count("*").alias("df"))
        order = Window.partitionBy("lead", "cls").orderBy("df", "key")
        ranked = entries.join(counts, "key").withColumn("place", F.row_number().over(order))
        most = F.floor(F.col("n") * (self.den - self.num) / self.num) + 1
        made = stored(ranked.filter((F.col("place") <= most) & (F.col("df") > 1)).select("key", "cls", "n", "m", "place", "df", (-F.col("m")).alias("shared")), "difference-lists")
        beside = own.filter(self.den * F.least("n", "_n") >= self.num * F.greatest("n", "_n")).select(F.col("lead").alias("a"), F.col("cls").alias("b"))
        return made, beside


def _edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of what ``roots`` has joined and ``links`` join further."""
    return roots if links.isEmpty() else components(_edges(roots).unionByName(links))


def _rooted(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Lists with each member's root; lists within one component are left out."""
    out = lists.join(roots, lists["cls"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "cls"))
    mixed_lists = out.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("key")
    return out.join(mixed_lists, "key")


def linked_classes(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(sets, links): doc_id, row, n, cls of every row of ``docs`` (doc_id, text); and edges (a, b) between
    classes whose components are those of all links. Jaccard similarity num / den or more links."""
    frequent = frequent_shingles(docs, width, num, den)
    first = stored(shingle_sets(docs, width, num, den, frequent), "prefixes")
    members = stored(first.select("doc_id", "row", "n", "cls"), "members")
    alike = (F.first(c).alias(c) for c in ("n", "ids", "marks"))
    classes = stored(first.filter("n > 0").groupBy("cls").agg(*alike, F.min("doc_id").alias("rep")), "classes")
    dropped(first)
    step = _Join(docs, classes.select("cls", "n", "marks", "rep"), width, num, den)
    entries = classes.select("cls", "n", F.posexplode("ids").alias("place", "key")).withColumn("place", F.col("place") + 1)
    counts = entries.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    all_lists = stored(entries.join(counts, "key"), "lists")
    scanned = all_lists.groupBy("n").agg(F.sum("df").alias("scanned"))
    tally = classes.groupBy("n").agg(F.count("*").alias("sets")).join(scanned, "n", "left").select("n", "sets", F.coalesce("scanned", F.lit(0)))
    boundary, *costs = choose_boundary([tuple(r) for r in tally.collect()], num, den)  # one row a size
    log.info("sets up to %d meet through subsets: cost %d by lists alone, %d with subsets", boundary, *costs)
    by_subset, lists = None, all_lists
    if boundary:
        if any(size_pairs(n, boundary, num, den) for n in range(1, boundary + 1)):
            small = step.sets_of(classes.filter(F.col("n") <= boundary).select("cls")).filter(F.col("n") <= boundary)
            keys = subset_keys(small, boundary, num, den)
            hubs = keys.groupBy("key").agg(F.min(F.struct("n", "cls")).alias("lead"), F.count("*").alias("many")).filter("many > 1")
            by_subset = stored(keys.join(hubs, "key").filter("cls <> lead.cls").select(F.col("lead.cls").alias("a"), F.col("cls").alias("b")).distinct(), "subset-pairs")
        lists = lists.filter(F.col("n") * den > boundary * num)
    shared = lists.groupBy("cls").agg((F.count("*") / F.max("n")).alias("shared"))
    lists = stored(lists.join(shared, "cls").withColumn("m", F.col("n")), "lists")
    pairs = step.led(lists)
    if by_subset is not None:
        pairs = pairs.unionByName(by_subset)
    roots = components(step.verified(pairs))
    open_lists = stored(_rooted(lists, roots), "open-lists")
    dropped(lists, all_lists)
    links = step.verified(step.placed(open_lists.filter(F.col("df") <= SHORT_LIST)))

    crowded = open_lists.filter(F.col("df") > SHORT_LIST).select("cls").distinct()
    if crowded.isEmpty():
        return members, _edges(roots).unionByName(links)
    return members, _rarest_first(step, crowded, roots, links)


def _rarest_first(step: _Join, crowded: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """Edges of ``roots``, ``links`` and the links among ``crowded`` classes, by prefixes in order of document frequency among
    them and, where lists stay long, by differences from leaders."""
    own = stored(step.sets_of(crowded).join(crowded, "cls", "left_semi"), "crowd")
    all_entries = own.select("cls", "n", F.explode("ids").alias("key"))
    counts = all_entries.groupBy("key").agg(F.count("*").alias("df"))
    order = Window.partitionBy("cls").orderBy("df", "key")
    ranked = all_entries.join(counts, "key").withColumn("place", F.row_number().over(order))
    ranked = ranked.withColumn("shared", F.count_if(F.col("df") > 1).over(Window.partitionBy("cls")) / F.col("n"))
    first = F.col("n") - F.ceil(F.col("n") * step.num / step.den) + 1
    lists = ranked.filter((F.col("place") <= first) & (F.col("df") > 1)).select("key", "cls", "n", F.col("n").alias("m"), "place", "df", "shared")
    most = SHORT_LIST
    for turn in range(ROUNDS + 1):
        lists = stored(lists, "crowd-lists")
        roots = _merged(roots, links.unionByName(step.verified(step.led(lists), own)))
        rest = stored(_rooted(lists, roots), "crowd-open")
        small = rest if turn == ROUNDS else rest.filter(F.col("df") <= most)
        links = step.verified(step.placed(small), own)
        rest = rest.filter(F.col("df") > most)
        if turn == ROUNDS or rest.isEmpty():
            break
        lists, beside = step.differences(rest, own)
        links = links.unionByName(step.verified(beside, own))
        most = LONG_LIST
    return _edges(roots).unionByName(links)


def membership(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, row (text hash), n_shingles, component_id, keeper (least (id, row) of the component) for
    each row of ``docs``; sets without shingles are components of their own."""
    with scratch(docs.sparkSession) as kept:
        sets, links = linked_classes(docs, width, num, den)
        roots = components(links)
        own = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.col("row").alias("row")))
        least = sets.filter("n > 0").groupBy("cls").agg(own.alias("own"))
        least = least.join(roots, least["cls"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "cls"))
        tops = least.groupBy("root").agg(F.min("own").alias("keeper"))
        named = least.join(tops, "root").select("cls", "keeper")
        out = sets.join(named, "cls", "left").withColumnRenamed("n", "n_shingles")
        top = F.when(F.col("keeper.id") < 2**63 - 1, F.col("keeper.id"))
        return kept(out.withColumn("component_id", F.coalesce(top, "doc_id")).drop("cls"), "membership")


def near_copies(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for each row of ``docs``."""
    return membership(docs, width, num, den).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id (ties: text hash; of exact
    repeats of a row one stays). Rows without words all stay. Columns unchanged."""
    with scratch(docs.sparkSession) as kept:
        found = membership(docs, width, num, den)
        here = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.col("row").alias("row"))
        stay = found.filter((F.col("n_shingles") == 0) | (here == F.col("keeper")))
        stay = kept(stay.groupBy("doc_id", "row").agg(F.count_if(F.col("n_shingles") > 0).alias("times")), "kept-ids")
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64("text").alias("row"))

    def chosen(ids: DataFrame) -> DataFrame:
        named = ids.select(F.struct("doc_id", "row").alias("own"))
        return rows.join(named, F.col("doc.doc_id").eqNullSafe(F.col("own.doc_id")) & (F.col("row") == F.col("own.row")), "left_semi").select("doc.*")

    once, repeated = stay.filter("times <= 1"), stay.filter("times > 1")
    return chosen(once) if repeated.isEmpty() else chosen(once).unionByName(chosen(repeated).dropDuplicates(["doc_id", "text"]))
