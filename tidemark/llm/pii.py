"""Personal data: base patterns, and bootstrapped contextual extraction of further identifiers.

Base spans (email, ip, card, phone) are the seeds. Around seeds and around other identifier-like
tokens, lexical patterns are taken: neighbouring words, the token's own prefix and its shape. Spark
holds the graph of (pattern, instance) edges and scores it in rounds: a pattern by the share of its
instances that are trusted, an instance by the best of its patterns; instances above a threshold are
trusted in the next round, so that patterns they share (a prefix such as a key's name) are learned
too. Instances trusted at the end are found spans, wherever their value occurs.

Identifiers that do not look like one (names, user names, "ann at mail dot com") are found by where they
stand: the word before and the word after trusted values are a frame, and so are two words before and one
after; whatever run of up to MOST_TOKENS tokens fills a frame anywhere is a
candidate. A frame is trusted as a pattern is, but by occurrences and against all its fillers, so
frames of everyday words are not; fillers of trusted frames are found spans there (not elsewhere, as a name may
be a common word). Frames of over 200 code points propose nothing.

Null and empty texts have no spans. Repeated rows get equal spans each. An empty table gives an empty
result. Extra columns are not read by ``personal_spans``; ``redacted`` keeps them.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, with_facts

#: Base kinds in the order in which spans are listed; ``found`` follows them.
KINDS = ("email", "ip", "card", "phone")
FOUND = "found"
#: A pattern is trusted from this share of trusted instances (with one pseudo-instance against it),
#: an instance from this score; patterns need so many distinct trusted instances.
MIN_TRUST, MIN_SUPPORT = 0.8, 5
#: Rounds run until no new value is trusted; beyond so many the query fails rather than stop short.
MOST_ROUNDS = 100
#: Tokens of a filler of a frame, and bits of the map of frames that workers get (2 MB at any size).
MOST_TOKENS, MAP_BITS = 5, 24

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?()[]{}<>\"'"

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each ``@`` outwards in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans in order of kind, then start; offsets in code points, end exclusive."""
    out: list[Span] = [("email", *x) for x in emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def shape(token: str) -> str:
    """Classes of characters in a token, runs folded, and its length on a log scale."""
    folded = re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", re.sub(r"[0-9]+", "9", token)))
    return whole("".join(sorted(set(folded)))) + str(len(token).bit_length())


def whole(text: str, most: int = 200) -> str:
    """``text``, or where it is long its start with a hash of all of it: unequal texts stay unequal."""
    return text if len(text) <= most else text[:most] + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def instances(text: str, base: list[Span]) -> list[tuple[int, int, str, bool, list[str]]]:
    """(start, end, value, is a seed, patterns) of base spans and of identifier-like tokens beside them."""
    if not base and not _DIGIT.search(text):
        return []
    words = [m.span() for m in _TOKEN.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]
    marks, covered = [], set()
    for s, e in sorted({(s, e) for _, s, e in base}):
        i, upto = bisect.bisect_right(ends, s), bisect.bisect_left(starts, e) - 1
        covered.update(range(i, upto + 1))
        marks.append((s, e, True, i, upto))
    for i, (s, e) in enumerate(words):
        token = text[s:e]
        bare = token.strip(_EDGE)
        if i not in covered and len(bare) >= 5 and _DIGIT.search(bare):
            start = s + token.index(bare)
            marks.append((start, start + len(bare), False, i, i))
    marks.sort()
    word = lambda i: text[words[i][0] : words[i][1]].strip(_EDGE).lower() if 0 <= i < len(words) else ""
    out = []
    for start, end, seed, i, j in marks:
        value = text[start:end]
        patterns = [whole(p) for p in (f"l:{word(i - 1)}", f"r:{word(j + 1)}", f"ll:{word(i - 2)} {word(i - 1)}", f"lr:{word(i - 1)} {word(j + 1)}", f"3:{word(i - 2)} {word(i - 1)} {word(j + 1)}")]
        if not seed:
            key = re.match(r"[^0-9=:]{2,}[=:]|[A-Z]{4}", value)
            patterns += [f"s:{shape(value)}"] + ([whole(f"p:{key.group()}")] if key else [])
        out.append((start, end, whole(value), seed, patterns))
    return out


_SPAN = "struct<kind:string,start:int,end:int>"


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row (hash of key and text), base (spans), marks (instances with their patterns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, marks = [], []
            for value in batch.column(2):
                body = value.as_py() or ""
                spans = base_spans(body)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                marks.append([{"start": s, "end": e, "value": v, "seed": b, "patterns": p} for s, e, v, b, p in instances(body, spans)])
            span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
            mark = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, pa.list_(span)), pa.array(marks, pa.list_(mark))], [key, "row", "base", "marks"])

    rows = docs.select(key, F.xxhash64(key, text).alias("row"), text)
    return rows.mapInArrow(run, f"{key} bigint, row bigint, base array<{_SPAN}>, marks array<struct<start:int,end:int,value:string,seed:boolean,patterns:array<string>>>")


def trusted_values(marks: DataFrame, rounds: int = MOST_ROUNDS, min_trust: float = MIN_TRUST, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Values (not seeds) that the graph of ``marks`` (value, seed, patterns) trusts once a round adds none;
    an error if that takes more than ``rounds``. Trust only grows, so rounds come to an end.

    Edges are distinct, so copies of a document count once. Sums by pattern are combined map-side, and
    the scores of frequent patterns are broadcast.
    """
    edges = _edges(marks)
    trusted = _trusted(edges, rounds, min_trust, min_support)
    return trusted.join(edges.filter("seed").select("value").distinct(), "value", "left_anti")


def _edges(marks: DataFrame) -> DataFrame:
    """value, seed, pattern and ``n``, how often they occur together."""
    return stored(marks.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("value", "seed", "pattern").agg(F.count("*").alias("n")), "pattern-edges")


def _trusted(edges: DataFrame, rounds: int = MOST_ROUNDS, min_trust: float = MIN_TRUST, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Seeds and the values trusted at the end of the rounds."""
    trusted = stored(edges.filter("seed").select("value").distinct(), "trusted")
    size = trusted.count()
    for _ in range(rounds):
        known = edges.join(trusted.withColumn("known", F.lit(1)), "value", "left").withColumn("known", F.coalesce("known", F.lit(0)))
        score = F.sum("known") / (F.count("*") + 1)
        patterns = known.groupBy("pattern").agg(F.sum("known").alias("support"), score.alias("trust"), F.count("*").alias("n"))
        good = patterns.filter((F.col("support") >= min_support) & (F.col("trust") >= min_trust))
        scores = with_facts(edges.filter(~F.col("seed")).drop("n"), good, ["pattern"], ["trust"]).groupBy("value").agg(F.max("trust").alias("score"))
        reached = scores.filter(F.col("score") >= min_trust).select("value")
        trusted = stored(trusted.unionByName(reached).distinct(), "trusted")
        before, size = size, trusted.count()
        if size == before:
            break
    else:
        raise RuntimeError(f"values are still being trusted after {rounds} rounds")
    return trusted


def _frame(words: Column) -> Column:
    """The frame of two or three words as a long; ``_fillers`` makes the same."""
    last = F.shiftleft(F.xxhash64(F.element_at(words, -2)), 1).bitwiseXOR(F.xxhash64(F.element_at(words, -1)))
    return F.when(F.size(words) == 2, last).otherwise(F.shiftleft(F.xxhash64(words[0]), 2).bitwiseXOR(last))


def _code(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)


def _bit_map(frames: DataFrame) -> np.ndarray:
    """One bit for each value of the last MAP_BITS bits of ``frame``: 2 MB, however many frames there are."""
    at = F.col("frame").bitwiseAND(F.lit((1 << MAP_BITS) - 1)) + 1
    made = frames.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(1 << MAP_BITS >> 3, np.uint8)
    for part, bits in made.collect():  # at most 512 rows
        out[(part - 1) * len(bits) : part * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


class _Codes(dict):
    """Codes of tokens without edge signs and case (0 where nothing is left), kept for some 500,000 tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        bare = token.strip(_EDGE).lower()
        self[token] = _code(bare) if bare else 0
        return self[token]


def _fillers(text: str, bits: np.ndarray, known: _Codes, places: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(frames, starts, ends) of the runs of up to MOST_TOKENS tokens in frames that ``bits`` may hold; without
    ``places`` starts and ends are empty. A run holds neither of the words beside it and touches no base span; its
    first and last token are not only signs."""
    words = _TOKEN.findall(text)
    if len(words) < 3:
        return
    codes = np.array([known[w] for w in words], np.uint64)
    taken: np.ndarray | None = None
    for n, wide in [(n, wide) for n in range(1, MOST_TOKENS + 1) for wide in (0, 1) if n + 1 + wide < len(words)]:
        first, before, after = codes[: -n - 2], codes[wide : -n - 1], codes[n + 1 + wide :]
        frames = (before << np.uint64(1)) ^ after
        usable = (before != 0) & (after != 0)
        if wide:
            frames, usable = frames ^ (first << np.uint64(2)), usable & (first != 0)
        at = frames & np.uint64((1 << MAP_BITS) - 1)
        held = np.flatnonzero(usable & ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1))
        run = held + wide + 1  # its first token
        good = (codes[run] != 0) & (codes[run + n - 1] != 0)
        for k in range(n):
            good &= (codes[run + k] != codes[run - 1]) & (codes[run + k] != codes[run + n])
        if not good.any():
            continue
        if taken is None:
            taken = np.zeros(len(words) + 1, np.int64)
            base = base_spans(text)
            if base or places:
                starts, ends = (list(x) for x in zip(*(m.span() for m in _TOKEN.finditer(text))))
            for _, s, e in base:
                taken[bisect.bisect_right(ends, s) + 1 : bisect.bisect_left(starts, e) + 1] = 1
            taken = np.cumsum(taken)
        good &= taken[run + n] == taken[run]
        picked, run = held[good], run[good]
        if len(run):
            lead = [starts[i] + len(words[i]) - len(words[i].lstrip(_EDGE)) for i in run] if places else []
            last = [starts[i] + len(words[i].rstrip(_EDGE)) for i in run + n - 1] if places else []
            yield frames[picked].view(np.int64), np.array(lead, np.int64), np.array(last, np.int64)


def _filled(docs: DataFrame, frames: DataFrame, key: str, text: str, spans: bool) -> DataFrame:
    """Fillers of ``frames`` in every whole text, and of others that share a bit with these: frame and n, their
    number in a batch, or with ``spans`` key, row, frame, start and end of each."""
    bits = docs.sparkSession.sparkContext.broadcast(_bit_map(frames))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Codes()
        for batch in batches:
            found = [f for x in batch.column(2) for f, _, _ in _fillers(x.as_py() or "", bits.value, known, False)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(found), return_counts=True)], ["frame", "n"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Codes()
        for batch in batches:
            found = [(np.full(len(f), i), f, s, e) for i, x in enumerate(batch.column(2)) for f, s, e in _fillers(x.as_py() or "", bits.value, known, True)]
            if found:
                picked, frame, start, end = (np.concatenate(x) for x in zip(*found))
                rows = batch.take(pa.array(picked))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(frame), pa.array(start, pa.int32()), pa.array(end, pa.int32())], [key, "row", "frame", "start", "end"])

    rows = docs.select(F.col(key).cast("long"), F.xxhash64(key, text).alias("row"), text)
    if spans:
        return rows.mapInArrow(places, f"{key} bigint, row bigint, frame bigint, start int, end int")
    return rows.mapInArrow(counts, "frame bigint, n bigint")


def framed_spans(docs: DataFrame, edges: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", min_trust: float = MIN_TRUST, min_support: int = MIN_SUPPORT) -> DataFrame:
    """key, row, start, end of the fillers of trusted frames.

    Frames are the patterns of ``edges`` that name words on both sides, with enough ``trusted`` values. The
    trust of a frame is the share of known values in all that fills it, by occurrences, so that fillers are
    counted where they are read: their number does not grow the shuffle, however common the frames' words are.
    Texts are read once for the counts and once for the places; neither read is made where no frame is left.
    """
    two = edges.filter((F.col("pattern").startswith("lr:") | F.col("pattern").startswith("3:")) & (F.length("pattern") < 200))
    two = two.withColumn("words", F.split(F.regexp_replace("pattern", "^(lr|3):", ""), " ")).filter(~F.array_contains("words", ""))
    two = two.join(trusted, "value").select(_frame(F.col("words")).alias("frame"), "seed", "value", "n")
    two = two.groupBy("frame").agg(F.count_distinct("value").alias("support"), F.sum("n").alias("known"), F.coalesce(F.sum(F.when(~F.col("seed"), F.col("n"))), F.lit(0)).alias("unseeded"))
    frames = stored(two.filter(F.col("support") >= min_support), "frames")
    none = docs.sparkSession.createDataFrame([], f"{key} bigint, row bigint, start int, end int")
    if frames.isEmpty():
        return none
    both = frames.unionByName(_filled(docs, frames, key, text, False), allowMissingColumns=True)
    both = both.groupBy("frame").agg(F.max("known").alias("known"), (F.coalesce(F.sum("n"), F.lit(0)) - F.max("unseeded")).alias("others"))
    trust = F.col("known") / (F.col("known") + F.greatest("others", F.lit(0)) + 1)
    good = stored(both.filter(trust >= min_trust).select("frame"), "good-frames")
    if good.isEmpty():
        return none
    # a place is kept once its frame is known to be a good one, not only to share its bit
    return _filled(docs, good, key, text, True).join(good, "frame", "left_semi").select(key, "row", "start", "end")


def found_spans(docs: DataFrame, scan: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row, found (sorted spans) of rows of ``docs`` where trusted values, or fillers of trusted
    frames, occur beside the base spans. ``scan`` is ``scanned(docs)``."""
    marks = scan.filter(F.size("marks") > 0).select(key, "row", F.explode("marks").alias("m")).select(key, "row", "m.*")
    edges = _edges(marks)
    trusted = _trusted(edges)
    values = trusted.join(edges.filter("seed").select("value").distinct(), "value", "left_anti")
    hits = marks.filter(~F.col("seed")).join(values, "value").select(key, "row", "start", "end")
    hits = hits.unionByName(framed_spans(docs, edges, trusted, key, text))
    return hits.groupBy(key, "row").agg(F.sort_array(F.collect_set(F.struct(F.lit(FOUND).alias("kind"), "start", "end"))).alias("found"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _paired(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    named = found.withColumnsRenamed({key: "_key", "row": "_row"})
    out = rows.join(named, rows[key].eqNullSafe(named["_key"]) & (rows["row"] == named["_row"]), "left").drop("_key", "_row")
    return out.withColumn("found", F.coalesce("found", F.array().cast(f"array<{_SPAN}>")))


def personal_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and found spans of every row of ``docs``."""
    scan = stored(scanned(docs, key, text), "pii-scan")
    return _paired(scan.drop("marks"), found_spans(docs, scan, key, text), key).select(key, "base", "found")


def merged(spans: list[Span]) -> list[Span]:
    """Spans for replacement: by start, overlapping ones joined under the first one's kind."""
    out: list[Span] = []
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if out and start < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(end, out[-1][2]))
        else:
            out.append((kind, start, end))
    return out


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; columns unchanged."""
    scan = stored(scanned(docs, key, text), "pii-scan")
    found = stored(found_spans(docs, scan, key, text), "pii-found")
    spans = stored(_paired(scan, found, key).select(key, "row", F.concat("base", "found").alias("found")).filter(F.size("found") > 0).dropDuplicates([key, "row"]), "pii-spans")
    named = spans.select(F.struct(key, "row", "found").alias("_found"))
    hit = docs.join(named, docs[key].eqNullSafe(F.col(f"_found.{key}")) & (F.xxhash64(docs[key], docs[text]) == F.col("_found.row")), "left")
    pieces = F.struct(F.col(text), F.col("_found.found").alias("found"))

    @F.pandas_udf("string")
    def replaced(frame):  # type: ignore[no-untyped-def]
        out = []
        for body, found_ in zip(frame[text], frame["found"]):
            if body is None or not len(found_):
                out.append(body)
                continue
            parts, at = [], 0
            for kind, start, end in merged([(x["kind"], x["start"], x["end"]) for x in found_]):
                parts += [body[at:start], f"[{kind.upper()}]"]
                at = end
            out.append("".join([*parts, body[at:]]))
        return pd.Series(out, dtype="object")

    touched = hit.filter(F.col("_found").isNotNull()).withColumn(text, replaced(pieces))
    return touched.select(docs.columns).unionByName(hit.filter(F.col("_found").isNull()).select(docs.columns))
