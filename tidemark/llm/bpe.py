"""BPE encoding and decoding of a published word-level vocabulary, by a contiguous rank array.

A short word holds its parts and, beside them in one array, the rank of each adjacent pair. The array
is scanned for its minimum, the boundary there is deleted, and the two neighbouring ranks are looked
up again, until no pair has a rank. Words longer than SHORT parts use a heap with the same order
(lowest rank, then leftmost), so that very long words stay near-linear.

The vocabulary file is read by every Python worker from ``path`` (installed with the environment, not
shipped). Words are cached per worker in a bounded table. Null texts count as empty: no tokens and an
empty decoded text. Empty tables give empty results; repeated rows are encoded each; extra columns
are carried unchanged, and a column named like an output is replaced.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 64
CACHE_WORDS = 150_000
NONE = 1 << 30

#: White space as the tokenizer's regular expressions see it, and its word pattern.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 is itself, the others follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class RankBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.letters = byte_letters()
        self.piece = regex.compile(PIECES)
        self.control = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.cache: dict[str, array] = {}

    def word(self, text: str) -> list[int]:
        letters = [self.letters[b] for b in text.encode("utf-8", "surrogatepass")]
        letters[-1] += self.suffix
        parts = [self.ids[x] for x in letters]
        return self.by_scan(parts) if len(parts) <= SHORT else self.by_heap(parts)

    def by_scan(self, parts: list[int]) -> list[int]:
        ranks, none = self.ranks, (NONE, -1)
        near = [ranks.get(pair, none) for pair in zip(parts, parts[1:])]
        while near:
            best = min(near)
            if best[0] == NONE:
                break
            i = near.index(best)
            parts[i] = best[1]
            del parts[i + 1], near[i]
            if i < len(near):
                near[i] = ranks.get((best[1], parts[i + 1]), none)
            if i:
                near[i - 1] = ranks.get((parts[i - 1], best[1]), none)
        return parts

    def by_heap(self, parts: list[int]) -> list[int]:
        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*ranks[pair][:1], i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = ranks[pair][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (found := (parts[i], parts[after[i]])) in ranks:
                    heapq.heappush(heap, (ranks[found][0], i, found))
            if before[i] >= 0 and (found := (parts[before[i]], parts[i])) in ranks:
                heapq.heappush(heap, (ranks[found][0], before[i], found))
        return [p for p in parts if p >= 0]

    def chunk(self, text: str) -> array:
        """Ids of a text without white space; cached."""
        out = array("i")
        for piece in self.piece.findall(text):
            out.extend(self.word(piece))
        if len(text) <= 4 * SHORT:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[text] = out
        return out

    def encode(self, text: str, out: array) -> None:
        """Append the ids of a whole text to ``out``; special tokens in it are recognised."""
        if self.control is not None and "<|" in text:
            at = 0
            for found in self.control.finditer(text):
                self.plain(text[at : found.start()], out)
                out.append(self.special[found.group()])
                at = found.end()
            text = text[at:]
        self.plain(text, out)

    def plain(self, text: str, out: array) -> None:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if any("\x1c" <= c <= "\x1f" for c in set(text)):
            chunks = regex.split(f"[{SPACE}]+", text)
        else:
            chunks = text.split()
        cached, chunk, extend = self.cache.get, self.chunk, out.extend
        for word in chunks:
            if word:
                found = cached(word)
                extend(chunk(word) if found is None else found)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def loaded(path: str) -> RankBpe:
    return RankBpe(path)


def _replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in columns}
    return pa.RecordBatch.from_pydict(kept | columns)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an array of token ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for value in batch.column(text):
                model.encode(value.as_py() or "", flat)
                ends.append(len(flat))
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield _replaced(batch, {ids: made})

    schema = docs.drop(ids).withColumn(ids, F.lit(None).cast("array<int>")).schema
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text that the ids stand for: tokens joined by a space, as for a vocabulary
    without a decoder; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            column = batch.column(ids)
            yield _replaced(batch, {out: pa.array([model.decode(value.as_py() or []) for value in column], pa.string())})

    schema = rows.drop(out).withColumn(out, F.lit(None).cast("string")).schema
    return rows.mapInArrow(run, schema)


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Both in one pass: ``docs`` with ids and the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            flat, ends, texts = array("i"), array("i", [0]), []
            for value in batch.column(text):
                model.encode(value.as_py() or "", flat)
                texts.append(model.decode(flat[ends[-1] :]))
                ends.append(len(flat))
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield _replaced(batch, {ids: made, out: pa.array(texts, pa.string())})

    schema = docs.drop(ids, out).withColumn(ids, F.lit(None).cast("array<int>")).withColumn(out, F.lit(None).cast("string")).schema
    return docs.mapInArrow(run, schema)
