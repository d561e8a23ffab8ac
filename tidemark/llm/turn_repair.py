"""Conversation structure repair: the cheapest edits that make a conversation (s?(ua)+)?, by one integer each.

A conversation is its rows by turn (nulls first; rows of one turn by role, then text). A row's first fault
counts: blank (nothing but space and U+0009..U+000D), duplicate (role and text of an earlier row), truncated
(last such character not one of ``.!?``). Edits of a row are Keep (0), Rerole to user or assistant (2) and
Delete (3; the only one for blank and duplicate rows); Insert (2) puts an empty user or assistant turn
anywhere; a truncated row that stays adds 1. First letters of the roles that remain read ``(s?(ua)+)?``.

The edits are a path through a graph without cycles: a node is (rows left, state of the pattern), and the
weight of the best way from a node to the end is one integer. Its high digits are the cost; below them stand
``3 * n + 2`` digits of three bits, the letters of the audit from the left (D 1, I 2, K 3, R 4: as in ASCII),
with zeros behind its end, so that a shorter audit is less than its own extensions. An edge adds its cost and
its letter in front; the least integer of node (all rows, start) is cost and audit at once, ties included.
More than two inserts in a row only come back to a state already met, at a higher cost, so two are tried.

The audit decides the repaired turns: what stays alternates from its first turn.

A null role or text is one space, as is a null in the key that ``damaged`` hashes; a null turn is null in
``gaps``. A null conversation id is one conversation. Repeated rows are duplicates. Empty tables give empty
results; columns other than conv_id, turn, role and text are not read. The conversation is the unit: its rows
meet in one row, as the digest of a whole conversation needs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
#: Letters of edits, in ASCII order; their digits are 1 to 4.
LETTERS = "DIKR"
BITS = 3
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. 0 and 3 may end.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = (2, 2, 3, 2)
FULL = {"u": "user", "a": "assistant"}


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies`` (0: dropped, 2: repeated) by crc32 of ``conv_id:turn`` mod 20."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text, role = filled("text"), filled("role")
    return rows.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def gathered(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (array of turn, role, text in order). ``copies``, where there
    is such a column, says how often a row counts; conversations without rows left have an empty array."""
    filled = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    packed = F.struct(F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"), copies.alias("copies"))
    held = F.sort_array(F.collect_list(F.when(copies > 0, packed)))
    bare = lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text"))
    return rows.groupBy("conv_id").agg(F.flatten(F.transform(held, lambda x: F.array_repeat(bare(x), x["copies"]))).alias("turns"))


def faults(turns: Sequence[tuple[str, str]]) -> list[str]:
    """First fault of each (role, text): blank, duplicate, truncated or nothing."""
    seen: set[tuple[str, str]] = set()
    out = []
    for turn in turns:
        bare = turn[1].rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if turn in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add(turn)
    return out


def cheapest(initials: Sequence[str], found: Sequence[str]) -> tuple[int, str]:
    """(cost, audit) of the least path over rows with these first letters of roles and faults."""
    width = BITS * (3 * len(initials) + 2)
    low = (1 << width) - 1

    def led(letter: str, cost: int, rest: int) -> int:
        digit = LETTERS.index(letter) + 1
        return ((rest >> width) + cost) << width | digit << (width - BITS) | (rest & low) >> BITS

    def with_inserts(node: list[int | None]) -> list[int | None]:
        out = []
        for state, own in enumerate(node):
            once, twice = node[WANTED[state]], node[WANTED[WANTED[state]]]
            ways = [] if own is None else [own]
            if once is not None:
                ways.append(led("I", 2, once))
            if twice is not None:
                ways.append(led("I", 2, led("I", 2, twice)))
            out.append(min(ways, default=None))
        return out

    node = with_inserts([0, None, None, 0])
    for initial, fault in zip(reversed(initials), reversed(found)):
        ways = [led("D", 3, rest) for rest in node]
        if fault in ("", "truncated"):
            extra = int(fault == "truncated")
            for state in range(4):
                ways[state] = min(ways[state], led("R", 2 + extra, node[WANTED[state]]))
                if initial in AFTER[state]:
                    ways[state] = min(ways[state], led("K", extra, node[AFTER[state][initial]]))
        node = with_inserts(ways)
    digits = (node[0] >> at & 7 for at in range(width - BITS, -1, -BITS))
    return node[0] >> width, "".join(LETTERS[d - 1] for d in digits if d)


def rebuilt(turns: Sequence[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns that an audit leaves."""
    rows, out, left = iter(turns), [], len(audit) - audit.count("D")
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter != "D":
            out.append((role if letter == "K" else FULL["ua"[(len(out) + left) % 2]], text))
    return out


_SHAPE = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, turns array<struct<role:string,text:string>>"


def repaired(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps in turn numbers, rows by first fault, illegal neighbours, cost, audit, turns."""

    def facts(rows: list[dict]) -> dict:
        turns = [(x["role"], x["text"]) for x in rows]
        numbers = {x["turn"] for x in rows} - {None}
        initials, found = [role[:1] for role, _ in turns], faults(turns)
        cost, audit = cheapest(initials, found)
        return {
            "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            **{kind: found.count(kind) for kind in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost,
            "audit": audit,
            "turns": [{"role": role, "text": text} for role, text in rebuilt(turns, audit)],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                made = [{"conv_id": conv, **facts(turns)} for conv, turns in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_pylist(made, schema)

    made = gathered(rows).select(F.col("conv_id").cast("long").alias("conv_id"), "turns")
    text, number = pa.string(), pa.int64()
    schema = pa.schema([("conv_id", number), *((k, number) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", text), ("turns", pa.list_(pa.struct([("role", text), ("text", text)])))])
    return made.mapInArrow(run, _SHAPE)


def digests(made: DataFrame) -> DataFrame:
    """``made`` with repaired_sha256 (``role:text`` of the repaired turns, newline-joined) for its turns."""
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return made.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("turns")
