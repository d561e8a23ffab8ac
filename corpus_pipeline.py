"""Corpus pipeline: filter by quality rules, drop near copies, redact personal data, mix sources, encode.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns
of ``documents``; the last one returns token ids and the training order. ``run`` writes each stage as Parquet in the shared
folder and reads it as the next stage's docs. Nulls, empty tables, ties, repeated rows and extra
columns are treated as the operators' docstrings state.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, curriculum, decision_list, overlap_join, pii
from tidemark.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and the rules learned from ``labels`` keep."""
    return decision_list.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return overlap_join.keep_one(docs, width=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with base and found spans replaced by their kind; n_chars follows the text."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per taken copy, range-sorted by training position."""
    return curriculum.by_position(curriculum.mix(docs)).select("doc.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and place of each row.

    ``place`` ascends in the order of the rows as stored: number of the part, then of its file, then row in it. After
    ``source_mix``, which writes range-sorted rows, that is the training order. It is null where ``docs``
    is not read from part files.
    """
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("long")
    nth = F.coalesce(number(r"-c([0-9]+)\.[a-z.]*$"), F.lit(0))  # a part has several files under maxRecordsPerFile
    place = F.shiftleft(number(r"^part-([0-9]+)"), 42) + F.shiftleft(nth, 32) + F.col("_metadata.row_index")
    try:
        placed = docs.select("doc_id", "lang", "source", "text", place.alias("place"))
        placed.schema  # noqa: B018
    except AnalysisException:
        placed = docs.select("doc_id", "lang", "source", "text", F.lit(None).cast("long").alias("place"))
    made = bpe.encode(placed, public_tokenizers.path("word_bpe_49k.json"))
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "place")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: No SQL: learned rules, bootstrapped extraction and byte pairs are not SQL expressions. The tests
#: compare near_copies with a brute-force version and check what the other stages keep and return.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
