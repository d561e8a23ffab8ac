"""Folders that driver and executors share, for streams' checkpoints, sinks and saved state, and for facts that joins need."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a temporary folder where that is unset and driver and executors
    are one process. On a cluster without the setting there is no folder to share, which is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(facts: DataFrame, name: str = "facts") -> DataFrame:
    """``facts`` written and read back, so that a join with it is planned by its real size: where that is small Spark
    broadcasts it and the other side is not shuffled; an aggregate's size is a guess until its input has been."""
    path = shared_folder(facts.sparkSession, name)
    facts.write.parquet(path)
    return facts.sparkSession.read.schema(facts.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as two underscores) for the time of a block."""
    named = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
