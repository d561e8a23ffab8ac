"""Logs by block as a streaming source, and feeds that fall silent.

``ChainLogs`` reads a Parquet table of logs in order of its ``block`` column: an offset is the last block read, a
batch takes at most ``blocks_per_batch`` blocks, and its partitions ranges of at most ``blocks_per_read`` of them.
A range is read by a task from the files whose statistics say they may hold it, so nothing passes the driver, and
a range that is read again (after a lost executor or a restart) gives the same rows: with a checkpoint every log is
delivered once. The driver reads files' footers only, for the newest block; logs must be appended with blocks that
have not been read yet.

``Silence`` is the state of a feed in processing time: a feed that has had no row for a while comes out once, as
stale; it comes out again when it has spoken and fallen silent again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor

from ..sources.scratch import settings
from .volume import ROCKS


class Blocks(InputPartition):
    """Blocks ``first`` to ``last``, both included."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def ranges(after: int, upto: int, size: int) -> list[tuple[int, int]]:
    """Ranges of at most ``size`` blocks behind ``after`` up to ``upto``."""
    return [(first, min(first + size - 1, upto)) for first in range(after + 1, upto + 1, size)]


class ChainLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.per_batch, self.per_read = int(options.get("blocks_per_batch", 100_000)), int(options.get("blocks_per_read", 2_000))
        self.start = int(options["start_block"]) - 1 if "start_block" in options else None
        self.at: int | None = None  # the last block offered

    def _bounds(self) -> tuple[int, int]:
        """(least, greatest) block of the table, from the statistics of its files; (0, -1) of an empty one."""
        low, high = [], []
        for fragment in ds.dataset(self.path, format="parquet").get_fragments():
            footer = pq.read_metadata(fragment.path, filesystem=fragment.filesystem)
            column = footer.schema.names.index("block")
            for group in range(footer.num_row_groups):
                found = footer.row_group(group).column(column).statistics
                if found is not None and found.has_min_max:
                    low.append(found.min)
                    high.append(found.max)
        return (min(low), max(high)) if low else (0, -1)

    def initialOffset(self) -> dict:
        if self.start is None:
            self.start = self._bounds()[0] - 1
        return {"block": self.start}

    def latestOffset(self) -> dict:
        at = self.initialOffset()["block"] if self.at is None else self.at
        self.at = max(at, min(at + self.per_batch, self._bounds()[1]))
        return {"block": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end["block"] if self.at is None else max(self.at, end["block"])  # after a restart: where it was
        return [Blocks(*r) for r in ranges(start["block"], end["block"], self.per_read)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        block = ds.field("block")
        yield from ds.dataset(self.path, format="parquet").to_batches(columns=self.columns, filter=(block >= partition.first) & (block <= partition.last))

    def commit(self, end: dict) -> None:
        pass


class ChainLogs(DataSource):
    """``spark.readStream.format("chain_logs").schema(...).option("path", folder)``; options blocks_per_batch,
    blocks_per_read and start_block (the first block to read where there is no checkpoint)."""

    @classmethod
    def name(cls) -> str:
        return "chain_logs"

    def schema(self) -> str:
        raise ValueError("state the schema of the logs, with a bigint column block")

    def streamReader(self, schema) -> ChainLogReader:
        return ChainLogReader(dict(self.options), schema.names)


def chain_logs(spark: SparkSession, folder: str, schema: str, **options: int) -> DataFrame:
    spark.dataSource.register(ChainLogs)
    made = spark.readStream.format("chain_logs").schema(schema).option("path", folder)
    for name, value in options.items():
        made = made.option(name, str(value))
    return made.load()


class Silence(StatefulProcessor):
    """Rows (feed, last_ms, silent_since): processing time of a feed's last row, and when it became stale."""

    OUTPUT = "feed string, last_ms bigint, silent_since bigint"

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "last_ms bigint, timer bigint")
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if sum(map(len, rows)):
            now, held = timerValues.getCurrentProcessingTimeInMs(), self.last.get()
            if held is not None and held[1]:
                self.handle.deleteTimer(held[1])
            self.last.update((now, now + self.after_ms))
            self.handle.registerTimer(now + self.after_ms)
        yield pd.DataFrame({"feed": pd.Series(dtype=str), "last_ms": pd.Series(dtype="int64"), "silent_since": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _ = self.last.get()
        self.last.update((last, 0))
        yield pd.DataFrame({"feed": [key[0]], "last_ms": [last], "silent_since": [expiredTimerInfo.getExpiryTimeInMs()]})


def silences(stream: DataFrame, after_ms: int) -> DataFrame:
    """One row for each time that a ``feed`` of ``stream`` has been silent for ``after_ms``."""
    return stream.groupBy("feed").transformWithStateInPandas(Silence(after_ms), Silence.OUTPUT, "append", "processingTime")


def watch(stream: DataFrame, after_ms: int, out: str, checkpoint: str, every: str = "1 second"):
    """A running query that writes ``silences`` to ``out``."""
    with settings(stream.sparkSession, spark__sql__streaming__stateStore__providerClass=ROCKS):
        return silences(stream, after_ms).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Delivers all that the source holds, in as many batches as it takes, and stops."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
