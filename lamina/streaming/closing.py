"""Votes of archives that event time closes.

An archive is what one key sent in one window of event time. Its state is a list to which each batch adds a sum and a count for each molecule
it has reads of, in one call, so it grows with molecules, not reads; a timer at the window's end adds them up, gives the two-level vote and clears the state. Time goes by
the ends of windows: a window is closed once rows were seen whose window ends more than ``delay`` behind it. Rows of a window
that is still open count however late they are; rows of a closed one are dropped, and counted by the engine.

Defined cases: a null value counts as a read without a value; a molecule of null values only has no mean and is none of
the archive's; an archive of which no molecule has a mean has a null vote; null keys and molecules are keys of their own;
rows without a time are in no window and dropped.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Molecules(StatefulProcessor):
    """Sums and counts per molecule of each batch, and a timer at the window's end. A call to the state costs more than thousands of rows do, so there is one for a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getListState("sums", "molecule string, total double, valued long, reads long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added: dict[str | None, list] = {}
        for frame in rows:
            for molecule, value in zip(frame["molecule"], frame["value"]):
                found = added.setdefault("" if molecule is None else f"={molecule}", [0.0, 0, 0])
                if value is not None and value == value:
                    found[0] += value
                    found[1] += 1
                found[2] += 1
        if added:
            self.sums.appendList([(molecule, *sums) for molecule, sums in added.items()])
        self.handle.registerTimer(int(key[1]))  # the same time again is the same timer
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found: dict[str, list] = {}
        reads = 0
        for molecule, total, valued, n in self.sums.get():
            sums = found.setdefault(molecule, [0.0, 0])
            sums[0] += total
            sums[1] += valued
            reads += n
        means = [total / valued for total, valued in found.values() if valued]
        self.sums.clear()
        yield pd.DataFrame({"archive": [key[0]], "closes": [int(key[1])], "molecules": [len(means)], "reads": [reads], "vote": [sum(means) / len(means) if means else None]}).astype({"vote": "float64"})

    def close(self) -> None:
        pass


def closed_votes(stream: DataFrame, archive: str, molecule: str, value: str, time: str, length: str, delay: str) -> DataFrame:
    """archive, start, molecules, reads, vote of every archive (a key in a window of ``length``) that is closed; a stream in append mode."""
    window = F.window(F.col(time).cast("timestamp"), length)
    rows = stream.select(F.col(archive).cast("string").alias("archive"), F.col(molecule).cast("string").alias("molecule"), F.col(value).cast("double").alias("value"), window.alias("w"))
    rows = rows.select("archive", "molecule", "value", F.col("w.end").alias("ends"), F.unix_millis("w.end").alias("closes"))
    keyed = rows.withWatermark("ends", delay).groupBy("archive", "closes")
    schema = "archive string, closes long, molecules long, reads long, vote double"
    votes = keyed.transformWithStateInPandas(statefulProcessor=_Molecules(), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    span = F.expr(f"interval {length}")
    return votes.select("archive", (F.timestamp_millis("closes") - span).alias("start"), "molecules", "reads", "vote")


@contextlib.contextmanager
def state_in_rocks(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, on the executors' disks, with its changes in the checkpoint folder."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_available(votes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes all that is there now and stops. Each batch overwrites a folder of its own number, so one that runs again after a failure counts once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with state_in_rocks(votes.sparkSession):
        query = votes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows that a run dropped because their archive was closed (of its last batches, as many as the session keeps progress of)."""
    return sum(int(state["numRowsDroppedByWatermark"]) for progress in query.recentProgress for state in progress["stateOperators"])
