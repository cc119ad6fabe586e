"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the session. Where none is set, a temporary one, on one machine alone (tests): executors elsewhere couldn't read it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="lamina-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession):
    """Each query that is run inside deletes the files of its shuffles as it ends. Otherwise they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet into a new folder of the shared checkpoint folder and read back: later plans read only the columns they need, and retried tasks find the same rows in the same order."""
    folder = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(folder)
    out = df.sparkSession.read.parquet(folder)
    out._written_to = folder
    return out


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing will read it any more."""
    if folder := getattr(df, "_written_to", None):
        delete(df.sparkSession, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


HOT_ROWS = 1000  # a key of fewer rows is never hot


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key and in ``weight`` the number of rows that have it, ``total`` in all.

    Keys that hold more than a partition's share are joined by broadcast: no more than there are partitions can, so
    what is broadcast is bounded. The others hold so few rows that none makes a task of its own.
    """
    spark = rows.sparkSession
    share = max(HOT_ROWS, total // max(1, shuffle_partitions(spark)))
    found = table.where(F.col(weight) > share).collect()
    table, cold = table.drop(weight), table.where(F.col(weight) <= share).drop(weight)
    if not found:
        return rows.join(table, key, how)
    hot = F.broadcast(spark.createDataFrame([[r[c] for c in table.columns] for r in found], table.schema))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, how))


def doc_bucket(column: str, modulus: int):
    """The contract's fold number: crc32 of the decimal text of an id, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def sliced(names: list[str], types: list[pa.DataType], rows: Iterable[tuple], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``limit`` bytes of strings and binaries, so that one long text never makes a huge batch."""
    columns: list[list] = [[] for _ in names]
    size = 0
    for row in rows:
        for column, value in zip(columns, row):
            column.append(value)
            size += len(value) if isinstance(value, (bytes, str)) else 8
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            columns, size = [[] for _ in names], 0
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks, and would keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
