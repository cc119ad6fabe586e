"""Folders of the shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, system = _at(spark, path)
    return system.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, system = _at(spark, path)
    system.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing where there is none."""
    p, system = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(p)) if system.exists(p) else []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder. Only a local session may do without one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="lamina-files-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from the checkpoint folder, for what looks through them more than once: they are made once, and every look sees the same numbers."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
