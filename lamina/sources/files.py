"""Inventories of files by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import audit
from lamina.storage import scratch  # noqa: F401


def hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path (below the folder), length, sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    root = path.rstrip("/").split(":")[-1].lstrip("/")
    below = F.regexp_replace("path", rf"^.*{root}/", "")
    return files.select(below.alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def verify(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """missing, unexpected and changed files."""
    return audit.snapshot_diff(expected, actual, "path", "sha256")


def weights(inventory: DataFrame, pattern: str = r"(\w+?)_(\w+?)_f1_([0-9.]+)\.\w+$", expected: DataFrame | None = None) -> DataFrame:
    """Files whose names tell a task, a model and a score; with ``expected`` (path, sha256) also whether the content is the known one."""
    named = inventory.where(F.col("path").rlike(pattern)).select("*", *[F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(("task", "model"))], F.regexp_extract("path", pattern, 3).cast("double").alias("f1"))
    if expected is None:
        return named
    known = expected.select("path", F.col("sha256").alias("__known"))
    return named.join(known, "path", "left").withColumn("hash_matches", F.col("sha256").eqNullSafe(F.col("__known"))).drop("__known")
