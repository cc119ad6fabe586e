"""Delimited and JSON files: unions of columns, nested values as JSON, gzip shards that can be resumed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.operators import audit


def union_of_columns(parts: list[DataFrame]) -> DataFrame:
    """All rows; columns in the order first seen, null where a part has none."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.StructType, T.MapType))


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str = "none") -> None:
    """With a header; arrays, structs and maps become JSON."""
    flat = df.select(*[F.to_json(f.name).alias(f.name) if _nested(f.dataType) else F.col(f"`{f.name}`") for f in df.schema])
    flat.write.mode("overwrite").partitionBy(*(partition_by or [])).option("header", True).option("compression", compression).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed; columns of nested types are read from JSON. A file that lacks a column of the schema fails."""
    flat = T.StructType([T.StructField(f.name, T.StringType() if _nested(f.dataType) else f.dataType) for f in schema])
    df = spark.read.schema(flat).option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)
    return df.select(*[F.from_json(f.name, f.dataType).alias(f.name) if _nested(f.dataType) else F.col(f"`{f.name}`") for f in schema])


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def shard_marks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and an order-free digest of each shard."""
    columns = sorted(c for c in df.columns if c not in keys)
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("digest"))


def write_pending(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Writes the shards that aren't complete, and returns the marks of all.

    A shard is complete if its mark is recorded and fits what is in its folder. Shards are written by dynamic
    overwrite before their marks are, so a run that stops half-way leaves none that looks complete.
    """
    done = None
    if _exists(spark, f"{path}/marks") and _exists(spark, f"{path}/data"):
        marks = spark.read.parquet(f"{path}/marks").select(*keys, "rows", "digest")
        there = shard_marks(spark.read.parquet(f"{path}/data"), keys)
        done = marks.join(there, [*keys, "rows", "digest"], "left_semi")
    todo = df if done is None else audit.pending(df, done, keys)
    todo.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy(*keys).parquet(f"{path}/data")
    written = spark.read.parquet(f"{path}/data")
    marks = shard_marks(written, keys)
    marks.write.mode("overwrite").parquet(f"{path}/marks")
    return marks


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_or_make(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``; where a complete one isn't there yet, what ``make()`` returns is written first."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON file of a report's few rows, by a single task."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_store(df: DataFrame, path: str, category: str = "category") -> None:
    """References in one folder per category, each written by as many tasks as its rows need."""
    df.hint("rebalance", category).write.mode("overwrite").partitionBy(category).parquet(path)
