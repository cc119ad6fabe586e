"""FASTA as a table of id and sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """id, description, sequence (upper case, line ends taken out). Records, not lines, are split between tasks; gzip files are read as they are."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if recursive:
        reader = reader.option("pathGlobFilter", "*.fasta*")
    records = reader.text(path, lineSep=">").where(F.trim("value") != "")
    parts = F.split("value", "\r?\n", 2)
    header = F.trim(F.element_at(parts, 1))
    return records.select(F.split(header, r"\s+", 2)[0].alias("id"), header.alias("description"), F.upper(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "")).alias("sequence"))


def write(df: DataFrame, path: str, id_col: str = "id", sequence_col: str = "sequence", compression: str = "none") -> None:
    df.select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), F.col(sequence_col)).alias("value")).write.mode("overwrite").option("compression", compression).text(path)
