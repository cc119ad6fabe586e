"""Shared logits: one row per read, from array files or Parquet."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "archive_id string, category string, molecule_index int, read_index int, presence float, logits array<float>"
#: What array files call their parts. A part may have either name.
REQUIRED = {"categories": ("categories",), "presence": ("presence_probabilities", "presence"), "logits": ("type_logits", "logits")}


def from_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Array files (categories [N], presence_probabilities [N,M,q], type_logits [N,M,q,4], maybe archive_ids [N]); a file that lacks one fails. Files are read where the tasks are, archive by archive."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content):
                with np.load(io.BytesIO(content), allow_pickle=False) as data:
                    found = {part: [n for n in names if n in data] for part, names in REQUIRED.items()}
                    absent = [part for part, names in found.items() if not names]
                    if absent:
                        raise ValueError(f"{name} lacks {', '.join(absent)}")
                    categories, presence, logits = (data[names[0]] for names in found.values())
                    ids = data["archive_ids"] if "archive_ids" in data else np.arange(len(categories)).astype(str)
                if logits.shape != (*presence.shape, 4) or len(categories) != len(presence) or len(ids) != len(presence):
                    raise ValueError(f"{name}: shapes don't fit")
                m, q = np.indices(presence.shape[1:])
                for i in range(len(categories)):
                    yield pd.DataFrame({"archive_id": str(ids[i]), "category": str(categories[i]), "molecule_index": m.ravel(), "read_index": q.ravel(), "presence": presence[i].ravel(), "logits": list(logits[i].reshape(-1, 4))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    return files.select("path", "content").mapInPandas(rows, SCHEMA)


def save(df: DataFrame, path: str) -> None:
    df.select("archive_id", "category", "molecule_index", "read_index", F.col("presence").cast("float"), F.col("logits").cast("array<float>")).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    absent = {"archive_id", "category", "presence", "logits"} - set(df.columns)
    if absent:
        raise ValueError(f"{path} lacks {', '.join(sorted(absent))}")
    return df


def validated(df: DataFrame) -> DataFrame:
    """The same rows; presence outside [0, 1] or other than four finite logits fail."""
    bad = F.col("presence").isNull() | ~F.col("presence").between(0, 1) | (F.coalesce(F.size("logits"), F.lit(0)) != 4) | F.exists("logits", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.when(bad, F.raise_error(F.lit("a read's scores are out of range")).cast("boolean")).otherwise(F.lit(True)))


def score_once(df: DataFrame, model, sequence_col: str, path: str) -> DataFrame:
    """Runs a model over the reads, writes the scores and reads them back, so that every later step reuses them.

    ``model()`` is called once per task and returns a function from a list of sequences to (presence [n], logits [n, 4]).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model()
        for b in batches:
            presence, logits = score(b[sequence_col].tolist())
            yield b.assign(presence=np.asarray(presence, "f4"), logits=list(np.asarray(logits, "f4")))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", presence float, logits array<float>"
    df.mapInPandas(run, schema).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
