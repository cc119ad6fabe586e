"""Votes over streams of scored reads: sums and counts per molecule are the state, so it grows with molecules, not reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators import votes


def molecule_sums(stream: DataFrame, values: dict[str, Column], archive: str = "archive_id", molecule: str = "molecule_id") -> DataFrame:
    """Update-mode state of the vote; merge it with votes.merge()."""
    return votes.partial(stream, values, archive, molecule)


def windowed_sums(stream: DataFrame, values: dict[str, Column], time: str, length: str, delay: str, slide: str | None = None, archive: str = "archive_id", molecule: str = "molecule_id") -> DataFrame:
    """The same per event-time window; rows later than ``delay`` are dropped, and closed windows leave the state."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return timed.groupBy(window.alias("window"), archive, molecule).agg(*[F.sum(c).alias(n) for n, c in values.items()], F.count("*").alias("n"))


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Writes each batch's latest sums under its number, so that a batch written twice counts once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()


def latest(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The newest sums of each key from what to_table() wrote."""
    newest = F.max_by(F.struct(*values, "n"), "batch").alias("__last")
    return df.groupBy(*keys).agg(newest).select(*keys, "__last.*")
