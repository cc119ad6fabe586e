"""Session settings for large inputs. Nothing here changes results."""

from __future__ import annotations

from pyspark.sql import SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",  # joins and partition sizes are chosen from what stages measured
    "spark.sql.adaptive.skewJoin.enabled": "true",  # hot keys of joins are split
    "spark.sql.adaptive.coalescePartitions.enabled": "true",  # so that many shuffle partitions cost little where data are few
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",  # texts may be long: the batch of a Python worker stays small
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def builder(app: str, input_bytes: int | None = None) -> SparkSession.Builder:
    """A builder with the recommended settings; shuffles get a partition for about 128 MB of input, 200 at least."""
    b = SparkSession.builder.appName(app)
    for key, value in RECOMMENDED.items():
        b = b.config(key, value)
    if input_bytes is not None:
        b = b.config("spark.sql.shuffle.partitions", str(max(200, -(-input_bytes // (128 << 20)))))
    return b
