"""Registered queries that replay tables as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.plans import reads as R
from lamina.plans.catalog import query, r6
from lamina.sources import files
from lamina.streaming import closing

LENGTH, DELAY = "1 hour", "2 hours"


@query("streamed_votes", """WITH e AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS start, event_id % 50 = 0 AS held FROM events), w AS (SELECT max(start) FILTER (WHERE NOT held) - INTERVAL 2 HOUR AS closed FROM e),
a AS (SELECT e.*, held AND start <= closed AS late FROM e, w), m AS (SELECT event_type, start, user_id, avg(value) AS v, count(*) AS n FROM a WHERE NOT late GROUP BY ALL)
SELECT event_type AS archive, start, CAST(count(v) AS BIGINT) AS molecules, CAST(sum(n) AS BIGINT) AS reads, round(avg(v), 6) AS vote, CAST(NULL AS BIGINT) AS late FROM m GROUP BY event_type, start
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, CAST(count(*) AS BIGINT) FROM a WHERE late""")
def streamed_votes(spark, sf_dir):
    """Events as they come in: half of the time, the other half, rows that were held back, and a row far ahead that closes all. Each is taken by a query that starts again from the checkpoint. The last row counts what came too late."""
    e = R.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.col("value").cast("double").alias("value"))
    held = F.col("event_id") % 50 == 0
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    ahead = e.limit(1).select("event_id", (F.lit(ends["b"]) + F.expr("interval 3650 days")).alias("ts"), "user_id", F.lit(None).cast("string").alias("event_type"), "value")
    middle = F.lit(ends["a"] + (ends["b"] - ends["a"]) / 2) if ends["a"] is not None else F.lit(None)
    parts = [e.where(~held & (F.col("ts") < middle)), e.where(~held & (F.col("ts") >= middle)), e.where(held), ahead]
    source, out, checkpoint = (f"{files.scratch(spark, 'stream')}/{name}" for name in ("in", "out", "checkpoint"))
    late = 0
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(e.schema).parquet(source)
        late += closing.late_rows(closing.run_available(closing.closed_votes(stream, "event_type", "user_id", "value", "ts", LENGTH, DELAY), out, checkpoint))
    votes = spark.read.schema("archive string, start timestamp, molecules long, reads long, vote double").parquet(out)
    found = votes.select("archive", F.col("start").cast("timestamp_ntz").alias("start"), "molecules", "reads", r6("vote", "vote"), F.lit(None).cast("long").alias("late"))
    none = [F.lit(None).cast(t).alias(n) for n, t in found.dtypes if n != "late"]
    return found.unionByName(spark.range(1).select(*none, F.lit(late).cast("long").alias("late")))
