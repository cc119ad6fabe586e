"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a table of prime size in an order of its own (a start and a
step from a hash of its name, so each order holds every slot once). Shards take turns; at
its turn a shard claims the first slot of its order that is free, until the table is full. A key's
hash picks a slot, the slot names the shard: one lookup, near-even shares, and few keys
move when shards come or go. The table has a fixed number of rows and is broadcast.

Defined cases: equal ids go to one slot; a null id counts as the empty text; rows keep their
number, repeated ones too; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import common

SLOTS = 65_537  # prime, a thousand times the shards; about 5 MB when broadcast
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Number of the shard that holds each slot."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("shards must have different names, and no more than slots")
    at = [_number(f"start:{s}") % slots for s in shards]
    step = [_number(f"step:{s}") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            table[at[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: a hash of its text, modulo."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % slots


def place(docs: DataFrame, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """doc_id, slot, shard. Rows stay where they are."""
    table = docs.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))], "slot long, shard string")
    keyed = docs.select(F.col(id_col).alias("doc_id"), slot(F.col(id_col), slots).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select("doc_id", "slot", "shard")


def write_sharded(docs: DataFrame, folder: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> None:
    """Writes the documents, whole, in one folder per shard; the writing tasks of a shard are as many as its rows need, so none grows with the corpus.

    A column of the input named shard is replaced.
    """
    table = docs.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))], "__slot long, __shard string")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard"]
    rows = docs.select(slot(F.col("doc_id"), slots).alias("__key"), F.struct(*kept).alias("__document"))
    placed = rows.join(F.broadcast(table), F.col("__key") == F.col("__slot")).select("__document.*", F.col("__shard").alias("shard"))
    placed.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(folder)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(common.documents(spark, sf_dir))


def oracle() -> str:
    """The table as values; hashing, lookup and shares in SQL."""
    table = ",".join(map(str, lookup_table()))
    return f"""
WITH filled AS (SELECT unnest(range({SLOTS})) AS slot, unnest([{table}]) AS number),
keyed AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::UBIGINT % {SLOTS} AS BIGINT) AS slot FROM documents)
SELECT doc_id, keyed.slot AS slot, 'shard-' || lpad(CAST(number AS VARCHAR), 2, '0') AS shard FROM keyed JOIN filled USING (slot)"""
