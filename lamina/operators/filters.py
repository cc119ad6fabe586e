"""A runtime filter of keys: bits set by an aggregation, looked up where rows are scanned, with an exact semi join behind it.

Of a large table only rows whose key passes go into the shuffle of the join, but for the few that the bits let through by chance. The bits have a size bound
(MOST), so what every executor gets does; with more keys than fit well they let more rows through, and the join is as exact as before.

Defined cases: rows of a null key don't pass, as in a semi join; without keys nothing passes; repeated keys count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 1 << 26  # bits: 8 MB
PER_KEY, PROBES = 12, 4  # less than one row of a hundred gets through by chance


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """PROBES places of each hash, by steps of a second hash."""
    h = hashes.view("u8")
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) % np.uint64(bits)).astype("i8")


def bits_of(keys: DataFrame, key: str, most: int = MOST) -> np.ndarray:
    """The filter's words. Tasks set bits of their keys; words are joined by OR before they come to the driver."""
    hashed = keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))
    n = hashed.count()
    bits = 1 << max(6, min(most.bit_length() - 1, (max(1, n) * PER_KEY - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, "u8")
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(), bits):
                np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype("u8"))
        some = np.flatnonzero(words)
        for i in range(0, len(some), 1 << 16):
            part = some[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words[part].view("i8"))], ["place", "word"])

    rows = hashed.mapInArrow(run, "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word"))
    words = np.zeros(bits // 64, "i8")
    found = rows.toArrow()  # at most a row for each word
    words[found.column("place").to_numpy()] = found.column("word").to_numpy()
    return words.view("u8")


def might_hold(key: Column, words: np.ndarray, spark) -> Column:
    """False only for keys that the filter doesn't hold."""
    shared, bits = spark.sparkContext.broadcast(words), len(words) * 64

    def probe(hashes: pa.Array) -> pa.Array:
        found, out = shared.value, np.ones(len(hashes), bool)
        for at in _places(hashes.to_numpy(zero_copy_only=False).astype("i8"), bits):
            out &= (found[at >> 6] >> (at & 63).astype("u8")) & np.uint64(1) == 1
        return pa.array(out)

    probe.__annotations__ = {"hashes": pa.Array, "return": pa.Array}
    return F.arrow_udf(probe, "boolean")(F.xxhash64(key))


def passing(rows: DataFrame, keys: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """The rows whose key is among ``keys``: by the bits where they are scanned, then exactly."""
    near = rows.where(F.col(key).isNotNull()).where(might_hold(F.col(key), bits_of(keys, key, most), rows.sparkSession))
    return near.join(keys.select(key).distinct(), key, "left_semi")
