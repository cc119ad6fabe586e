"""Document fingerprints by winnowing.

Hashes of all k-grams of a text are formed by doubling (the hash of 2m characters from
those of its halves), the least hash of every window of w of them is chosen, the
rightmost where several are least, and each choice is kept with its place. Two texts
that share a passage of w + k - 1 characters or more share a fingerprint of it, at places that
tell where. k must be a power of two, or a sum of few, and w a power of two.

Documents are compared with the next one in descending order of their ids: dealt out in
ranges of ids, a partition each, sorted, and read one behind the other, each range closed by a copy of the
first document of the range that follows; texts move once. An id (or null) that holds more than a range's
share is split into ranges by a hash of the texts; rows of one id and one text stay together, read one by one.

Defined cases: a null text counts as empty; an empty text has no fingerprint and is like
another empty one only; a text shorter than k has one hash, of all its characters, and one of
fewer than w k-grams one window; rows of a null id come last; rows of one id are in
the order of a hash of their texts; a single row is its own next one; an empty table gives no rows;
other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import common

GRAM = 12  # characters
WINDOW = 12  # grams, at most 255; any passage of 23 characters in common is found
BLOCK = 1 << 20  # windows worked on at once
RANGES = 1 << 15  # at most; their bounds are looked up in every task
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def gram_hashes(points: np.ndarray, k: int = GRAM) -> np.ndarray:
    """32-bit hashes of all k-grams; one of everything where there are fewer characters."""
    k = min(k, len(points))
    if not k:
        return np.empty(0, "u8")
    power, rolled = _BASE, (points.astype("u8") + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    whole, width, whole_width = None, 1, 0
    rest = k
    while True:  # whole: hash of the part of k that is done, in front
        if rest & 1:
            if whole is None:
                whole, whole_width = rolled, width
            else:
                n = len(points) - whole_width - width + 1
                whole = whole[:n] * power + rolled[whole_width : whole_width + n]
                whole_width += width
        rest >>= 1
        if not rest:
            break
        rolled = rolled[:-width] * power + rolled[width:] if len(rolled) > width else rolled[:0]
        with np.errstate(over="ignore"):
            power = power * power
        width *= 2
    whole = whole ^ (whole >> np.uint64(29))
    whole = whole * np.uint64(0xBF58476D1CE4E5B9)
    return whole >> np.uint64(32)


def winnow(text: str | None, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their places, in order of place."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4")
    n = max(1, len(points) - k + 1) if len(points) else 0
    found: list[np.ndarray] = []
    for start in range(0, max(1, n - w + 1) if n else 0, BLOCK):
        last = min(n, start + BLOCK + w - 1)
        hashes = gram_hashes(points[start : last + k - 1], k)[: last - start]
        places = np.arange(start, start + len(hashes), dtype="u8")
        least = hashes << np.uint64(32) | (_LOW - places)  # of equal hashes the rightmost is least
        span, whole = 1, min(w, len(hashes))
        while span < whole:
            step = min(span, whole - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        found.append(least[np.append(True, least[1:] != least[:-1])])
    if not found:
        return np.empty(0, "u4"), np.empty(0, "u4")
    all_found = np.concatenate(found)
    all_found = all_found[np.append(True, all_found[1:] != all_found[:-1])]
    return (all_found >> np.uint64(32)).astype("u4"), (_LOW - (all_found & _LOW)).astype("u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the different hashes of two fingerprints that they have in common."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def written(hashes: np.ndarray, places: np.ndarray) -> str:
    """Base 64 of the choices, five bytes each: the hash, and how far its place is behind the one before (a window at most)."""
    raw = np.empty((len(hashes), 5), "u1")
    raw[:, :4] = hashes.astype("<u4").view("u1").reshape(-1, 4)
    raw[:, 4] = np.diff(places.astype("i8"), prepend=0)
    return base64.b64encode(raw.tobytes()).decode()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(base64.b64decode(fingerprint), "u1").reshape(-1, 5)
    return raw[:, :4].copy().view("<u4").ravel(), np.cumsum(raw[:, 4].astype("u4"), dtype="u4")


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the start of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def in_ranges(docs: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """doc_id, text, order (a hash of the text), range number, and ghost: true for the copy of the first row of the range that follows (of the first range, behind the last); and how many ranges there are.

    Bounds are quantiles of the ids. An id that is several quantiles holds as many ranges, and rows are dealt to them by the hash.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("order", F.xxhash64("text"))
    n, known = source.select("doc_id").agg(F.count("*"), F.count("doc_id")).first()
    quantiles = source.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 and known else []
    bounds, times = np.unique(np.array(quantiles, "i8"), return_counts=True)
    bounds, times = bounds[::-1], times[::-1]  # ids in descending order
    before = np.append(0, np.cumsum(times))  # ranges before each bound's
    nulls = max(1, round((n - known) * ranges / max(1, n)))

    def number(ids: pa.Array, order: pa.Array) -> pa.Array:
        none = np.asarray(pc.is_null(ids))
        value, part = np.asarray(pc.fill_null(ids, 0)), np.asarray(order).astype("f8") / 2.0**64 + 0.5
        at = np.searchsorted(-bounds, -value)  # bounds above the id
        same = np.zeros(len(value), bool)
        if len(bounds):
            same = bounds[np.minimum(at, len(bounds) - 1)] == value
        split = np.where(same, np.append(times, 1)[at] - 1, 0)
        found = before[at] + np.minimum((part * (split + 1)).astype("i8"), split)
        return pa.array(np.where(none, before[-1] + 1 + np.minimum((part * nulls).astype("i8"), nulls - 1), found).astype("i4"))

    number.__annotations__ = {"ids": pa.Array, "order": pa.Array, "return": pa.Array}
    rows = source.withColumn("range", F.arrow_udf(number, "int")("doc_id", "order"))
    first = F.max(F.struct("doc_id", F.expr("~`order`").alias("o"))).alias("first")
    tops = rows.groupBy("range").agg(first).orderBy("range").collect()  # a row per range
    count = int(before[-1]) + 1 + nulls
    if not tops:
        return rows.withColumn("ghost", F.lit(False)), count
    used = [r["range"] for r in tops]
    leads = spark.createDataFrame([(r["range"], r["first"]["doc_id"], ~r["first"]["o"], used[i - 1]) for i, r in enumerate(tops)], "__range int, __top long, __order long, __to int")
    leading = rows.join(F.broadcast(leads), (F.col("range") == F.col("__range")) & (F.col("order") == F.col("__order")) & F.col("doc_id").eqNullSafe(F.col("__top")))
    ghosts = leading.groupBy("__to", "doc_id", "order").agg(F.min("text").alias("text")).select("doc_id", "text", "order", F.col("__to").alias("range"), F.lit(True).alias("ghost"))
    return rows.withColumn("ghost", F.lit(False)).unionByName(ghosts), count


def compare_with_next(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Per row its fingerprint, that of its edited text, and the likeness of its fingerprint to that and to the next document's."""
    rows_, ranges = in_ranges(docs, min(RANGES, common.shuffle_partitions(docs.sparkSession)))
    dealt = rows_.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "ghost", F.col("doc_id").desc_nulls_last(), "order", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            before = None
            for batch in batches:
                for doc_id, number, ghost, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                    text = text.as_py()
                    own = winnow(text, k, w)
                    if before is not None and before[1] == number:
                        yield row(*before, text, own)
                    before = None if ghost else (doc_id, number, text, own)

        def row(doc_id, _, text, own, following, next_print):
            changed = edited(text, following)
            other = winnow(changed, k, w)
            return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), written(*own), written(*other), likeness(own[0], other[0]), likeness(own[0], next_print[0])

        yield from common.sliced(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], rows())

    return dealt.select("doc_id", "range", "ghost", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(common.documents(spark, sf_dir))
