"""Structure of sequences in one pass: a summary of each stretch that merges with the next one's.

A summary has the counts of bases, of ordered pairs of neighbours and of equal letters at each lag, the bases in closed runs and the longest of
them, the open run at either end, and the first and last EDGE letters. Two summaries of neighbouring stretches make that of
both: runs that meet are joined, and pairs and lags across the border are read off the edges. So a long sequence is cut into
stretches, which are summed up wherever they lie, and what is brought together for it are their summaries in order.

Defined cases: a null or empty sequence has zeros everywhere; letters other than A, C, G, T count to the length and to lags, but are no
base, no part of a pair and no run; letters outside of ASCII count by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import scalars
from lamina.functions.sequences import BASES, LAGS

STRETCH = 1 << 20  # letters
SLICE = 1 << 20  # bytes that are looked at at once
EDGE = max(LAGS)
LONG = 3  # a run of so many bases or more is long
PAIRS = [a + b for a in BASES for b in BASES]
_CODE = np.full(256, 4, "u1")
for _i, _b in enumerate(BASES.encode()):
    _CODE[_b] = _i
_COUNTS = ["length", *[f"base_{b}" for b in BASES], *[f"pair_{p}" for p in PAIRS], *[f"lag_{k}" for k in LAGS]]
NAMES = [*_COUNTS, "longest_run", "long_bases"]


@dataclass
class Summary:
    counts: np.ndarray  # in the order of _COUNTS
    longest: int = 0  # closed runs only
    long: int = 0  # bases of closed runs of LONG or more
    front: tuple[int, int] = (4, 0)  # open run at the front: base, length
    back: tuple[int, int] = (4, 0)
    head: bytes = b""
    tail: bytes = b""

    @property
    def one_run(self) -> bool:
        return self.front[0] < 4 and self.front[1] == self.counts[0]

    def with_run(self, run: tuple[int, int]) -> None:
        """Closes a run."""
        if run[0] < 4:
            self.longest = max(self.longest, run[1])
            self.long += run[1] if run[1] >= LONG else 0

    def values(self) -> list[int]:
        """What the finished sequence has, in the order of NAMES."""
        out = Summary(self.counts, self.longest, self.long)
        out.with_run(self.front)
        if not self.one_run:
            out.with_run(self.back)
        return [*map(int, self.counts), out.longest, out.long]


def merged(a: Summary, b: Summary) -> Summary:
    if not a.counts[0] or not b.counts[0]:
        return b if not a.counts[0] else a
    out = Summary(a.counts + b.counts, max(a.longest, b.longest), a.long + b.long)
    left, right = _CODE[a.tail[-1]], _CODE[b.head[0]]
    if left < 4 and right < 4:
        out.counts[1 + 4 + left * 4 + right] += 1
    for i, k in enumerate(LAGS):
        for j in range(min(k, len(b.head))):
            at = len(a.tail) + j - k
            out.counts[1 + 4 + 16 + i] += at >= 0 and a.tail[at] == b.head[j]
    meets = a.back[0] < 4 and a.back[0] == b.front[0]
    middle = (a.back[0], a.back[1] + b.front[1]) if meets else None
    out.front, out.back = a.front, b.back
    if meets:
        if a.one_run:
            out.front = middle
        if b.one_run:
            out.back = middle
        if not a.one_run and not b.one_run:
            out.with_run(middle)
    else:
        if not a.one_run:
            out.with_run(a.back)
        if not b.one_run:
            out.with_run(b.front)
    out.head, out.tail = (a.head + b.head)[:EDGE], (a.tail + b.tail)[-EDGE:]
    return out


def read_as(letters: dict[str, str]) -> bytes:
    """A table of what each byte is read as; bytes that aren't named are left out."""
    table = bytearray(256)
    for k, v in letters.items():
        table[ord(k)] = ord(v)
    return bytes(table)


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """Rows of about SLICE bytes, one row at least: what is made for each letter is many times its size."""
    ends = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        n = max(1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1 - at)
        yield column.slice(at, n)
        at += n


def summaries(values: pa.Array, table: bytes | None = None) -> list[Summary]:
    """Of each sequence of a column, or of what ``table`` (of read_as) makes of it; slice by slice, all at once over a slice's bytes."""
    column = values.cast(pa.binary()).fill_null(b"")
    return [s for part in _slices(column) for s in _summaries(part, table)] if len(column) else []


def _summaries(column: pa.Array, table: bytes | None) -> list[Summary]:
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + n + 1].astype("i8")
    data = np.frombuffer(column.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if table is not None:
        data = np.frombuffer(table, "u1")[data]
        offsets = np.append(0, np.cumsum(data != 0))[offsets]
        data = data[data != 0]
    sizes = np.diff(offsets)
    counts = np.zeros((n, len(_COUNTS)), "i8")
    counts[:, 0] = sizes
    owner, code = np.repeat(np.arange(n), sizes), _CODE[data]
    counts[:, 1:5] = np.bincount(owner * 5 + code, minlength=n * 5).reshape(n, 5)[:, :4]
    if len(data):
        near = (owner[1:] == owner[:-1]) & (code[1:] < 4) & (code[:-1] < 4)
        counts[:, 5:21] = np.bincount(owner[1:][near] * 16 + code[:-1][near].astype("i8") * 4 + code[1:][near], minlength=n * 16).reshape(n, 16)
        for i, k in enumerate(LAGS):
            same = (data[k:] == data[:-k]) & (owner[k:] == owner[:-k]) if len(data) > k else np.zeros(0, bool)
            counts[:, 21 + i] = np.bincount(owner[k:][same], minlength=n)
        first = np.flatnonzero(np.append(True, (data[1:] != data[:-1]) | (owner[1:] != owner[:-1])))
        length, base, whose = np.diff(np.append(first, len(data))), code[first].astype("i8"), owner[first]
        starts, ends = np.searchsorted(whose, np.arange(n)), np.searchsorted(whose, np.arange(n), "right")
        inner = np.ones(len(first), bool)  # neither at the front nor at the back
        inner[starts[ends > starts]] = False
        inner[ends[ends > starts] - 1] = False
        inner &= base < 4
        longest = np.zeros(n, "i8")
        np.maximum.at(longest, whose[inner], length[inner])
        long = np.bincount(whose[inner & (length >= LONG)], weights=length[inner & (length >= LONG)], minlength=n).astype("i8")
    out = []
    for i in range(n):
        s = Summary(counts[i])
        if sizes[i]:
            a, b = starts[i], ends[i] - 1
            s.longest, s.long = int(longest[i]), int(long[i])
            s.front, s.back = (int(base[a]), int(length[a])), (int(base[b]), int(length[b]))
            s.head, s.tail = data[offsets[i] : min(offsets[i + 1], offsets[i] + EDGE)].tobytes(), data[max(offsets[i], offsets[i + 1] - EDGE) : offsets[i + 1]].tobytes()
        out.append(s)
    return out


def counted(df: DataFrame, sequence: str, keys: list[str], stretch: int = STRETCH, table: bytes | None = None) -> DataFrame:
    """keys and the counts NAMES of each row's sequence, or of what ``table`` (of read_as) makes of its text. Rows of up to ``stretch`` bytes stay where they are."""
    width = len(NAMES)
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"{n} long" for n in NAMES]])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([s.values() for s in summaries(batch.column(len(keys)), table)], "i8").reshape(-1, width)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[pa.array(found[:, i]) for i in range(width)]], [*keys, *NAMES])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = summaries(batch.column(2), table)
            rows = [[*map(int, s.counts), s.longest, s.long, *s.front, *s.back] for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int64())), pa.array([s.head for s in found], pa.binary()), pa.array([s.tail for s in found], pa.binary())], ["__row", "__at", "numbers", "head", "tail"])

    def joined(rows: pa.Array) -> pa.Array:
        out = []
        for parts in rows.to_pylist():
            total = Summary(np.zeros(len(_COUNTS), "i8"))
            for p in sorted(parts, key=lambda p: p["__at"]):
                n = p["numbers"]
                total = merged(total, Summary(np.array(n[:-6], "i8"), n[-6], n[-5], tuple(n[-4:-2]), tuple(n[-2:]), p["head"], p["tail"]))
            out.append(total.values())
        return pa.array(out, pa.list_(pa.int64()))

    joined.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    size = F.octet_length(sequence)
    short = df.where(F.coalesce(size, F.lit(0)) <= stretch).select(*keys, sequence).mapInArrow(whole, schema)
    long = df.where(size > stretch).select(*keys, F.col(sequence).cast("binary").alias("__s")).withColumn("__row", F.uuid())
    starts = F.sequence(F.lit(0), F.length("__s") - 1, F.lit(stretch))
    cut = long.select("__row", F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.substring(F.col("__s"), i + 1, F.lit(stretch)).alias("s")))).alias("c"), F.struct(*keys).alias("keys"))
    stretches = cut.select("__row", "c.at", F.when(F.col("c.at") == 0, F.col("keys")).alias("keys"), "c.s").repartition("__row", "at")
    keyed = stretches.select(F.struct("__row", "keys").alias("__row"), F.col("at").alias("__at"), "s")
    row_kind = dict(keyed.dtypes)["__row"]
    parts = keyed.mapInArrow(each, f"__row {row_kind}, __at int, numbers array<long>, head binary, tail binary")
    grouped = parts.groupBy("__row.__row").agg(F.collect_list(F.struct("__at", "numbers", "head", "tail")).alias("parts"), F.max_by("__row.keys", F.when(F.col("__at") == 0, 1)).alias("keys"))
    values = grouped.select("keys.*", F.arrow_udf(joined, "array<long>")("parts").alias("v"))
    return short.unionByName(values.select(*keys, *[F.col("v")[i].alias(n) for i, n in enumerate(NAMES)]))


def frequencies() -> list[Column]:
    return [scalars.rate_or_zero(F.col(f"base_{b}"), F.col("length")) for b in BASES]


def features(padded_length: int) -> dict[str, Column]:
    """The 33 features of one sequence, of the columns of counted()."""
    n = F.col("length")
    base, pair = frequencies(), [F.col(f"pair_{p}") / F.greatest(n - 1, F.lit(1)) for p in PAIRS]
    found = {"length": n / padded_length}
    found |= {f"base_{b}": c for b, c in zip(BASES, base)}
    found |= {"gc": scalars.rate_or_zero(F.col("base_G") + F.col("base_C"), n), "base_entropy": scalars.frequency_entropy(base)}
    found |= {f"pair_{p}": c for p, c in zip(PAIRS, pair)}
    found |= {"pair_entropy": scalars.frequency_entropy(pair), "longest_run": scalars.rate_or_zero(F.col("longest_run"), n), "long_run_fraction": scalars.rate_or_zero(F.col("long_bases"), n)}
    found |= {f"lag_{k}": F.when(n > k, F.col(f"lag_{k}") / (n - k)).otherwise(0.0) for k in LAGS}
    return found
