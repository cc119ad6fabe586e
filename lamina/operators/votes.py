"""Two-level soft votes: reads within molecules, then molecules within archives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 17  # of the grids that are held at once


def two_level(df: DataFrame, values: dict[str, Column], archive: list[str] | str = "archive_id", molecule: str = "molecule_id") -> DataFrame:
    """Mean over reads per molecule, then over molecules; not the mean of all reads where molecules differ in size. Both levels aggregate before the shuffle."""
    keys = [archive] if isinstance(archive, str) else list(archive)
    inner = df.groupBy(*keys, molecule).agg(*[F.avg(c).alias(n) for n, c in values.items()], F.count("*").alias("__reads"))
    return inner.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in values], F.count("*").alias("molecules"), F.sum("__reads").alias("reads"))


def partial(df: DataFrame, values: dict[str, Column], archive: list[str] | str = "archive_id", molecule: str = "molecule_id") -> DataFrame:
    """Sums and counts per molecule, the mergeable form."""
    keys = [archive] if isinstance(archive, str) else list(archive)
    return df.groupBy(*keys, molecule).agg(*[F.sum(c).alias(n) for n, c in values.items()], F.count("*").alias("n"))


def merge(parts: DataFrame, values: list[str], archive: list[str] | str = "archive_id", molecule: str = "molecule_id") -> DataFrame:
    """The vote from any number of partial tables."""
    keys = [archive] if isinstance(archive, str) else list(archive)
    whole = parts.groupBy(*keys, molecule).agg(*[(F.sum(v) / F.sum("n")).alias(v) for v in values])
    return whole.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def _running(x: np.ndarray) -> np.ndarray:
    """Running sums along axis 1, with what each addition lost added back: a mean that lies on a threshold passes it, in whatever order molecules come (plainly added, it may end just below)."""
    total, lost, out = np.zeros_like(x[:, 0]), np.zeros_like(x[:, 0]), np.empty_like(x)
    with np.errstate(invalid="ignore"):
        for i in range(x.shape[1]):
            new = x[:, i]
            both = total + new
            rest = both - total
            lost += (total - (both - rest)) + (new - rest)
            total = both
            out[:, i] = np.where(np.isfinite(lost), total + lost, total)  # sums that are infinite or NaN lose nothing
    return out


def _grid(packed: DataFrame, keys: list[str], names: list[str], settings: list[tuple[int, int]]) -> DataFrame:
    """keys, m, q, the votes, molecules and reads of every setting, from rows with an array of reads (molecule index, read index, values)."""
    most_m, most_q = max(m for m, _ in settings), max(q for _, q in settings)
    each = max(1, CELLS // (most_m * most_q))  # archives whose grids are held at once
    at_m, at_q = (np.array([s[i] - 1 for s in settings]) for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, each):
                part = batch.slice(first, each)
                n, reads = part.num_rows, part.column(len(keys))
                owner = np.repeat(np.arange(n), reads.value_lengths().to_numpy())
                inside = reads.flatten()
                m, q = (np.asarray(inside.field(i).to_numpy(zero_copy_only=False), "i8") for i in (0, 1))
                values = [inside.field(2 + i) for i in range(len(names))]
                cell = (owner * most_m + m) * most_q + q
                shape = (n, most_m, most_q)
                there = np.bincount(cell, minlength=n * most_m * most_q).reshape(shape).cumsum(2)
                count, reads_ = (there > 0).cumsum(1)[:, at_m, at_q], there.cumsum(1)[:, at_m, at_q]
                columns = []
                for v in values:
                    some = np.asarray(v.is_valid())
                    x = np.asarray(v.fill_null(0.0).to_numpy(zero_copy_only=False), "f8")
                    size = np.bincount(cell[some], minlength=n * most_m * most_q).reshape(shape).cumsum(2)
                    total = np.bincount(cell, weights=x, minlength=n * most_m * most_q).reshape(shape).cumsum(2)
                    mean = _running(np.divide(total, size, out=np.zeros(shape), where=size > 0))[:, at_m, at_q]
                    voters = (size > 0).cumsum(1)[:, at_m, at_q]
                    columns.append((np.divide(mean, voters, out=np.zeros(mean.shape), where=voters > 0), voters == 0))
                kept = np.flatnonzero(reads_.ravel() > 0)
                row, setting = kept // len(settings), kept % len(settings)
                ids = [c.take(pa.array(row)) for c in part.columns[: len(keys)]]
                votes = [pa.array(v.ravel()[kept], mask=none.ravel()[kept]) for v, none in columns]
                out = [*ids, pa.array(at_m[setting] + 1), pa.array(at_q[setting] + 1), *votes, pa.array(count.ravel()[kept]), pa.array(reads_.ravel()[kept])]
                for i in range(0, len(kept), 1 << 16):
                    yield pa.RecordBatch.from_arrays([x.slice(i, 1 << 16) for x in out], [*keys, "m", "q", *names, "molecules", "reads"])

    kinds = dict(packed.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "m long, q long", *[f"`{n}` double" for n in names], "molecules long, reads long"])
    return packed.mapInArrow(run, schema)


def prefix(df: DataFrame, values: dict[str, Column], settings: list[tuple[int, int]], archive: list[str] | str = "archive_id", molecule: str = "molecule_id", molecule_index: str = "molecule_index", read_index: str = "read_index") -> DataFrame:
    """The vote over the first M molecules and first q reads, for all (M, q) settings from one shuffle.

    The reads inside the largest setting (so many at most for an archive) are packed by archive. Running sums over the reads of a molecule,
    then over molecules, hold every setting's vote, so a full grid costs what its largest setting does. Indices count from 0. A setting without reads
    gives no row; molecules without a value aren't counted into its mean. ``molecule`` is kept for callers that number molecules by it.
    """
    keys = [archive] if isinstance(archive, str) else list(archive)
    if not settings or min(min(s) for s in settings) < 1:
        raise ValueError("settings are pairs of positive numbers")
    most_m, most_q = max(m for m, _ in settings), max(q for _, q in settings)
    inside = df.where((F.col(molecule_index) >= 0) & (F.col(molecule_index) < most_m) & (F.col(read_index) >= 0) & (F.col(read_index) < most_q))
    read = F.struct(F.col(molecule_index).cast("int").alias("m"), F.col(read_index).cast("int").alias("q"), *[c.cast("double").alias(f"v{i}") for i, c in enumerate(values.values())])
    return _grid(inside.groupBy(*keys).agg(F.collect_list(read).alias("reads")), keys, list(values), list(dict.fromkeys(settings)))


def grid(molecules: int, reads: int) -> list[tuple[int, int]]:
    """Every setting up to the largest."""
    return [(m, q) for m in range(1, molecules + 1) for q in range(1, reads + 1)]
