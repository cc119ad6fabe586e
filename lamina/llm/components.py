"""Connected components of an edge table, by stars that are joined within partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import common

SLICE = 1_000_000  # edges that a task joins at once


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the least node that is reached) for all nodes of the columns a, b.

    Edges point from a node to a lesser one. Each round points edges that end in a node with an edge of its own at
    that one's least end, then brings the edges of a node together; before and after, each task replaces its
    edges by stars. So a node has a row from each task at most, however many edges it has, and hubs are only
    looked up (a plain join, of which Spark splits large partitions). All is done when the edges are stars; the
    number of rounds grows with the logarithm of the longest path. Rounds are written to the checkpoint folder,
    and deleted with the files of their shuffles once the next one stands there.

    Defined cases: edges with a null end and edges of a node with itself are left out, with the nodes that
    have no other edge; repeated edges count once; an empty table gives no rows.
    """
    edges = _met(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(rounds):
        middle = common.written(_middle(edges), "middle")
        if middle.isEmpty():
            common.discard(middle)
            break
        least = middle.where("ends > 0").select(F.col("node").alias("b"), "least")
        now = _met(edges.join(least, "b", "left").select("a", F.coalesce("least", "b").alias("b")))
        common.discard(edges)
        common.discard(middle)
        edges = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())


def _middle(edges: DataFrame) -> DataFrame:
    """The nodes that keep the edges from being stars, as they have several lesser neighbours, or lesser and greater ones: node, its least neighbour, and how many edges end there."""
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("least")), F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("least")))).alias("x")).select("x.*")
    nodes = both.groupBy("node").agg(F.min("least").alias("least"), F.count("least").alias("starts"), F.count(F.when(F.col("least").isNull(), 1)).alias("ends"))
    return nodes.where("starts > 1 or starts > 0 and ends > 0").select("node", "least", "ends")


def _met(edges: DataFrame) -> DataFrame:
    """The edges as stars of each task's, written, after those of one greater end have met in a task."""
    stars = lambda df: df.select("a", "b").mapInArrow(_stars, "a long, b long")
    return common.written(stars(stars(edges).repartition("a").sortWithinPartitions("a")), "edges")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect the same nodes: each slice of rows as stars. In rows sorted by a, a node's edges are in one slice."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        rows += batch.num_rows
        if rows >= SLICE:
            a, b = (np.concatenate(x) for x in zip(*held))
            whole = int(np.flatnonzero(np.append(True, a[1:] != a[:-1]))[-1]) or len(a)  # the last node's edges go on in the next slice
            yield _batch(*star(a[:whole], b[:whole]))
            held, rows = [(a[whole:], b[whole:])], len(a) - whole
    if rows:
        yield _batch(*star(*(np.concatenate(x) for x in zip(*held))))


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]
