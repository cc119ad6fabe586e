"""Distances to known classes. A fitted model is small (classes times dimensions) and lives in literals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.scalars import total


@dataclass(frozen=True)
class ClassModel:
    labels: tuple[str, ...]
    location: np.ndarray  # [D]
    scale: np.ndarray  # [D]
    means: np.ndarray  # [C, D], standardised
    variances: np.ndarray  # [C, D]
    inverses: np.ndarray  # [C, D, D]
    shrinkage: np.ndarray  # [C]
    conditions: np.ndarray  # [C]


TILE = 256  # places to a side


def gram(rows: DataFrame, label: str, vector: str, location: np.ndarray, scale: np.ndarray, labels: tuple[str, ...], tile: int = TILE) -> dict[str, np.ndarray]:
    """Per label the products of its standardised vectors with themselves, behind a place of ones: count, sums and all sums of products, [D + 1, D + 1].

    A task adds up its rows' products and cuts them into tiles; tiles of one place are added up by whichever task their key goes to. What
    reaches the driver are the sums, a row a tile and label, as the fitted model has them too.
    """
    d = len(location)
    starts = range(0, d + 1, tile)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            z = np.column_stack([np.ones(len(x)), (x - location) / scale])
            for name in set(names):
                own = z[names == name]
                sums[name] = sums.get(name, 0.0) + own.T @ own
        for name, whole in sums.items():
            for i in starts:
                for j in starts:
                    if j >= i:  # the others are their mirror images
                        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([i]), pa.array([j]), pa.array([whole[i : i + tile, j : j + tile].ravel()], pa.list_(pa.float64()))], ["label", "i", "j", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, v in zip(zip(*[batch.column(k).to_pylist() for k in range(3)]), batch.column(3)):
                sums[key] = sums.get(key, 0.0) + v.values.to_numpy()
        for (name, i, j), v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([i]), pa.array([j]), pa.array([v], pa.list_(pa.float64()))], ["label", "i", "j", "v"])

    schema = "label string, i long, j long, v array<double>"
    own = rows.where(F.col(label).isin(*labels)).select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x")).where("x is not null")
    found = own.mapInArrow(products, schema).repartition("label", "i", "j").mapInArrow(added, schema).toArrow()
    out = {name: np.zeros((d + 1, d + 1)) for name in labels}
    for name, i, j, v in zip(*[found.column(k).to_pylist() for k in ("label", "i", "j")], found.column("v")):
        part = v.values.to_numpy().reshape(len(range(i, min(d + 1, i + tile))), -1)
        out[name][i : i + tile, j : j + tile] = part
        out[name][j : j + tile, i : i + tile] = part.T
    return out


def fit_vectors(df: DataFrame, vector: str, label: str, labels: tuple[str, ...]) -> ClassModel:
    """Location and scale of all rows, and means, variances and covariances of the labels over whole vectors, however wide the table has them. A label without rows is an error."""
    wide = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "v"))
    places = sorted(wide.groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).collect())
    location, scale = np.array([r["m"] for r in places], float), np.maximum(np.array([r["s"] or 0.0 for r in places], float), SCALE_FLOOR)
    moments = {}
    for name, whole in gram(df, label, vector, location, scale, labels).items():
        n = whole[0, 0]
        if not n:
            raise ValueError(f"no rows of {name}")
        mean = whole[0, 1:] / n
        moments[name] = int(n), mean, (whole[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)
    return _model(labels, location, scale, moments)


def fit(df: DataFrame, features: list[str], label: str, labels: tuple[str, ...]) -> ClassModel:
    """The same for features in columns of their own."""
    return fit_vectors(df.withColumn("__vector", F.array(*[F.col(f).cast("double") for f in features])), "__vector", label, labels)


SCALE_FLOOR, VARIANCE_FLOOR, RIDGE = 1e-8, 1e-4, 1e-8  # fixed values


def _model(labels: tuple[str, ...], location: np.ndarray, scale: np.ndarray, moments: dict[str, tuple[int, np.ndarray, np.ndarray]]) -> ClassModel:
    """moments: rows, mean and covariance (over rows less one) of each class."""
    means, variances, inverses, shrinkage, conditions = [], [], [], [], []
    for name in labels:
        n, mean, covariance = moments[name]
        shrunk, amount = approximated_shrinkage(covariance * (max(n - 1, 0) / max(n, 1)), n)
        means.append(mean)
        variances.append(np.maximum(np.diag(covariance), VARIANCE_FLOOR))
        inverses.append(np.linalg.pinv(shrunk, hermitian=True))
        shrinkage.append(amount)
        conditions.append(np.linalg.cond(shrunk))
    return ClassModel(labels, location, scale, np.array(means), np.array(variances), np.array(inverses), np.array(shrinkage), np.array(conditions))


def approximated_shrinkage(s: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Oracle-approximating shrinkage of a covariance over n towards a multiple of the identity, with a ridge; and how far it goes."""
    d = len(s)
    whole, squares = float(np.trace(s)), float((s**2).sum())
    spread = squares - whole**2 / d  # 0 for a multiple of the identity
    amount = 1.0
    if (n + 1 - 2 / d) * spread > 0:
        amount = min(1.0, max(0.0, ((1 - 2 / d) * squares + whole**2) / ((n + 1 - 2 / d) * spread)))
    level = whole / d
    return (1 - amount) * s + (amount * level + RIDGE * max(level, 1.0)) * np.eye(d), amount


def diagonal(features: list[Column], model: ClassModel) -> list[Column]:
    """Distance to each class under its own variances, in generated code."""
    z = [(f - float(m)) / float(s) for f, m, s in zip(features, model.location, model.scale, strict=True)]
    return [F.sqrt(total([(x - float(m)) * (x - float(m)) / float(v) for x, m, v in zip(z, mean, variance)])) for mean, variance in zip(model.means, model.variances)]


def diagonal_vectors(vector: Column, model: ClassModel) -> Column:
    """Array of the same distances for whole vectors, in Arrow batches."""

    def run(values: pd.Series) -> pd.Series:
        x = (np.stack(values.to_numpy()) - model.location) / model.scale if len(values) else np.empty((0, len(model.location)))
        out = [np.sqrt((((x - mean) ** 2) / variance).sum(axis=1)) for mean, variance in zip(model.means, model.variances)]
        return pd.Series(list(np.stack(out, axis=1)))

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")(vector)


def full(features: Column, model: ClassModel) -> Column:
    """Array of distances under the shrunk covariances; dense algebra in Arrow batches."""

    def run(values: pd.Series) -> pd.Series:
        x = (np.stack(values.to_numpy()) - model.location) / model.scale if len(values) else np.empty((0, len(model.location)))
        out = np.empty((len(x), len(model.labels)))
        for c in range(len(model.labels)):
            gap = x - model.means[c]
            out[:, c] = np.sqrt(np.maximum(np.einsum("nd,de,ne->n", gap, model.inverses[c], gap), 0))
        return pd.Series(list(out))

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")(features)


def class_score(distances: list[Column], predicted: Column, labels: tuple[str, ...], mode: str) -> Column:
    """The predicted class's distance, or the least of all."""
    if mode == "minimum":
        return F.least(*distances)
    if mode == "predicted":
        out = F.lit(None).cast("double")
        for name, d in zip(labels, distances):
            out = F.when(predicted == name, d).otherwise(out)
        return out
    raise ValueError(mode)
