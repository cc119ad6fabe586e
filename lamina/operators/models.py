"""Models fitted on archive features: principal components, and a weighted logistic score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import storage
from lamina.functions import scalars


@dataclass(frozen=True)
class Proxy:
    mean: np.ndarray  # [D]
    scale: np.ndarray  # [D]
    components: np.ndarray  # [P, D]
    coefficients: np.ndarray  # [P]
    intercept: float
    ridge: float


def moments(df: DataFrame, features: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each dimension; deviations under 1e-8 count as 1."""
    v = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("v"))
    r = v.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select("s.mean", "s.variance", "s.count").first()
    deviation = np.sqrt(r[1].toArray() * (r[2] - 1) / max(1, r[2]))
    return r[0].toArray(), np.where(deviation < 1e-8, 1.0, deviation)


def standardised(features: str, mean: np.ndarray, scale: np.ndarray) -> Column:
    m, s = F.array(*map(F.lit, map(float, mean))), F.array(*map(F.lit, map(float, scale)))
    gap = F.zip_with(F.col(features).cast("array<double>"), m, lambda x, y: x - y)
    return F.zip_with(gap, s, lambda x, y: x / y)


def projected(vector: Column, components: np.ndarray) -> list[Column]:
    """Dot products with each component; the vector is centred before."""
    return [F.aggregate(F.zip_with(vector, F.array(*map(F.lit, map(float, c))), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) for c in components]


def fit_components(df: DataFrame, features: str, count: int, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Signs are fixed by the largest weight of each component, so that fits agree."""
    v = df.select(array_to_vector(standardised(features, mean, scale)).alias("v"))
    found = PCA(k=count, inputCol="v", outputCol="w").fit(v).pc.toArray().T
    largest = np.abs(found).argmax(axis=1)
    return found * np.sign(found[np.arange(len(found)), largest])[:, None]


STEPS, SETTLED, BEYOND, FLOOR = 80, 1e-8, 30.0, 1e-9  # fixed values: most steps, the last step's length, where the logistic curve is cut, and what is added to the diagonal


def newton(rows: DataFrame, ridge: float, intercept_penalised: bool = False) -> np.ndarray:
    """Coefficients, the intercept behind them, of a weighted logistic fit of rows (x: array of doubles, y: 0 or 1, w: weight).

    Each step is one job: tasks sum gradient and curvature of their rows as dense products, and the sums of all tasks are added by place, so the
    driver gets (D + 1) * (D + 2) numbers, however many rows there are. Rows with a null or of weight 0 don't count.
    """
    kept = rows.where("x is not null and y is not null and w > 0").select(F.col("x").cast("array<double>"), F.col("y").cast("double"), F.col("w").cast("double"))
    first = kept.select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("no rows to fit")
    d = first["d"] + 1
    penalty = np.eye(d) * float(ridge)
    if not intercept_penalised:
        penalty[-1, -1] = 0.0
    at = np.zeros(d)
    for _ in range(STEPS):
        sums = _curvature(kept, at)
        gradient, hessian = sums[:d] + penalty @ at, sums[d:].reshape(d, d) + penalty + np.eye(d) * FLOOR
        step = np.linalg.solve(hessian, gradient)
        at = at - step
        if np.linalg.norm(step) < SETTLED:
            break
    return at


def _curvature(rows: DataFrame, at: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the weighted loss, one behind the other."""
    d = len(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + d * d)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d - 1)
            y, w = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            design = np.column_stack([x, np.ones(len(x))])
            p = 1.0 / (1.0 + np.exp(-np.clip(design @ at, -BEYOND, BEYOND)))
            total[:d] += design.T @ (w * (p - y))
            total[d:] += (design.T @ ((w * p * (1.0 - p))[:, None] * design)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["pos", "v"])

    found = rows.mapInArrow(run, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros(d + d * d)
    for r in found:
        sums[r["pos"]] = r["v"]
    return sums


def fit_proxy(df: DataFrame, features: str, label: str, count: int = 8, ridge: float = 1e-2) -> Proxy:
    """Label 1 are the anomalies. Both classes weigh one half; the intercept isn't penalised. The reduced rows are written once for all steps."""
    mean, scale = moments(df, features)
    components = fit_components(df, features, count, mean, scale)
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        raise ValueError("both classes are needed")
    weight = F.when(F.col(label) == 1, 0.5 / sizes[1]).otherwise(0.5 / sizes[0])
    path = storage.scratch(df.sparkSession, "newton")
    df.select(F.array(*projected(standardised(features, mean, scale), components)).alias("x"), F.col(label).cast("double").alias("y"), weight.alias("w")).write.parquet(path)
    found = newton(df.sparkSession.read.parquet(path), ridge)
    storage.delete(df.sparkSession, path)
    return Proxy(mean, scale, components, found[:-1], float(found[-1]), ridge)


def proxy_score(features: str, model: Proxy) -> Column:
    z = projected(standardised(features, model.mean, model.scale), model.components)
    return scalars.logistic_score(z, list(model.coefficients), model.intercept)
