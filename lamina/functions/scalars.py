"""Scalar scores over a few class columns, unrolled so that they stay in generated code."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def elements(array: str | Column, width: int) -> list[Column]:
    array = F.col(array) if isinstance(array, str) else array
    return [F.element_at(array, i + 1).cast("double") for i in range(width)]


def total(values: list[Column]) -> Column:
    return reduce(add, values)


def stable_sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clipped_sigmoid(x: Column, limit: float = 80.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))))


def softmax(logits: list[Column]) -> list[Column]:
    most = F.greatest(*logits)
    raised = [F.exp(x - most) for x in logits]
    whole = total(raised)
    return [x / whole for x in raised]


def logsumexp(logits: list[Column]) -> Column:
    most = F.greatest(*logits)
    return most + F.log(total([F.exp(x - most) for x in logits]))


def energy(logits: list[Column], temperature: float = 1.0) -> Column:
    """-T * logsumexp(x / T); the lower, the more like a known class."""
    if temperature <= 0:
        raise ValueError("the temperature must be positive")
    return -temperature * logsumexp([x / temperature for x in logits])


def softmax_entropy(probabilities: list[Column]) -> Column:
    """Natural logarithm, probabilities clipped at 1e-15."""
    return -total([p * F.log(F.greatest(p, F.lit(1e-15))) for p in probabilities])


def frequency_entropy(frequencies: list[Column]) -> Column:
    """Base 2; a frequency of 0 adds nothing."""
    return total([F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in frequencies])


def margin(values: list[Column]) -> Column:
    """Largest less second largest."""
    ordered = F.sort_array(F.array(*values), asc=False)
    return F.element_at(ordered, 1) - F.element_at(ordered, 2)


def argmax(values: list[Column], labels: tuple[str, ...]) -> Column:
    """Label of the largest value, the first of equal ones."""
    most = F.greatest(*values)
    return reduce(lambda acc, p: F.when(p[0] == most, p[1]).otherwise(acc), list(zip(values, labels))[::-1], F.lit(None).cast("string"))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, NaN for nothing of nothing."""
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(part / whole)


def rate_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return rate_or_zero(2.0 * tp, 2 * tp + fp + fn)


def exceeds(score: Column, threshold: Column | float) -> Column:
    """score > threshold, false for NaN (which Spark holds larger than any number)."""
    return ~F.isnan(score) & (score > threshold)


def dot(values: list[Column], weights: list[float]) -> Column:
    return total([v * float(w) for v, w in zip(values, weights, strict=True)])


def standardised(values: list[Column], means: list[float], scales: list[float], floor: float = 1e-8) -> list[Column]:
    return [(v - float(m)) / (float(s) if s >= floor else 1.0) for v, m, s in zip(values, means, scales, strict=True)]


def logistic_score(values: list[Column], weights: list[float], intercept: float, limit: float = 30.0) -> Column:
    return clipped_sigmoid(dot(values, weights) + intercept, limit)
