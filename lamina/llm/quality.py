"""Quality classifier from positive and unlabelled texts (non-negative risk).

Trusted positives and unlabelled texts are enough: with the estimated share of
positives among the unlabelled, the risk of a classifier is

    prior * R(positive as positive) + max(0, R(unlabelled as negative) - prior * R(positive as negative))

and is minimised by gradient steps; where the bracket falls below zero, a step back is
taken on it instead. The prior comes from the scores of a first classifier, positives
against unlabelled, on rows it hasn't seen: no threshold can keep a smaller share of the
unlabelled than the prior times the share it keeps of the positives.

Defined cases: a null text counts as empty and is scored like any text; a null label is no
label, a label of 1 makes a positive where no row of the same id says 0; repeated rows
are scored each; without any positive the score is 0.5 for every text; other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import common

POSITIVES = 6000  # labelled rows learned from at most
UNLABELLED = 12000  # texts without regard to labels learned from, at most
THRESHOLD = 0.3
STEPS = 600
CLASSES = 12


def _classes() -> np.ndarray:
    """Byte -> kind of character."""
    table = np.full(256, 9, "u1")
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[[ord(" "), ord("\t")]] = 3
    table[[ord("\n"), ord("\r")]] = 4
    table[[ord("."), ord("?")]] = 5
    table[[ord(","), ord(";"), ord(":"), ord("-")]] = 6
    table[[ord(c) for c in "\"'()[]{}"]] = 7
    table[[ord("|"), ord("<"), ord(">")]] = 8
    table[ord("!")] = 10
    table[128:] = 11
    return table


_CLASS = _classes()
BLOCK = 1 << 22  # bytes classified at once


def features(text: str | None) -> np.ndarray:
    """How often each kind of character follows each other one, and shares of repeated words."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), "u1")
    pairs = np.zeros(CLASSES * CLASSES)
    for start in range(0, len(raw), BLOCK):
        kinds = _CLASS[raw[start : start + BLOCK + 1]].astype("u2")
        pairs += np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
    words = (text or "").split()
    n = len(words)
    again = sum(a == b for a, b in zip(words, words[1:]))
    other = [again / n, len(set(words)) / n, len(raw) / n] if n else [0.0, 0.0, 0.0]
    return np.array([*np.sqrt(pairs / max(1, len(raw))), np.sqrt(other[0]), other[1], np.log1p(other[2]), np.log1p(n), np.log1p(len(raw))])


WIDTH = CLASSES * CLASSES + 5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Standardised features and one linear score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, np.zeros(len(mean) + 1)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.inputs(x) @ self.weights)

    def descend(self, gradient, steps: int, rate: float = 0.04) -> None:
        """Adam."""
        first, second = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for t in range(1, steps + 1):
            g = gradient(self.weights)
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            self.weights = self.weights - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores of both: the least ratio of the shares above a threshold, each with its margin of error."""
    thresholds = np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, 201))
    p = 1 - np.searchsorted(np.sort(positive), thresholds) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), thresholds) / len(unlabelled)
    margin = np.sqrt(np.log(4 / delta) / 2 / len(unlabelled)) + np.sqrt(np.log(4 / delta) / 2 / len(positive))
    ok = p > margin
    if not ok.any():
        return 0.5
    bound = (u + margin) / np.where(ok, p, 1)
    best = np.argmin(np.where(ok, bound, np.inf))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS, ridge: float = 1e-3, prior: float | None = None) -> tuple[Model, float]:
    """The classifier and the prior."""
    both = np.vstack([positive, unlabelled])
    model = Model(both.mean(axis=0), np.maximum(both.std(axis=0), 1e-3))
    p, u = model.inputs(positive), model.inputs(unlabelled)
    decay = np.append(np.full(p.shape[1] - 1, ridge), 0.0)
    if prior is None:
        first = Model(model.mean, model.scale)
        half, rest = p[::2], u[::2]
        first.descend(lambda w: decay * w + 0.5 * (rest.T @ sigmoid(rest @ w) / len(rest) - half.T @ (1 - sigmoid(half @ w)) / len(half)), steps // 3)
        prior = estimate_prior(sigmoid(p[1::2] @ first.weights), sigmoid(u[1::2] @ first.weights)) if len(p) > 1 and len(u) > 1 else 0.5

    risk = risk_gradient(p, u, prior)
    model.descend(lambda w: decay * w + risk(w), steps)
    return model, prior


def risk_gradient(p: np.ndarray, u: np.ndarray, prior: float):
    """Gradient of the non-negative risk for inputs of positives and unlabelled; where the bracket is below zero, of the step back on it."""

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        as_positive = prior * (p.T @ (sp - 1)) / len(p)
        negative_risk = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
        as_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        return as_positive + as_negative if negative_risk >= 0 else -as_negative

    return gradient


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Fits on a bounded sample chosen by a hash of the ids: at most ``positives`` texts labelled 1 and ``unlabelled`` texts of any kind. Labels come from rows outside the held-out fifth."""
    order = F.xxhash64("doc_id", F.lit(5))
    trusted = labels.where((common.doc_bucket("doc_id", 5) != 0) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(common.doc_bucket("doc_id", 5) != 0)
    n = texts.select("doc_id").count()
    if not n:
        return None
    share = min(1.0, 1.2 * unlabelled / n)
    sampled = texts.where((F.xxhash64("doc_id", F.lit(6)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) < share)
    chosen = F.broadcast(trusted.orderBy(order, "doc_id").limit(positives).select("doc_id"))
    p = _matrix(texts.join(chosen, "doc_id"), positives)
    u = _matrix(sampled, unlabelled)
    return fit(p, u)[0] if len(p) and len(u) else None


def _matrix(texts: DataFrame, most: int) -> np.ndarray:
    """Features of at most ``most`` texts, in the order of a hash of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["doc_id", "x"])

    rows = texts.select("doc_id", "text").mapInArrow(run, "doc_id long, x binary").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "x").limit(most).collect()
    return np.array([np.frombuffer(r.x) for r in rows]).reshape(-1, WIDTH)


def quality(text: Column, model: Model | None) -> Column:
    """Score from 0 to 1 of a column of texts."""

    def score(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(np.concatenate([model.score(np.array([features(t if isinstance(t, str) else None) for t in texts[i : i + 256]])) for i in range(0, len(texts), 256)] or [np.empty(0)]))

    score.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(score, "double")(text.cast("string"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", quality(F.col("text"), model).alias("score"))
    return scored.select("doc_id", (common.doc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of score THRESHOLD or more."""
    return docs.where(quality(F.col("text"), learn(docs, labels)) >= THRESHOLD)
