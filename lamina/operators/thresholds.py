"""Threshold selection: order statistics and the macro-F1 scan, without single-task sorts."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import labels as L
from lamina.operators import votes
from lamina.operators.metrics import by_score
from lamina.operators.ordered import running


@dataclass(frozen=True)
class Thresholds:
    presence: float
    unknown_energy: float
    known_acceptance: float = 0.95
    temperature: float = 1.0

    def row(self) -> dict[str, float]:
        return asdict(self)


def order_statistics(df: DataFrame, score: str, targets: list[float], by: list[str] | None = None) -> DataFrame:
    """The ceil(target * n)-th smallest score for every target: the least that accepts that share. One pass for all."""
    by = by or []
    if not all(0 < t <= 1 for t in targets):
        raise ValueError("targets are shares above 0, up to 1")
    finite = df.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")))
    counts = finite.groupBy(*by, F.col(score).alias("score")).agg(F.count("*").alias("n"))
    r = running(counts, "score", ["n"], by)
    each = r.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    reached = F.col("cum_n") >= F.greatest(F.ceil(F.col("target") * F.col("total_n")), F.lit(1))
    return each.where(reached).groupBy(*by, "target").agg(F.min("score").alias("threshold"))


def presence_scan(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Every candidate threshold of the rule score >= threshold with its binary macro-F1: midpoints of neighbouring scores, and a step beyond either end."""
    r = running(by_score(df, score, positive), "score", ["p", "n"])
    ends = r.agg(F.min("score"), F.max("score"), F.max("total_p"), F.max("total_n")).first()
    if ends[0] is None or not ends[2] or not ends[3]:
        raise ValueError("both classes are needed")
    low, high, p, n = ends
    lowest = low if low == high else math.nextafter(low, -math.inf)
    inner = r.where("next_value is not null").select(((F.col("score") + F.col("next_value")) / 2).alias("threshold"), (F.col("total_p") - F.col("cum_p")).alias("tp"), (F.col("total_n") - F.col("cum_n")).alias("fp"))
    outer = df.sparkSession.createDataFrame([(lowest, p, n), (math.nextafter(high, math.inf), 0, 0)], "threshold double, tp long, fp long")
    tp, fp = F.col("tp"), F.col("fp")
    one = 2.0 * tp / (tp + fp + p)  # no denominator is 0: both classes have rows
    none = 2.0 * (n - fp) / ((n - fp) + (p - tp) + n)
    return inner.union(outer).select("threshold", ((one + none) / 2).alias("macro_f1"))


def best_threshold(scan: DataFrame) -> DataFrame:
    """The best macro-F1; of equal ones (to 1e-12) the threshold nearest 0.5, then the smaller. Two aggregations, no sort."""
    top = scan.agg(F.max("macro_f1").alias("best"))
    tied = scan.join(F.broadcast(top), F.col("macro_f1") >= F.col("best") - 1e-12)
    return tied.agg(F.min_by(F.struct("threshold", "best"), F.struct(F.abs(F.col("threshold") - 0.5), "threshold")).alias("__b")).select("__b.threshold", F.col("__b.best").alias("macro_f1"))


def calibrate(reads: DataFrame, category: str, presence: Column, energy: Column, acceptance: float = 0.95, temperature: float = 1.0, forbidden: tuple[str, ...] = ("Fountain", "LT")) -> Thresholds:
    """Both thresholds from validation reads: the gate by macro-F1, the rejection by the order statistic of known archives' energies. Test-only families are an error."""
    checked = L.require(reads, F.col(category).isin(*forbidden), "a family kept for tests must not calibrate thresholds")
    archives = votes.two_level(checked, {"ecc": presence, "energy": energy}, ["archive_id", category])
    gate = best_threshold(presence_scan(archives, "ecc", ~L.is_uncoded(F.col(category)))).first()
    known = order_statistics(archives.where(L.is_known(F.col(category))), "energy", [acceptance]).first()
    return Thresholds(gate["threshold"], known["threshold"], acceptance, temperature)
