"""What each part of a joint vector is worth: a detector fitted, calibrated and evaluated for every ablation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import features, metrics, models, thresholds


@dataclass(frozen=True)
class Variant:
    name: str
    model: models.Proxy
    threshold: float


def fit(development: DataFrame, vector: str, anomaly: str, layout: dict[str, tuple[int, int]] = features.BLOCKS, count: int = 8, ridge: float = 1e-2, acceptance: float = 0.95) -> list[Variant]:
    """A model of every ablation (a fixed few), with the least threshold that accepts the share ``acceptance`` of the development's known rows (``anomaly`` 0).

    All variants' scores come from one pass over the rows, and their thresholds from one aggregation.
    """
    parts = features.ablated(vector, layout)
    wide = development.select(F.col(anomaly).alias("y"), *[c.alias(n) for n, c in parts.items()])
    fitted = {n: models.fit_proxy(wide.select("y", n), n, "y", count, ridge) for n in parts}
    known = _scored(development.where(F.col(anomaly) == 0), vector, layout, fitted)
    found = {r["ablation"]: r["threshold"] for r in thresholds.order_statistics(known, "score", [acceptance], ["ablation"]).collect()}
    return [Variant(n, m, found[n]) for n, m in fitted.items()]


def _scored(df: DataFrame, vector: str, layout: dict[str, tuple[int, int]], fitted: dict[str, models.Proxy]) -> DataFrame:
    """The rows once for each variant, with its name and score."""
    parts = features.ablated(vector, layout)
    wide = df.select("*", *[c.alias(f"__{n}") for n, c in parts.items()])
    each = F.array(*[F.struct(F.lit(n).alias("ablation"), models.proxy_score(f"__{n}", m).alias("score")) for n, m in fitted.items()])
    return wide.select(*df.columns, F.explode(each).alias("__v")).select(*df.columns, "__v.*")


def evaluate(df: DataFrame, vector: str, anomaly: str, variants: list[Variant], layout: dict[str, tuple[int, int]] = features.BLOCKS) -> DataFrame:
    """ablation, dimensions, threshold, n, known_acceptance, unknown_recall and auroc; scores are strict: one at its threshold is accepted."""
    scored = _scored(df, vector, layout, {v.name: v.model for v in variants})
    limits = {v.name: v.threshold for v in variants}
    limit = F.element_at(F.create_map(*[x for n, t in limits.items() for x in (F.lit(n), F.lit(float(t)))]), F.col("ablation"))
    unknown, rejected = F.col(anomaly) == 1, F.col("score") > limit
    sizes = {n: sum(layout[p][1] - layout[p][0] for p in parts) for n, parts in features.ABLATIONS.items()}
    size = F.element_at(F.create_map(*[x for n, d in sizes.items() for x in (F.lit(n), F.lit(d))]), F.col("ablation"))
    rates = scored.groupBy("ablation").agg(F.count("*").alias("n"), metrics.share(~rejected, ~unknown).alias("known_acceptance"), metrics.share(rejected, unknown).alias("unknown_recall"))
    ranks = metrics.auroc(scored.select("ablation", "score", unknown.alias("u")), "score", F.col("u"), ["ablation"])
    return rates.join(ranks, "ablation").select("ablation", size.alias("dimensions"), limit.alias("threshold"), "n", "known_acceptance", "unknown_recall", "auroc")
