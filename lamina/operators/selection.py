"""Choosing detection rules: the registry of candidates, their metrics, and lexicographic selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators import decisions

#: Targets, rules, and the names of the candidates that registry() makes of them.
TARGETS = (0.98, 0.95, 0.93)
LOGICS = ("consensus", "and_reject", "or_reject", "majority")


def registry(detectors: list[str], pair: tuple[str, str], targets: tuple[float, ...] = TARGETS) -> list[dict]:
    """Each detector alone, and a pair and all of them under every logic, at every target."""
    found = []
    for target in targets:
        tag = f"t{round(100 * target)}"
        for i, d in enumerate(detectors):
            found.append({"name": f"{tag}_energy_only" if i == 0 else f"{tag}_{d}_only", "target": target, "detectors": [d], "logic": "energy_only"})
        for subset, members in (("energy_raw", list(pair)), (f"all{len(detectors)}", list(detectors))):
            found += [{"name": f"{tag}_{subset}_{logic}", "target": target, "detectors": members, "logic": logic} for logic in LOGICS]
    return found


def states(candidate: dict, thresholds: dict[tuple[float, str], float]) -> Column:
    names = candidate["detectors"]
    return decisions.combined(decisions.rejections([F.col(d) for d in names], [thresholds[candidate["target"], d] for d in names]), candidate["logic"])


def candidate_metrics(scores: DataFrame, family: str, candidates: list[dict], thresholds: dict[tuple[float, str], float]) -> DataFrame:
    """One row per family and candidate: shares of the three states. One pass over the scores; the rows of a task are summed before the shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(c["name"]).alias("candidate"), states(c, thresholds).alias("state")) for c in candidates]))
    long = scores.select(family, each.alias("__c")).select(family, "__c.candidate", "__c.state")
    return long.groupBy(family, "candidate").agg(*[F.avg((F.col("state") == s).cast("double")).alias(s) for s in ("known_ecc", "unknown_ecc", "uncertain_ecc")])


def select(metrics: DataFrame, family: str, mode: str, by: list[str] | None = None, known: str = "known") -> DataFrame:
    """The best candidate of each group: eligible ones first, then the worst family's shares, then the name.

    ``metrics`` holds a row per candidate and family; the known archives are the family named ``known``.
    """
    by = by or []
    k, proxy = F.col(family) == known, F.col(family) != known
    one = metrics.groupBy(*by, "candidate").agg(
        F.max(F.when(k, F.col("known_ecc"))).alias("acceptance"),
        F.max(F.when(k, F.col("uncertain_ecc"))).alias("known_uncertain"),
        F.max(F.when(k, F.col("unknown_ecc"))).alias("known_unknown"),
        F.min(F.when(proxy, F.col("unknown_ecc"))).alias("min_unknown"),
        F.min(F.when(proxy, 1 - F.col("known_ecc"))).alias("min_coverage"),
        F.max(F.when(proxy, F.col("known_ecc"))).alias("max_direct"),
    )
    if mode == "balanced":
        eligible = (F.col("acceptance") >= 0.93) & (F.col("known_uncertain") <= 0.07)
        keys = ["min_unknown", "min_coverage", (-F.col("max_direct")).alias("d"), "acceptance"]
    elif mode == "safety":
        eligible = 1 - F.col("known_unknown") >= 0.93
        keys = ["min_coverage", (-F.col("max_direct")).alias("d"), "min_unknown", (-F.col("known_uncertain")).alias("u")]
    else:
        raise ValueError(mode)
    return one.groupBy(*by).agg(F.max_by("candidate", F.struct(eligible.alias("e"), *keys, "candidate")).alias("candidate"))


def leave_one_family_out(metrics: DataFrame, family: str, families: list[str], mode: str, known: str = "known") -> DataFrame:
    """For each held-out family, the candidate chosen on the others, and its metrics on the held-out one."""
    folds = F.explode(F.array(*map(F.lit, families)))
    train = metrics.withColumn("held_out", folds).where(F.col(family) != F.col("held_out"))
    chosen = select(train, family, mode, ["held_out"], known)
    return chosen.join(metrics.withColumnRenamed(family, "held_out"), ["held_out", "candidate"])


def majority_choice(chosen: DataFrame) -> DataFrame:
    """The candidate that most folds chose, the first by name of equal ones, and in how many folds."""
    counts = chosen.select("held_out", "candidate").distinct().groupBy("candidate").agg(F.count("*").alias("folds"))
    return counts.agg(F.min_by(F.struct("candidate", "folds"), F.struct((-F.col("folds")).alias("n"), "candidate")).alias("__b")).select("__b.candidate", "__b.folds")
