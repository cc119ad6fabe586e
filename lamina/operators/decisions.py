"""Open-set decisions as column expressions. Comparisons are strict: a score at its threshold is accepted."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.scalars import exceeds


def cascade(ecc_score: Column, unknown_score: Column, closed: Column, presence: float | Column, unknown: float | Column) -> Column:
    """no_ecc below the presence threshold, else unknown_ecc above the other one, else the closed-set label."""
    return F.when(ecc_score < presence, "no_ecc").when(exceeds(unknown_score, unknown), "unknown_ecc").otherwise(closed)


def rejections(scores: list[Column], thresholds: list[float | Column]) -> list[Column]:
    return [exceeds(s, t) for s, t in zip(scores, thresholds, strict=True)]


def combined(rejected: list[Column], logic: str) -> Column:
    """known_ecc, unknown_ecc or uncertain_ecc from the detectors' rejections; a tied majority is uncertain."""
    if not rejected:
        raise ValueError("a rule needs a detector")
    n, count = len(rejected), reduce(add, [r.cast("int") for r in rejected])
    if logic == "consensus":
        return F.when(count == 0, "known_ecc").when(count == n, "unknown_ecc").otherwise("uncertain_ecc")
    if logic == "and_reject":
        return F.when(count == n, "unknown_ecc").otherwise("known_ecc")
    if logic == "or_reject":
        return F.when(count > 0, "unknown_ecc").otherwise("known_ecc")
    if logic == "majority":
        return F.when(2 * count < n, "known_ecc").when(2 * count > n, "unknown_ecc").otherwise("uncertain_ecc")
    if logic == "energy_only" and n == 1:
        return F.when(count == 1, "unknown_ecc").otherwise("known_ecc")
    raise ValueError(f"no such rule for {n} detectors: {logic}")


def three_state(energy_rejected: Column, proxy_rejected: Column) -> Column:
    return combined([energy_rejected, proxy_rejected], "consensus")


def frozen(ecc: Column, energy: Column, proxy: Column, closed: Column, presence: float, energy_threshold: float, proxy_threshold: float) -> dict[str, Column]:
    """Outputs of the four methods; the last is the proxy's under another name."""
    state = three_state(exceeds(energy, energy_threshold), exceeds(proxy, proxy_threshold))

    def gated(output: Column) -> Column:
        return F.when(ecc < presence, "no_ecc").otherwise(output)

    proxy_only = gated(F.when(exceeds(proxy, proxy_threshold), "unknown_ecc").otherwise(closed))
    return {
        "energy_only": gated(F.when(exceeds(energy, energy_threshold), "unknown_ecc").otherwise(closed)),
        "proxy_only": proxy_only,
        "three_state": gated(F.when(state == "known_ecc", closed).otherwise(state)),
        "G_all": proxy_only,
    }


def with_parameters(status: Column, code_type: Column, rate: Column, length: Column) -> Column:
    """The cascade of all tasks as a struct: type, rate and length only where the archive is of a known type, null elsewhere."""
    known = ~status.isin("no_ecc", "unknown_ecc", "uncertain_ecc")
    state = F.when(known, "known_ecc").otherwise(status)
    return F.struct(state.alias("status"), F.when(known, code_type).alias("code_type"), F.when(known, rate).alias("code_rate"), F.when(known, length).alias("code_length"))
