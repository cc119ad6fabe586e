"""Conformal p-values by ranks, instead of a comparison of every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.ordered import running


def _at_least(calibration: DataFrame, points: DataFrame, label: str, score: str) -> DataFrame:
    """label, score, at_least (calibration scores of the class that are as large or larger), total: one row per distinct point."""
    both = calibration.select(label, F.col(score).alias("score"), F.lit(1).alias("c")).unionByName(points.select(label, F.col(score).alias("score"), F.lit(0).alias("c")))
    counts = both.groupBy(label, "score").agg(F.sum("c").alias("c"))
    r = running(counts, "score", ["c"], [label])
    return r.select(label, "score", (F.col("total_c") - F.col("cum_c") + F.col("c")).alias("at_least"), F.col("total_c").alias("total"))


def p_values(calibration: DataFrame, points: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(1 + number of calibration scores of the class that are no smaller) / (their number + 1); a class without any is an error."""
    ranked = _at_least(calibration, points, label, score).withColumnRenamed("score", score)
    p = (1 + F.col("at_least")) / (F.col("total") + 1)
    checked = F.when(F.col("total") == 0, F.raise_error(F.lit("a class has no calibration scores")).cast("double")).otherwise(p)
    return points.join(ranked, [label, score]).select(*points.columns, checked.alias("p_value"))


def leave_one_out(calibration: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Each calibration row against the others of its class: its own count cancels the 1."""
    ranked = _at_least(calibration, calibration.limit(0), label, score).withColumnRenamed("score", score)
    return calibration.join(ranked, [label, score]).select(*calibration.columns, (F.col("at_least") / F.col("total")).alias("p_value"))


def all_classes(calibration: DataFrame, points: DataFrame, key: str, labels: tuple[str, ...], label: str = "label", distances: str = "distances", own: str | None = None) -> DataFrame:
    """p_values, an array in the order of ``labels``, for points whose array ``distances`` is in that order too.

    A class's calibration scores are the distances of its own rows to it. With ``own``, the points are the calibration
    rows themselves and that column their class: a row isn't counted among its own class's.
    """
    number = F.array_position(F.array(*map(F.lit, labels)), F.col(label))
    known = calibration.select(F.col(label).alias("__class"), F.element_at(distances, number.cast("int")).alias("__d"))
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, labels)).alias("c"), F.col(distances).alias("d"))).alias("__e")
    long = points.select(key, *([F.col(own).alias("__own")] if own else []), each).select("*", F.col("__e.c").alias("__class"), F.col("__e.d").alias("__d"))
    ranked = _at_least(known, long, "__class", "__d").withColumnRenamed("score", "__d")
    others = (1 + F.col("at_least")) / (F.col("total") + 1)
    p = F.when(F.col("__own") == F.col("__class"), F.col("at_least") / F.col("total")).otherwise(others) if own else others
    checked = F.when(F.col("total") == 0, F.raise_error(F.lit("a class has no calibration scores")).cast("double")).otherwise(p)
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("__class"))
    rows = long.join(ranked, ["__class", "__d"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), checked.alias("p")))).alias("__p"))
    return rows.select(key, F.transform("__p", lambda x: x["p"]).alias("p_values"))


def rejection_score(p_values: Column, mode: str, closed_index: Column | None = None) -> Column:
    """The larger, the less like a known class: minus the largest p-value, or minus that of the closed-set class (numbered from 0)."""
    if mode == "maximum":
        return -F.array_max(p_values)
    if mode == "predicted" and closed_index is not None:
        return -F.element_at(p_values, (closed_index + 1).cast("int"))
    raise ValueError(f"no such mode, or no class for it: {mode}")
