"""Audits: duplicates, leakage between splits, snapshots, resumable work, alignment, reference limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina import storage
from lamina.functions import labels as L
from lamina.functions import scalars, sequences
from lamina.operators import structure
from lamina.operators.quantiles import grouped


def duplicates(df: DataFrame, fingerprint: Column, order: str) -> DataFrame:
    """Fingerprints of more than one row, their number of rows, and the first row's key."""
    return df.groupBy(fingerprint.alias("fingerprint")).agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")


def split_overlap(df: DataFrame, fingerprint: Column, split: str) -> DataFrame:
    """Fingerprints in common for every pair of splits that has any; one aggregation, not a join per pair."""
    sets = df.groupBy(fingerprint.alias("fingerprint")).agg(F.sort_array(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b"))))))
    return sets.select(pairs.alias("__p")).groupBy("__p.split_a", "__p.split_b").agg(F.count("*").alias("shared"))


def snapshot_diff(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """missing, unexpected and changed keys."""
    a, b = expected.select(key, F.col(digest).alias("__expected")), actual.select(key, F.col(digest).alias("__actual"))
    state = F.when(F.col("__actual").isNull(), "missing").when(F.col("__expected").isNull(), "unexpected").otherwise("changed")
    return a.join(b, key, "full_outer").where(~F.col("__expected").eqNullSafe(F.col("__actual"))).select(key, state.alias("state"))


def pending(specs: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    return specs.join(completed.select(*keys).distinct(), keys, "left_anti")


def aligned(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """How two tables of one key agree: rows on either side alone, the largest difference, and whether it is within the tolerance."""
    a, b = left.select(key, F.col(value).alias("__l")), right.select(key, F.col(value).alias("__r"))
    both = a.join(b, key, "full_outer")
    found = both.agg(F.count_if(F.col("__r").isNull()).alias("only_left"), F.count_if(F.col("__l").isNull()).alias("only_right"), F.max(F.abs(F.col("__l") - F.col("__r"))).alias("max_difference"))
    ok = (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.coalesce("max_difference", F.lit(0.0)) <= tolerance)
    return found.withColumn("close", ok)


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The join of two tables that must hold the same keys, once each; anything else is an error."""
    a, b = left.withColumn("__left", F.lit(True)), right.withColumn("__right", F.lit(True))
    both = a.join(b, key, "full_outer").withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    return L.require(both, F.col("__left").isNull() | F.col("__right").isNull() | (F.col("__n") > 1), "the tables don't match one to one").drop("__left", "__right", "__n")


def stable_halves(df: DataFrame, label: str, key: str, *seed_parts: Column, labels: tuple[str, ...] | None = None, least: int = 4) -> DataFrame:
    """fit for the first half of each class by a stable hash, calibration for the rest. A label outside ``labels``, or a class of fewer than ``least`` rows, is an error."""
    rows = F.count("*").over(Window.partitionBy(label))
    df = L.require(df.withColumn("__rows", rows), (~F.col(label).isin(*labels) if labels else F.lit(False)) | (F.col("__rows") < least), "a class is unknown or too small to be split").drop("__rows")
    order = Window.partitionBy(label).orderBy(sequences.stable_seed(*seed_parts, F.col(label), F.col(key)), key)
    half = F.floor(F.count("*").over(Window.partitionBy(label)) / 2)
    return df.withColumn("split", F.when(F.row_number().over(order) <= half, "fit").otherwise("calibration"))


def reference_audit(df: DataFrame, sequence: str, by: str, length: int | None = None, gc: tuple[float, float] | None = None, longest: int | None = None) -> DataFrame:
    """Per category: counts, uniqueness, lengths, GC and run statistics, and the number of violations of the limits."""
    s = F.col(sequence)
    g, run = sequences.gc_fraction(s), sequences.longest_run(s)
    bad = ~sequences.is_legal(s)
    if length is not None:
        bad = bad | (F.length(s) != length)
    if gc is not None:
        bad = bad | ~g.between(*gc)
    if longest is not None:
        bad = bad | (run > longest)
    rows = df.select(by, s.alias("__s"), g.alias("__g"), run.alias("__r"), bad.alias("__bad"))
    once = rows.groupBy(by, "__s").agg(F.count("*").alias("__n"), F.first("__g").alias("__g"), F.first("__r").alias("__r"), F.first("__bad").alias("__bad"))
    n = F.sum("__n")
    return once.groupBy(by).agg(
        n.alias("n"), F.count("*").alias("distinct"), F.min(F.length("__s")).alias("min_length"), F.max(F.length("__s")).alias("max_length"),
        (F.sum(F.col("__g") * F.col("__n")) / n).alias("gc_mean"), F.max("__r").alias("longest_run"), F.sum(F.when(F.col("__bad"), F.col("__n")).otherwise(0)).alias("violations"),
    )


def fail_closed(audit: DataFrame) -> DataFrame:
    """The audit's rows; an error where a category has violations or repeated references."""
    broken = (F.col("violations") > 0) | (F.col("distinct") < F.col("n"))
    return audit.where(F.when(broken, F.raise_error(F.lit("the reference audit failed")).cast("boolean")).otherwise(F.lit(True)))


def xor_blocks(members: DataFrame, blocks: DataFrame, droplet: str, block: str, value: str) -> DataFrame:
    """XOR of the source blocks of each droplet: members pairs droplets with blocks."""
    return members.join(blocks, block).groupBy(droplet).agg(F.count("*").alias("degree"), F.bit_xor(value).alias(value))


def composition(df: DataFrame, sequence: str, by: str, table: bytes | None = None) -> DataFrame:
    """Per group: GC mean and deviation, mean and 95 % quantile of the longest run, and how far the pooled neighbour pairs are from uniform (sum of absolute gaps)."""
    names = [F.col(f"pair_{p}") for p in structure.PAIRS]
    rows = storage.stored(structure.counted(df, sequence, [by], table=table), "counts").withColumns({"__g": scalars.rate_or_zero(F.col("base_G") + F.col("base_C"), F.col("length")), "__r": F.col("longest_run")})
    whole = F.greatest(sum((F.sum(p) for p in names), F.lit(0)), F.lit(1))
    gap = sum((F.abs(F.sum(p) / whole - 1 / 16) for p in names), F.lit(0.0))
    found = grouped(rows, [by], ["__r"], [0.95], [F.avg("__g").alias("gc_mean"), F.stddev_pop("__g").alias("gc_std"), F.avg("__r").alias("run_mean"), gap.alias("pair_distance")])
    return found.select(by, "gc_mean", "gc_std", "run_mean", F.element_at("__r", 1).alias("run_q95"), "pair_distance")
