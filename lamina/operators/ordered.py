"""Running sums over a total order without a single-task sort.

Rows are dealt into ranges of the ordering value (bounds from approximate quantiles); each range
is summed, the few range sums are accumulated, and every row adds its range's offset to a
running sum inside the range. No task holds more than one range of one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bounds(df: DataFrame, value: str, ranges: int) -> list[float]:
    if ranges < 2:
        return []
    return sorted(set(df.approxQuantile(value, [i / ranges for i in range(1, ranges)], 0.2 / ranges)))


def range_number(value: Column, cuts: list[float]) -> Column:
    """Number of cuts below ``value``; looked up by blocks, so a row costs the root of their number."""
    if not cuts:
        return F.lit(0)
    size = max(1, round(len(cuts) ** 0.5))
    whole = F.array(*map(F.lit, cuts))
    ends = F.array(*[F.lit(c) for c in cuts[size - 1 :: size]])
    blocks = F.size(F.filter(ends, lambda c: c < value))
    return blocks * size + F.size(F.filter(F.slice(whole, blocks * size + 1, F.lit(size)), lambda c: c < value))


def running(df: DataFrame, value: str, sums: list[str], by: list[str] | None = None, descending: bool = False, ties: list[Column] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds cum_<x> (inclusive, in order of ``value``, then ``ties``), total_<x> and next_value for each column x of ``sums``.

    Without ``ties``, rows of one value must be aggregated before, to one row a group.
    """
    by = by or []
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = range_number(F.col(value), bounds(df, value, ranges))
    dealt = df.withColumn("__range", -number if descending else number)
    edge = F.max(value) if descending else F.min(value)
    totals = dealt.groupBy(*by, "__range").agg(*[F.sum(x).alias(f"__sum_{x}") for x in sums], edge.alias("__edge"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    following = Window.partitionBy(*by).orderBy("__range")
    offsets = totals.select(
        *by,
        "__range",
        *[F.coalesce(F.sum(f"__sum_{x}").over(before), F.lit(0)).alias(f"__before_{x}") for x in sums],
        *[F.sum(f"__sum_{x}").over(whole).alias(f"total_{x}") for x in sums],
        F.lead("__edge").over(following).alias("__next_edge"),
    )
    order = [F.col(value).desc() if descending else F.col(value).asc(), *(ties or [])]
    inside = Window.partitionBy(*by, "__range").orderBy(*order)
    joined = dealt.join(offsets, [*by, "__range"])
    return joined.select(
        *df.columns,
        *[(F.col(f"__before_{x}") + F.sum(x).over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias(f"cum_{x}") for x in sums],
        *[f"total_{x}" for x in sums],
        F.coalesce(F.lead(value).over(inside), F.col("__next_edge")).alias("next_value"),
    )


def ecdf(df: DataFrame, value: str, by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """by, value, n, cumulative (share of the group's rows that are no larger): a row for each different value. Null and NaN aren't values."""
    by = by or []
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, value).agg(F.count("*").alias("n"))
    r = running(counts, value, ["n"], by, ranges=ranges)
    return r.select(*by, value, "n", (F.col("cum_n") / F.col("total_n")).alias("cumulative"))
