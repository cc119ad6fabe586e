import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import quantiles

QS = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


def same(a, b):
    if a is None or b is None:
        return a is b
    return all(x == y or np.isnan(x) and np.isnan(y) or abs(x - y) <= 1e-9 * max(1, abs(x)) for x, y in zip(a, b))


@pytest.mark.parametrize("left", [1, 50, 4096])
def test_large_groups_equal_the_plain_quantiles(spark, left):
    """Spread, tied, extreme, negative and missing values; one group holds nearly all rows."""
    r = np.random.default_rng(1)
    rows = []
    for g, n in (("hot", 4000), ("ties", 1500), ("few", 7), (None, 900), ("none", 600)):
        for i in range(n):
            v = {"hot": float(r.normal() * 10.0 ** r.integers(-12, 12)), "ties": float(r.integers(0, 3)), "few": float(i), "none": None}.get(g, float(-(2.0 ** r.integers(-900, 900))))
            rows.append((g, v if i % 11 else None, int(r.integers(-5, 6))))
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(6)
    others = [F.count("v").alias("n"), F.avg("w").alias("m")]
    want = {x.g: x for x in df.groupBy("g").agg(*others, F.percentile("v", QS).alias("v"), F.percentile("w", QS).alias("w")).collect()}
    got = quantiles.grouped(df, ["g"], ["v", "w"], QS, others, small=100, left=left).collect()
    assert len(got) == len(want) == 5
    for x in got:
        y = want[x.g]
        assert same(x.v, y.v) and same(x.w, y.w) and x.n == y.n and abs(x.m - y.m) < 1e-12


def test_one_group_of_all_rows_and_ties_to_the_last_bit(spark):
    values = [1.0] * 500 + [float(np.nextafter(1.0, 2))] * 500 + [-0.0, 0.0, float("nan"), float("inf"), -float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = quantiles.grouped(df, [], ["v"], [0.1, 0.4, 0.7], small=10, left=3).first()
    assert got.v == df.agg(F.percentile("v", [0.1, 0.4, 0.7])).first()[0]


def test_a_hot_group_is_counted_by_all_tasks(spark):
    """What a task of a large group holds are counts of bins, not values."""
    df = spark.range(20000).selectExpr("'a' AS g", "double(id * 7919 % 20011) AS v")
    made = []
    got = {x["rank"]: x.v for x in quantiles.ranked(df, ["g"], "v", spark.createDataFrame([("a", 0), ("a", 9999), ("a", 19999)], "g string, rank long"), made, 16).collect()}
    want = sorted(i * 7919 % 20011 for i in range(20000))
    assert got == {0: want[0], 9999: want[9999], 19999: want[19999]} and len(made) >= 4


def test_empty_tables(spark):
    assert quantiles.grouped(spark.createDataFrame([], "g string, v double"), ["g"], ["v"], QS).count() == 0


def test_all_columns_are_looked_through_at_once(spark):
    """Passes don't grow with the columns, and equal values end them at once."""
    df = spark.range(3000).select(F.lit("a").alias("g"), *[((F.col("id") * (i + 1) % 7) / 7).alias(f"v{i}") for i in range(12)])
    values = [f"v{i}" for i in range(12)]
    tracker, group = spark.sparkContext.statusTracker(), "quantiles-of-many-columns"
    spark.sparkContext.setJobGroup(group, group)
    got = quantiles.grouped(df, ["g"], values, [0.1, 0.5], small=12).first()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = df.groupBy("g").agg(*[F.percentile(v, [0.1, 0.5]).alias(v) for v in values]).first()
    assert all(same(got[v], want[v]) for v in values)
    assert len(tracker.getJobIdsForGroup(group)) < 60
