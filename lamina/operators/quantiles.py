"""Exact interpolated quantiles of groups of any size.

``F.percentile`` keeps every different value of a group in one task's buffer. Groups of up to SMALL values of all columns are given to it.
Of larger ones (and of more rows than a partition's share, so at most as many as there are partitions) the wanted ranks are found by radix refinement:
numbers become integers of the same order, which are written once, their first bits are counted per group and column, which any number of tasks do side
by side, and the bins that hold wanted ranks are looked into, DIGIT bits deeper with each pass. A rank is found once its bin has
one value, however often, or no more than LEFT rows, which are then sorted. There are six passes at most, each for all columns at once
and over the rows of the bins that are still wanted, and what goes through a shuffle are counts of bins.

Defined cases: nulls aren't values; NaN is the largest, as it is for the engine; -0.0 counts as 0.0; a group of no values has null quantiles;
the quantile q of n values lies q * (n - 1) places behind the least, between two of them by linear interpolation.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina import storage

SMALL = 1 << 17  # rows
LEFT = 1 << 12
DIGIT = 11  # bits
BITS = 64


def _ordered(values: pa.Array) -> pa.Array:
    """Longs in the order of the doubles."""
    x = np.asarray(values.to_numpy(zero_copy_only=False), "f8") + 0.0
    bits = np.where(np.isnan(x), np.array(np.nan), x).view("i8")
    found = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    return pa.array(found, mask=np.asarray(values.is_null()))


def _number(keys: pa.Array) -> pa.Array:
    """The doubles of such longs."""
    k = np.asarray(keys.to_numpy(zero_copy_only=False), "i8")
    return pa.array(np.where(k < 0, k ^ np.int64(0x7FFFFFFFFFFFFFFF), k).view("f8"))


_ordered.__annotations__ = {"values": pa.Array, "return": pa.Array}
_number.__annotations__ = {"keys": pa.Array, "return": pa.Array}


def _same(by: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by], F.lit(True))


def _written(df: DataFrame, made: list[str]) -> DataFrame:
    path = storage.scratch(df.sparkSession, "quantiles")
    made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ranked(df: DataFrame, by: list[str], value: str, ranks: DataFrame, made: list[str], left: int = LEFT) -> DataFrame:
    """by, rank, value: ``ranks`` (by, rank from 0) of ``value`` within its group, none of them null."""
    rows = df.select(*by, F.arrow_udf(_ordered, "long")(F.col(value)).alias("k"))
    return _ranked(rows.where("k is not null"), by, ranks, made, left)


def _ranked(rows: DataFrame, by: list[str], ranks: DataFrame, made: list[str], left: int = LEFT) -> DataFrame:
    """The same of rows by, k (numbers as longs of the same order). The wanted bins are broadcast: one for each wanted rank at most."""
    wanted = ranks.select(*by, "rank", F.col("rank").alias("inside"), F.lit(0).cast("long").alias("bin"))
    found: list[DataFrame] = []
    for depth in range(DIGIT, BITS + DIGIT, DIGIT):
        shift = max(0, BITS - depth)
        before = min(BITS, BITS - depth + DIGIT)  # bits that the pass before left open
        up = F.lit(0).cast("long") if before == BITS else F.shiftright("k", before)
        inside = rows
        if before < BITS:  # the first pass counts everything
            bins = F.broadcast(wanted.select(*by, "bin").distinct())
            inside = rows.alias("r").join(bins.alias("w"), _same(by, "r", "w") & (F.shiftright("r.k", before) == F.col("w.bin")), "left_semi")
        counts = inside.groupBy(*by, up.alias("__up"), F.shiftright("k", shift).alias("bin")).agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"))
        order = Window.partitionBy(*by, "__up").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # 2 ** DIGIT rows at most
        table = counts.withColumn("below", F.coalesce(F.sum("n").over(order), F.lit(0)))
        hit = (F.col("w.bin") == F.col("c.__up")) & (F.col("w.inside") >= F.col("c.below")) & (F.col("w.inside") < F.col("c.below") + F.col("c.n"))
        narrowed = wanted.alias("w").join(table.alias("c"), _same(by, "w", "c") & hit)
        state = _written(narrowed.select(*[f"w.{c}" for c in by], "w.rank", (F.col("w.inside") - F.col("c.below")).alias("inside"), "c.bin", "c.n", "c.least", "c.most"), made)
        got = state.where("least = most").select(*by, "rank", F.col("least").alias("k"))  # however many rows have it
        some = state.where((F.col("least") < F.col("most")) & (F.col("n") <= left))
        if shift and not some.isEmpty():
            bins = F.broadcast(some.select(*by, "bin").distinct())
            at = rows.alias("r").join(bins.alias("w"), _same(by, "r", "w") & (F.shiftright("r.k", shift) == F.col("w.bin")), "left_semi")
            lists = at.groupBy(*by, F.shiftright("k", shift).alias("bin")).agg(F.sort_array(F.collect_list("k")).alias("l"))
            sorted_ = some.alias("w").join(lists.alias("l"), _same(by, "w", "l") & (F.col("w.bin") == F.col("l.bin"))).select(*[f"w.{c}" for c in by], "w.rank", F.get("l.l", F.col("w.inside").cast("int")).alias("k"))
            got = got.unionByName(sorted_)
        found.append(_written(got, made))
        wanted = state.where((F.col("least") < F.col("most")) & (F.col("n") > left)).select(*by, "rank", "inside", "bin")
        if shift == 0 or wanted.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).select(*by, "rank", F.arrow_udf(_number, "double")("k").alias("v"))


def _interpolated(low: Column, high: Column, part: Column) -> Column:
    return F.when(part == 0, low).otherwise(low + (high - low) * part)


def grouped(df: DataFrame, by: list[str], values: list[str], quantiles: list[float], others: list[Column] | None = None, small: int = SMALL, left: int = LEFT) -> DataFrame:
    """by, the aggregates ``others``, and for each column of ``values`` an array of its quantiles under the same name. The grouping columns aren't values."""
    spark, others = df.sparkSession, others or []
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"))
    plain = lambda rows: rows.groupBy(*by).agg(*others, *[F.percentile(v, list(quantiles)).alias(v) for v in values])
    top = sizes.agg(F.max("__n").alias("most"), F.sum("__n").alias("all")).first()
    share = max(small // max(1, len(values)), (top["all"] or 0) // max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if (top["most"] or 0) <= share:
        return plain(df)
    if by:
        large = sizes.where(F.col("__n") > share).drop("__n")
        named = F.broadcast(spark.createDataFrame([tuple(r) for r in large.collect()], large.schema)).alias("h")
        big, rest = df.alias("r").join(named, _same(by, "r", "h"), "left_semi"), plain(df.alias("r").join(named, _same(by, "r", "h"), "left_anti"))
    else:
        big, rest = df, None
    made: list[str] = []
    counted = [F.count(v).alias(f"__n{i}") for i, v in enumerate(values)]
    found = _written(big.groupBy(*by).agg(*others, *counted), made)
    numbers = _written(big.select(*by, *[F.arrow_udf(_ordered, "long")(F.col(v)).alias(f"__k{i}") for i, v in enumerate(values)]), made)
    rows = numbers.select(*by, F.posexplode(F.array(*[f"__k{i}" for i in range(len(values))])).alias("__of", "k")).where("k is not null")  # all values are looked through at once
    each = found.select(*by, F.posexplode(F.array(*[f"__n{i}" for i in range(len(values))])).alias("__of", "n"))
    at = F.transform(F.array(*[F.lit(float(q)) for q in quantiles]), lambda q: q * (F.col("n") - 1))
    places = each.where("n > 0").select(*by, "__of", at.alias("at"))
    both = F.array_distinct(F.flatten(F.transform("at", lambda a: F.array(F.floor(a), F.ceil(a)))))
    keys = [*by, "__of"]
    at_rank = _ranked(rows, keys, places.select(*keys, F.explode(both).alias("rank")), made, left).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of"))
    between = F.transform("p.at", lambda a: _interpolated(F.element_at("q.of", F.floor(a)), F.element_at("q.of", F.ceil(a)), a - F.floor(a)))
    one = places.alias("p").join(at_rank.alias("q"), _same(keys, "p", "q")).select(*[f"p.{c}" for c in keys], between.alias("v"))
    wide = one.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__of", "v"))).alias("__of"))
    whole = found.alias("f").join(wide.alias("o"), _same(by, "f", "o"), "left")
    names = [c for c in found.columns if c not in {f"__n{i}" for i in range(len(values))}]
    found = _written(whole.select(*[f"f.{c}" for c in names], *[F.try_element_at("o.__of", F.lit(i)).alias(v) for i, v in enumerate(values)]), [])
    for path in made:
        storage.delete(spark, path)
    return found if rest is None else rest.unionByName(found)
