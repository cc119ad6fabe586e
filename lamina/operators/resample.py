"""Bootstrap intervals without a row for each drawn row.

The rows of a stratum are packed into one row of arrays. Repetitions are dealt to packed strata in blocks, and a task
draws inside the arrays and adds up what it has drawn: one row of sums a repetition and task goes through the shuffle.
Draws of a packed stratum are a hash of (seed, repetition, stratum, place), so they are the same wherever they run.

A stratum of more rows than PACK, and than a partition's share of all rows, isn't packed whole. Its rows are dealt to chunks by a hash.
How many of a repetition's draws fall into a chunk follows from binomial splits down a tree over the chunks' sizes, each made
by a generator whose counter is the node's number: every chunk finds its own number alone, and the numbers of all chunks add up to
the stratum's size. The distribution is that of a multinomial draw of rows, as in a packed stratum; the stream of numbers is another one.

Defined cases: null values add nothing; a null stratum is one of its own; a repetition without a value is null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.scalars import f1, total

PACK = 1 << 17  # rows
BLOCK_DRAWS = 1 << 22  # draws to a block of repetitions, at least one repetition: seconds of work for a copy of the stratum's arrays


def packed(df: DataFrame, strata: list[str], order: list[str], values: dict[str, Column], pack: int = PACK) -> DataFrame:
    """strata, __name (their text), __size, __chunk, __sizes (of the stratum's chunks; null: packed whole), and an array of doubles for each value, in the given order."""
    spark = df.sparkSession
    rows = df.select(*strata, F.struct(*order).alias("__order"), *[c.cast("double").alias(n) for n, c in values.items()])
    sizes = df.groupBy(*strata).agg(F.count("*").alias("__size"))
    share = max(pack, df.count() // max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    large = sizes.where(F.col("__size") > share).collect()  # no more than there are partitions
    if large:
        found = F.broadcast(spark.createDataFrame([tuple(r) for r in large], sizes.schema)).alias("l")
        same = F.lit(True)
        for s in strata:
            same = same & F.col(f"r.{s}").eqNullSafe(F.col(f"l.{s}"))
        chunks = F.ceil(F.col("l.__size") / pack)
        chunk = F.when(F.col("l.__size").isNull(), 0).otherwise(F.pmod(F.xxhash64("r.__order"), chunks)).cast("int")
        rows = rows.alias("r").join(found, same, "left").select("r.*", chunk.alias("__chunk"), F.col("l.__size").isNotNull().alias("__split"))
    else:
        rows = rows.withColumns({"__chunk": F.lit(0), "__split": F.lit(False)})
    lists = F.array_sort(F.collect_list(F.struct("__order", *values)))
    whole = rows.groupBy(*strata, "__chunk", "__split").agg(lists.alias("__rows"))
    texts = F.array_compact(F.array(*[F.col(s).cast("string") for s in strata]))
    name = F.when(F.size(texts) > 0, F.concat_ws(":", texts))
    out = whole.select(*strata, name.alias("__name"), F.size("__rows").alias("__size"), "__chunk", "__split", *[F.col(f"__rows.{n}").alias(n) for n in values])
    if not large:
        return out.withColumn("__sizes", F.lit(None).cast("array<int>")).drop("__split")
    parts = out.where("__split").groupBy(*strata).agg(F.array_sort(F.collect_list(F.struct("__chunk", "__size"))).alias("__parts"))
    same = F.lit(True)
    for s in strata:
        same = same & F.col(f"o.{s}").eqNullSafe(F.col(f"p.{s}"))
    joined = out.alias("o").join(parts.alias("p"), same, "left")
    at = F.array_position(F.col("p.__parts.__chunk"), F.col("o.__chunk")) - 1  # place among the chunks that have rows
    return joined.select(*[f"o.{c}" for c in (*strata, "__name", "__size")], F.coalesce(at, F.lit(0)).cast("int").alias("__chunk"), F.col("p.__parts.__size").alias("__sizes"), *[f"o.{n}" for n in values])


def places(prefix: str, size: int, numbers: list[bytes]) -> np.ndarray:
    """The drawn places of a packed stratum: for each place the first four bytes of a digest, as a share of the size."""
    begun = prefix.encode()
    md5 = hashlib.md5
    drawn = np.frombuffer(b"".join([md5(begun + n).digest()[:4] for n in numbers[:size]]), ">u4")
    return np.floor(drawn / 4294967296.0 * size).astype("i8")


def draws_in_chunk(prefix: str, sizes: np.ndarray, chunk: int) -> tuple[int, np.random.Generator]:
    """How many of sum(sizes) draws fall into a chunk, and a generator of its own; the same splits are made for all chunks."""
    key = int.from_bytes(hashlib.md5(prefix.encode()).digest(), "little")
    before = np.append(0, np.cumsum(sizes))
    low, high, draws = 0, len(sizes), int(before[-1])
    while high - low > 1:
        middle = (low + high) // 2
        left, all_ = int(before[middle] - before[low]), int(before[high] - before[low])
        node = np.random.Generator(np.random.Philox(key=key, counter=[low, high, 0, 0]))
        first = int(node.binomial(draws, left / all_))
        low, high, draws = (low, middle, first) if chunk < middle else (middle, high, draws - first)
    return draws, np.random.Generator(np.random.Philox(key=key, counter=[low, high, 1, 0]))


def _drawn(units: DataFrame, names: list[str], seed: int) -> DataFrame:
    """repetition and the sums of what is drawn, added up over all units (__name, __size, __chunk, __sizes, __repetitions, __spots, arrays)."""
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        numbers: list[bytes] = []
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                size = columns["__size"][i].as_py()
                values = np.stack([pc.fill_null(columns[n][i].values, 0.0).to_numpy(zero_copy_only=False) for n in names], 1)
                name, parts = columns["__name"][i].as_py(), columns["__sizes"][i].as_py()
                spots = columns["__spots"][i].as_py()
                for k, repetition in enumerate(columns["__repetitions"][i].as_py()):
                    texts = [str(seed), str(repetition), *([] if spots is None else [str(spots[k])]), *([] if name is None else [name])]
                    prefix = ":".join(texts) + ":"
                    if parts is None:
                        while len(numbers) < size:
                            numbers.append(str(len(numbers)).encode())
                        at = places(prefix, size, numbers)
                    else:
                        n, generator = draws_in_chunk(prefix, np.array(parts), columns["__chunk"][i].as_py())
                        at = generator.integers(0, size, n)
                    found = np.bincount(at, minlength=size).astype("f8") @ values
                    if repetition in sums:
                        sums[repetition] += found
                    else:
                        sums[repetition] = found
        if sums:
            table = np.stack(list(sums.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), *[pa.array(table[:, j]) for j in range(width)]], ["repetition", *[f"v{j}" for j in range(width)]])

    kept = units.select("__name", "__size", "__chunk", "__sizes", "__repetitions", "__spots", *names)
    parts = kept.mapInArrow(run, ", ".join(["repetition long", *[f"v{j} double" for j in range(width)]]))
    return parts.groupBy("repetition").agg(*[F.sum(f"v{j}").alias(n) for j, n in enumerate(names)])


def _blocks(repetitions: int) -> Column:
    """Arrays of repetitions, so many at a time that a block has about BLOCK_DRAWS draws."""
    each = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_DRAWS) / F.greatest(F.col("__size"), F.lit(1)))).cast("int")
    starts = F.sequence(F.lit(0), F.lit(repetitions - 1), F.least(each, F.lit(repetitions)))
    return F.transform(starts, lambda s: F.sequence(s, F.least(s + each, F.lit(repetitions)) - 1))


def stratified_sums(df: DataFrame, strata: list[str], order: list[str], sums: dict[str, Column], repetitions: int, seed: int = 7, pack: int = PACK) -> DataFrame:
    """Per repetition sums over rows drawn with replacement within each stratum."""
    strips = packed(df, strata, order, sums, pack)
    units = strips.withColumn("__repetitions", F.explode(_blocks(repetitions))).withColumn("__spots", F.lit(None).cast("array<int>"))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _drawn(units.repartition(partitions, "__name", "__chunk", F.col("__repetitions")[0]), list(sums), seed)


def _ratios(sums: DataFrame, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    return sums.select("repetition", *[F.try_divide(f"{n}0", f"{n}1").alias(n) for n in metrics])


def _both(metrics: dict[str, tuple[Column, Column]]) -> dict[str, Column]:
    return {f"{n}{i}": c for n, both in metrics.items() for i, c in enumerate(both)}


def stratified(df: DataFrame, strata: list[str], order: list[str], metrics: dict[str, tuple[Column, Column]], repetitions: int, seed: int = 7, pack: int = PACK) -> DataFrame:
    """Per repetition the ratio of the sums of each metric's (part, whole)."""
    return _ratios(stratified_sums(df, strata, order, _both(metrics), repetitions, seed, pack), metrics)


def chosen_clusters(df: DataFrame, cluster: str, repetitions: int, seed: int = 7) -> DataFrame:
    """cluster, __block, and arrays __repetitions and __spots of where it is drawn: clusters, in order, are drawn with replacement in every repetition.

    Clusters are few enough for a task (one row each); a row of the result holds the draws of 64 repetitions.
    """
    spark = df.sparkSession
    every = df.select(cluster).distinct()
    schema = every.schema
    name = schema[0].name
    rows = every.groupBy().agg(F.array_sort(F.collect_list(F.struct(cluster))).alias("c"))
    blocks = spark.range(0, -(-repetitions // 64)).select(F.col("id").cast("int").alias("__block"))
    units = blocks.join(F.broadcast(rows))  # one row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, clusters in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not clusters.is_valid or not len(clusters):
                    continue
                size = len(clusters)
                numbers = [str(i).encode() for i in range(size)]
                picks = {r: places(f"{seed}:{r}:cluster:", size, numbers) for r in range(block * 64, min(repetitions, block * 64 + 64))}
                at = np.concatenate(list(picks.values()))
                which, spots = np.repeat(list(picks), size), np.tile(np.arange(size), len(picks))
                order = np.argsort(at, kind="stable")
                at, which, spots = at[order], which[order], spots[order]
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                offsets = pa.array(np.append(first, len(at)), pa.int32())
                ids = pa.array([clusters[int(i)].as_py()[name] for i in at[first]], batch.schema.field(1).type.value_type.field(0).type)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (which, spots)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(first), block, "i4")), *lists], [name, "__block", "__repetitions", "__spots"])

    return units.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, f"`{name}` {schema[0].dataType.simpleString()}, __block int, __repetitions array<int>, __spots array<int>")


def hierarchical_sums(df: DataFrame, cluster: str, strata: list[str], order: list[str], sums: dict[str, Column], repetitions: int, seed: int = 7, pack: int = PACK) -> DataFrame:
    """Per repetition sums over the drawn rows: clusters are drawn with replacement, then rows within each stratum of every drawn cluster, anew for each time it is drawn. Any metric of counts can be made of them."""
    strips = packed(df, [cluster, *strata], order, sums, pack)
    texts = F.array_compact(F.array(*[F.col(s).cast("string") for s in strata])) if strata else F.array().cast("array<string>")
    strips = strips.withColumn("__name", F.when(F.size(texts) > 0, F.concat_ws(":", texts)))  # draws go by the strata alone, as the spot tells the cluster
    chosen = chosen_clusters(df, cluster, repetitions, seed).withColumnRenamed(cluster, "__cluster")
    units = strips.join(chosen, F.col(cluster).eqNullSafe(F.col("__cluster")))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _drawn(units.repartition(partitions, cluster, "__name", "__chunk", "__block"), list(sums), seed)


def hierarchical(df: DataFrame, cluster: str, strata: list[str], order: list[str], metrics: dict[str, tuple[Column, Column]], repetitions: int, seed: int = 7, pack: int = PACK) -> DataFrame:
    """Per repetition the ratio of each metric's (part, whole)."""
    return _ratios(hierarchical_sums(df, cluster, strata, order, _both(metrics), repetitions, seed, pack), metrics)


def f1_sums(name: str, truth: Column, predicted: Column, labels: tuple[str, ...]) -> dict[str, Column]:
    """The counts that macro-F1 is made of, as columns to be summed."""
    one = lambda c: c.cast("double")
    return {f"{name}_{part}_{i}": one(c) for i, x in enumerate(labels) for part, c in (("tp", (truth == x) & (predicted == x)), ("fp", (truth != x) & (predicted == x)), ("fn", (truth == x) & (predicted != x)))}


def macro_f1_of_sums(name: str, labels: tuple[str, ...]) -> Column:
    each = [f1(F.col(f"{name}_tp_{i}"), F.col(f"{name}_fp_{i}"), F.col(f"{name}_fn_{i}")) for i in range(len(labels))]
    return total(each) / len(labels)


def independent(df: DataFrame, order: list[str], metrics: dict[str, tuple[Column, Column]], repetitions: int = 1000, seed: int = 7, confidence: float = 0.95, pack: int = PACK) -> DataFrame:
    """metric, estimate over the rows as they are, and its interval where rows are drawn alike; repetitions without a value don't count. The rows are one stratum, in chunks where they are many."""
    if repetitions <= 0 or not 0 < confidence < 1:
        raise ValueError("repetitions are positive, and the confidence is between 0 and 1")
    whole = df.agg(*[F.try_divide(F.sum(part), F.sum(all_)).alias(n) for n, (part, all_) in metrics.items()]).unpivot([], list(metrics), "metric", "estimate")
    samples = stratified(df.withColumn("__all", F.lit(0)), ["__all"], order, metrics, repetitions, seed, pack).unpivot(["repetition"], list(metrics), "metric", "value")
    q = F.percentile(F.when(~F.isnan("value"), F.col("value")), [(1 - confidence) / 2, (1 + confidence) / 2])
    return whole.join(samples.groupBy("metric").agg(q.alias("__q")), "metric").select("metric", "estimate", F.element_at("__q", 1).alias("lower"), F.element_at("__q", 2).alias("upper"))


def intervals(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and 95 % percentile interval of each metric over the repetitions."""
    long = samples.unpivot(["repetition"], metrics, "metric", "value")
    q = F.percentile("value", [0.025, 0.975])
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), q.alias("__q")).select("metric", "mean", F.element_at("__q", 1).alias("lower95"), F.element_at("__q", 2).alias("upper95"))
