"""Synthetic references and reads as tables. Every row's seed is a function of its key, so rows are made in parallel and again alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import codes, sequences

REFERENCE = "split string, category string, archive_id int, molecule_id int, payload_seed decimal(20,0), sequence string"
READ = "split string, category string, archive_id int, molecule_id int, read_id int, sequence string, template_length int, insertions int, deletions int, substitutions int"
PADDED = 400


def references(spark: SparkSession, categories: list[str], archives: int, molecules: int, split: str = "test", alphabet: str = sequences.BASES) -> DataFrame:
    """One row per molecule."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = np.array(list(alphabet))
        for b in batches:
            made = ["".join(letters[codes.reference(c, split, int(a), int(m))]) for c, a, m in zip(b.category, b.archive_id, b.molecule_id)]
            yield b.assign(sequence=made)[["category", "archive_id", "molecule_id", "sequence"]]

    n = archives * molecules
    keys = spark.range(len(categories) * n).select(
        F.element_at(F.array(*map(F.lit, categories)), (F.col("id") / n).cast("int") + 1).alias("category"),
        (F.col("id") % n / molecules).cast("int").alias("archive_id"),
        (F.col("id") % molecules).cast("int").alias("molecule_id"),
    )
    made = keys.mapInPandas(make, "category string, archive_id int, molecule_id int, sequence string")
    seed = sequences.stable_seed(F.lit("reference"), F.lit(split), F.col("category"), F.col("archive_id"), F.col("molecule_id"))
    return made.select(F.lit(split).alias("split"), "category", "archive_id", "molecule_id", seed.alias("payload_seed"), "sequence")


def reads(refs: DataFrame, per_molecule: int, error_rate: float, shortest: int = 130, longest: int = 384, padded: int = PADDED, alphabet: str = sequences.BASES) -> DataFrame:
    """Noisy reads of random parts of every molecule."""
    number = {c: i for i, c in enumerate(alphabet)}

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = np.array(list(alphabet))
        for b in batches:
            rows = []
            for split, category, a, m, r, s in zip(b.split, b.category, b.archive_id, b.molecule_id, b.read_id, b.sequence):
                whole = np.array([number[c] for c in s], "u1")
                rng = np.random.default_rng(codes.stable_seed("read", split, category, a, m, r, error_rate))
                top = min(longest, len(whole))
                if shortest > top:
                    raise ValueError("a reference is shorter than the shortest read")
                n = int(rng.integers(shortest, top + 1))
                start = int(rng.integers(0, len(whole) - n + 1))
                read, e = codes.noisy(whole[start : start + n], rng, error_rate, error_rate, error_rate, padded)
                rows.append((split, category, a, m, r, "".join(letters[read]), n, e.insertions, e.deletions, e.substitutions))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])

    spread = refs.select("split", "category", "archive_id", "molecule_id", "sequence", F.explode(F.sequence(F.lit(0), F.lit(per_molecule - 1))).alias("read_id"))
    return spread.mapInPandas(make, READ)


def channel_statistics(found: DataFrame) -> DataFrame:
    """Rates of the three events per template base, and read lengths."""
    n = F.sum("template_length")
    return found.agg(F.count("*").alias("reads"), *[(F.sum(c) / n).alias(f"{c}_rate") for c in ("insertions", "deletions", "substitutions")], F.avg(F.length("sequence")).alias("length_mean"), F.stddev_pop(F.length("sequence")).alias("length_std"), F.min(F.length("sequence")).alias("length_min"), F.max(F.length("sequence")).alias("length_max"))


def archive_specs(spark: SparkSession, categories: list[str], archives: int, seed: int) -> DataFrame:
    """One row per archive to be made: key, truth, and the subtype (uncoded archives are random in the first half, constrained in the second)."""
    n = F.lit(archives)
    rows = spark.range(len(categories) * archives).select(F.element_at(F.array(*map(F.lit, categories)), (F.col("id") / n).cast("int") + 1).alias("truth"), (F.col("id") % n).cast("int").alias("archive_index"))
    half = F.when(F.col("archive_index") < archives // 2, "NoECC-Random").otherwise("NoECC-Constrained")
    key = F.concat_ws(":", F.lit(f"seed{seed}"), "truth", F.lpad(F.col("archive_index").cast("string"), 3, "0"))
    return rows.select(F.lit(seed).alias("seed"), "truth", F.when(F.col("truth") == "no_ecc", half).otherwise(F.col("truth")).alias("subtype"), "archive_index", key.alias("archive_id"))


def encoder_seed(category: Column, split: Column, archive: Column, molecule: Column) -> Column:
    """Seed that tells which encoder made a molecule: random codes by split and variant, fixed ones by variant, uncoded ones by molecule."""
    variant = (archive + molecule) % 4
    sizes = F.element_at(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("k")) for n, k in codes.SIZES]), (variant + 1).cast("int"))
    return (
        F.when(category == "LDPC", sequences.stable_seed(F.lit("ldpc-encoder"), split, variant, sizes["n"], sizes["k"]))
        .when(category == "Polar", sequences.stable_seed(F.lit("polar-encoder"), split, variant, sizes["n"], sizes["k"]))
        .when(category == "BCH", sequences.stable_seed(F.lit("fixed-bch-encoder-provenance"), variant))
        .when(category == "Convolutional", sequences.stable_seed(F.lit("fixed-convolutional-encoder-provenance"), variant))
        .otherwise(sequences.stable_seed(F.lit("no-ecc-no-encoder-provenance"), split, category, archive, molecule))
    )
