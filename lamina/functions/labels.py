"""Label domains. The order of KNOWN decides ties of equal scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the data model.
KNOWN = ("BCH", "Convolutional", "LDPC", "Polar")
UNCODED = ("no_ecc", "NoECC-Random", "NoECC-Constrained")
UNKNOWN = ("HEDGES", "DNA-Aeon", "unknown_ecc", "Fountain", "LT")
SIX = ("no_ecc", "unknown_ecc", *KNOWN)
SEVEN = ("no_ecc", "uncertain_ecc", "unknown_ecc", *KNOWN)
TRUTH = ("no_ecc", *KNOWN, "HEDGES", "DNA-Aeon")


def is_known(label: Column) -> Column:
    return label.isin(*KNOWN)


def is_unknown(label: Column) -> Column:
    return label.isin(*UNKNOWN)


def is_uncoded(label: Column) -> Column:
    return label.isin(*UNCODED)


def collapsed(label: Column) -> Column:
    """Truth as one of the output labels; anything outside the domains is an error."""
    return (
        F.when(is_uncoded(label), "no_ecc")
        .when(is_unknown(label), "unknown_ecc")
        .when(label.isin(*SEVEN), label)
        .otherwise(F.raise_error(F.concat(F.lit("label outside the domains: "), F.coalesce(label, F.lit("null")))))
    )


def dimension(spark: SparkSession, labels: tuple[str, ...], name: str = "label") -> DataFrame:
    """One row per label, so that labels without rows keep a place in results."""
    return spark.createDataFrame(list(enumerate(labels)), f"position int, {name} string")


def require(df: DataFrame, forbidden: Column, message: str) -> DataFrame:
    """The same rows; running them fails where ``forbidden`` holds."""
    return df.where(F.when(forbidden, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def first_match(pairs: list[tuple[Column, object]], other: object) -> Column:
    return reduce(lambda acc, p: F.when(p[0], p[1]).otherwise(acc), reversed(pairs), F.lit(other) if not isinstance(other, Column) else other)
