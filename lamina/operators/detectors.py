"""The four detectors of unknown codes, fitted on known archives: energy, principal components, conformal values, logit features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import scalars
from lamina.functions.labels import KNOWN
from lamina.operators import conformal, distances, features, models, votes

#: Names of the detectors.
DETECTORS = ("global_energy", "pca16_archive_diagonal_minimum", "raw128_archive_conformal_maximum_pvalue", "logits_diagonal_minimum")
COMPONENTS = 16


@dataclass(frozen=True)
class System:
    mean: np.ndarray  # of a read's embedding
    components: np.ndarray
    reduced: distances.ClassModel
    raw: distances.ClassModel
    logits: distances.ClassModel
    calibration: DataFrame  # label, distances of each calibration archive to the classes


def _vectors(reads: DataFrame, mean: np.ndarray, components: np.ndarray, keys: list[str]) -> DataFrame:
    """Per archive: energy, and the vectors ``reduced``, ``raw`` (means and deviations of the reads' embeddings) and ``logits``."""
    x = scalars.elements("logits", len(KNOWN))
    small = F.array(*models.projected(models.standardised("embedding", mean, np.ones(len(mean))), components))
    energy = votes.two_level(reads, {"energy": scalars.energy(x)}, keys).select(*keys, "energy")
    parts = [features.embedding_moments(reads.select(*keys, c.alias("e")), "e", keys, population=False).withColumnRenamed("features", n) for n, c in (("reduced", small), ("raw", F.col("embedding")))]
    wide = features.logit_features(reads, x, keys)
    flat = wide.select(*keys, F.array(*[F.col(c) for c in wide.columns if c not in keys]).alias("logits"))
    return energy.join(parts[0], keys).join(parts[1], keys).join(flat, keys)


def _full(rows: DataFrame, model: distances.ClassModel) -> DataFrame:
    return rows.withColumn("distances", distances.full(F.col("raw"), model))


def fit(fitted: DataFrame, calibration: DataFrame, count: int = COMPONENTS) -> System:
    """From reads (archive_id, category, molecule_id, logits, embedding) of known archives, one part to fit and one to calibrate."""
    known = lambda df: df.where(F.col("category").isin(*KNOWN))
    mean, _ = models.moments(fitted, "embedding")
    components = models.fit_components(fitted, "embedding", min(count, len(mean)), mean, np.ones(len(mean)))
    own = known(_vectors(fitted, mean, components, ["archive_id", "category"]))
    made = {n: distances.fit_vectors(own, n, "category", KNOWN) for n in ("reduced", "raw", "logits")}
    held = _full(known(_vectors(calibration, mean, components, ["archive_id", "category"])), made["raw"])
    return System(mean, components, made["reduced"], made["raw"], made["logits"], held.select(F.col("category").alias("label"), "distances"))


def score(reads: DataFrame, system: System) -> DataFrame:
    """archive_id and the detectors' scores; the larger, the less like a known class."""
    rows = _full(_vectors(reads, system.mean, system.components, ["archive_id"]), system.raw)
    p = conformal.all_classes(system.calibration, rows, "archive_id", KNOWN)
    nearest = lambda c, model: F.array_min(distances.diagonal_vectors(F.col(c), model))
    one = rows.select("archive_id", F.col("energy").alias(DETECTORS[0]), nearest("reduced", system.reduced).alias(DETECTORS[1]), nearest("logits", system.logits).alias(DETECTORS[3]))
    return one.join(p, "archive_id").select("archive_id", DETECTORS[0], DETECTORS[1], conformal.rejection_score(F.col("p_values"), "maximum").alias(DETECTORS[2]), DETECTORS[3])
