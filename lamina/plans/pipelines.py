"""Whole runs composed of the operators: calibrate, compare, evaluate, sweep."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import labels as L
from lamina.functions import scalars
from lamina.operators import decisions, filters, metrics, thresholds, votes

WIDTH = len(L.KNOWN)


def _values(temperature: float) -> dict:
    x = scalars.elements("logits", WIDTH)
    return {"ecc_score": F.col("presence").cast("double"), "energy_score": scalars.energy(x, temperature), **{f"p{i}": c for i, c in enumerate(scalars.softmax(x))}}


def calibrate(reads: DataFrame, acceptance: float = 0.95, temperature: float = 1.0) -> thresholds.Thresholds:
    """From shared logits (archive_id, category, molecule_index, read_index, presence, logits)."""
    rows = reads.withColumnRenamed("molecule_index", "molecule_id")
    return thresholds.calibrate(rows, "category", F.col("presence").cast("double"), scalars.energy(scalars.elements("logits", WIDTH), temperature), acceptance, temperature)


def compare(reads: DataFrame, t: thresholds.Thresholds) -> DataFrame:
    """One row per archive: the closed-set label, and the cascade's output from the same logits."""
    voted = votes.two_level(reads.withColumnRenamed("molecule_index", "molecule_id"), _values(t.temperature), ["archive_id", "category"])
    p = [F.col(f"p{i}") for i in range(WIDTH)]
    closed = scalars.argmax(p, L.KNOWN)
    out = voted.withColumn("closed_output", closed).withColumn("confidence", F.greatest(*p)).withColumn("truth", L.collapsed(F.col("category")))
    return out.withColumn("cascade_output", decisions.cascade(F.col("ecc_score"), F.col("energy_score"), F.col("closed_output"), t.presence, t.unknown_energy))


def summary(compared: DataFrame) -> DataFrame:
    """Rates of both outputs, their six-class macro-F1 and accuracy; one row per method."""
    long = compared.unpivot(["truth"], ["closed_output", "cascade_output"], "method", "output")
    t, o = F.col("truth"), F.col("output")
    rates = long.groupBy("method").agg(
        metrics.share(t == o).alias("accuracy"),
        metrics.share(L.is_known(o), t == "no_ecc").alias("no_ecc_false_known_rate"),
        metrics.share(o == "no_ecc", t == "no_ecc").alias("no_ecc_specificity"),
        metrics.share(o == "unknown_ecc", t == "unknown_ecc").alias("unknown_recall"),
        metrics.share(L.is_known(o), t == "unknown_ecc").alias("unknown_forced_known_rate"),
        metrics.share(L.is_known(o), L.is_known(t)).alias("known_acceptance_rate"),
    )
    return rates.join(metrics.macro_f1(long, "truth", "output", L.SIX, ["method"]), "method")


def sweep(reads: DataFrame, t: thresholds.Thresholds, settings: list[tuple[int, int]]) -> DataFrame:
    """Decisions for prefixes of molecules and reads, all from one table of scores."""
    rows = reads.withColumn("molecule_id", F.col("molecule_index"))
    voted = votes.prefix(rows, _values(t.temperature), settings)
    closed = scalars.argmax([F.col(f"p{i}") for i in range(WIDTH)], L.KNOWN)
    out = decisions.cascade(F.col("ecc_score"), F.col("energy_score"), closed, t.presence, t.unknown_energy)
    return voted.select("archive_id", "m", "q", "ecc_score", "energy_score", closed.alias("closed_output"), out.alias("cascade_output"))


def records(reads: DataFrame, t: thresholds.Thresholds, default: tuple[int, int] = (20, 50), read_sweep: tuple[int, ...] = (1, 5, 10, 20, 50), molecule_sweep: tuple[int, ...] = (1, 5, 10, 20), keys: tuple[str, ...] = ("archive_id", "category")) -> DataFrame:
    """A wide row for each archive and setting (the default, a sweep of reads, a sweep of molecules): scores, both decisions, labels and thresholds.

    Reads have archive_id, category, molecule_index, read_index, presence and logits; further ``keys`` (a seed, an error rate) are kept.
    """
    m, q = default
    settings = [("default", m, q), *[("q_sweep", m, x) for x in read_sweep], *[("M_sweep", x, q) for x in molecule_sweep]]
    x = scalars.elements("logits", WIDTH)
    values = {"ecc_score": F.col("presence").cast("double"), "stage2_energy": scalars.energy(x, t.temperature), **{f"prob_{k}": c for k, c in zip(L.KNOWN, scalars.softmax(x))}, **{f"x{i}": c.cast("double") for i, c in enumerate(x)}}
    voted = votes.prefix(reads, values, [(a, b) for _, a, b in settings], list(keys), "molecule_index")
    same = [F.struct(F.lit(n).alias("setting"), F.lit(a).cast("long").alias("m"), F.lit(b).cast("long").alias("q")) for n, a, b in settings]
    named = voted.withColumn("setting", F.explode(F.transform(F.filter(F.array(*same), lambda s: (s["m"] == F.col("m")) & (s["q"] == F.col("q"))), lambda s: s["setting"])))
    p = [F.col(f"prob_{k}") for k in L.KNOWN]
    closed, truth = scalars.argmax(p, L.KNOWN), L.collapsed(F.col("category"))
    passed = F.col("ecc_score") >= t.presence
    unknown = scalars.exceeds(F.col("stage2_energy"), t.unknown_energy)
    status = F.when(~passed, "no_ecc").when(unknown, "unknown_ecc").otherwise("known_ecc")
    code = F.when(status == "known_ecc", closed)
    return named.select(
        *keys, "setting", F.col("m").alias("M"), "q", (truth != "no_ecc").cast("int").alias("true_presence"), "ecc_score", passed.cast("int").alias("predicted_presence"), "stage2_energy",
        unknown.cast("int").alias("stage2_predicted_unknown"), closed.alias("standalone_type"), status.alias("status"), code.alias("code_type"), F.when(passed, F.col("stage2_energy")).alias("unknown_score"),
        F.greatest(*p).alias("max_type_probability"), F.greatest(*[F.col(f"x{i}") for i in range(WIDTH)]).alias("max_logit"), truth.alias("true_final_label"), F.coalesce(code, status).alias("predicted_final_label"),
        F.lit(t.presence).alias("tau1"), F.lit(t.unknown_energy).alias("tau2"), *[f"prob_{k}" for k in L.KNOWN],
    )


def two_phase(reads: DataFrame, gate, model, presence: float, path: str) -> DataFrame:
    """Scores the gate first, writes its votes, and runs the type model only over reads of archives that pass: Python functions in a condition would run for all rows.

    ``gate`` and ``model`` map a DataFrame of reads to one with their score columns. Reads are let through by a filter of the passing archives'
    keys where they are scanned, and by an exact join after it, so the model is called once for each read that passes.
    """
    votes.two_level(gate(reads), {"ecc_score": F.col("presence").cast("double")}).write.mode("overwrite").parquet(path)
    passed = reads.sparkSession.read.parquet(path).where(F.col("ecc_score") >= presence).select("archive_id")
    return model(filters.passing(reads, passed, "archive_id"))


def called(reads: DataFrame, function, columns: list[str], outputs: list[str], calls) -> DataFrame:
    """The reads with ``outputs`` (doubles) that ``function`` makes of an array of ``columns`` [n, len(columns)], a batch at a time; the accumulator ``calls`` counts the reads it was given (again where a task runs again)."""
    names, kinds = reads.columns, dict(reads.dtypes)

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in columns])
            calls.add(len(x))
            y = np.asarray(function(x), "f8").reshape(len(x), len(outputs))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(y[:, i]) for i in range(len(outputs))]], [*names, *outputs])

    return reads.mapInArrow(run, ", ".join([*[f"`{n}` {kinds[n]}" for n in names], *[f"`{o}` double" for o in outputs]]))
