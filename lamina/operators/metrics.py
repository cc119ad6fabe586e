"""Evaluation: confusion, per-class reports, rank metrics, risk and coverage, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import storage
from lamina.functions import labels as L
from lamina.functions.scalars import f1, rate_or_zero
from lamina.operators.ordered import running
from lamina.operators.quantiles import grouped


def confusion(df: DataFrame, truth: str, predicted: str, labels: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """Counts of every pair of labels, zeros included; labels outside the domain are an error."""
    by = by or []
    checked = L.require(df, ~F.col(truth).isin(*labels) | ~F.col(predicted).isin(*labels), "label outside the confusion matrix")
    counted = checked.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    pairs = F.array(*[F.struct(F.lit(a).alias("truth"), F.lit(b).alias("predicted")) for a in labels for b in labels])
    groups = counted.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = groups.select(*by, F.explode(pairs).alias("__p")).select(*by, "__p.truth", "__p.predicted")
    return grid.join(counted, [*by, "truth", "predicted"], "left").select(*by, "truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(matrix: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    return matrix.groupBy("truth").pivot("predicted", list(labels)).agg(F.sum("n"))


def class_counts(df: DataFrame, truth: str, predicted: str, labels: tuple[str, ...], by: list[str] | None = None, outside: bool = True) -> DataFrame:
    """tp, fp, fn per label in one pass. With ``outside``, predictions outside the labels are misses; without, such rows are left out."""
    rows = df if outside else df.where(F.col(truth).isin(*labels) & F.col(predicted).isin(*labels))
    rows = rows.groupBy(*(by or []), F.col(truth).alias("__t"), F.col(predicted).alias("__p")).agg(F.count("*").alias("__n"))  # the few pairs first, so that the predicted label is made once a row
    t, p, sums = F.col("__t"), F.col("__p"), []

    def counted(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("__n"))), F.lit(0))

    for i, x in enumerate(labels):
        sums += [counted((t == x) & (p == x)).alias(f"tp_{i}"), counted((t != x) & (p == x)).alias(f"fp_{i}"), counted((t == x) & (p != x)).alias(f"fn_{i}")]
    wide = rows.groupBy(*(by or [])).agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"tp_{i}").alias("tp"), F.col(f"fp_{i}").alias("fp"), F.col(f"fn_{i}").alias("fn")) for i, x in enumerate(labels)]))
    return wide.select(*(by or []), each.alias("__c")).select(*(by or []), "__c.label", "__c.tp", "__c.fp", "__c.fn")


def classification_report(df: DataFrame, truth: str, predicted: str, labels: tuple[str, ...], by: list[str] | None = None, outside: bool = False) -> DataFrame:
    """precision, recall, F1 and support per label; 0 for nothing of nothing."""
    c = class_counts(df, truth, predicted, labels, by, outside)
    precision, recall = rate_or_zero(F.col("tp"), F.col("tp") + F.col("fp")), rate_or_zero(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(*(by or []), "label", precision.alias("precision"), recall.alias("recall"), f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def report_from_matrix(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same from a long confusion matrix."""
    by = by or []
    each = F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), (F.col("truth") == F.col("predicted")).cast("int").alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("t"), (F.col("truth") != F.col("predicted")).cast("int").alias("p"))))
    rows = matrix.select(*by, "n", each.alias("__e")).select(*by, "n", "__e.label", "__e.t", "__e.p")
    c = rows.groupBy(*by, "label").agg(F.sum(F.when((F.col("t") == 1) & (F.col("p") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when((F.col("t") == 0) & (F.col("p") == 1), F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when((F.col("t") == 1) & (F.col("p") == 0), F.col("n")).otherwise(0)).alias("fn"))
    return c.select(*by, "label", rate_or_zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), rate_or_zero(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def macro_f1(df: DataFrame, truth: str, predicted: str, labels: tuple[str, ...], by: list[str] | None = None, outside: bool = True) -> DataFrame:
    return classification_report(df, truth, predicted, labels, by, outside).groupBy(*(by or [])).agg(F.avg("f1").alias("macro_f1"))


def by_score(df: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """Positives and negatives at each distinct score; what rank metrics need, aggregated before anything is ordered."""
    return df.groupBy(*(by or []), F.col(score).alias("score")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))


def auroc(df: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """Share of positive-negative pairs in order, ties half; NaN where a class is missing."""
    r = running(by_score(df, score, positive, by), "score", ["p", "n"], by)
    area = F.sum(F.col("p") * (F.col("cum_n") - F.col("n") / 2))
    pairs = F.max("total_p") * F.max("total_n")
    return r.groupBy(*(by or [])).agg(F.when(pairs > 0, area / pairs).otherwise(float("nan")).alias("auroc"))


def roc_curve(df: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """tpr and fpr of the rule score >= threshold at each distinct score, and of one that no row passes (the origin, whose threshold is null); NaN where a class is missing."""
    r = running(by_score(df, score, positive, by), "score", ["p", "n"], by, descending=True)
    both = (F.col("total_p") > 0) & (F.col("total_n") > 0)
    tpr, fpr = (F.when(both, F.col(f"cum_{x}") / F.col(f"total_{x}")).otherwise(float("nan")) for x in "pn")
    points = r.select(*(by or []), F.col("score").alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"))
    none = df.groupBy(*(by or [])).agg(((F.count_if(positive) > 0) & (F.count_if(~positive) > 0)).alias("__both"), F.count("*").alias("__n")).where("__n > 0")
    start = F.when(F.col("__both"), 0.0).otherwise(float("nan"))
    return points.unionByName(none.select(*(by or []), F.lit(None).cast(points.schema["threshold"].dataType).alias("threshold"), start.alias("tpr"), start.alias("fpr")))


def fpr_at_tpr(df: DataFrame, score: str, positive: Column, target: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """The least fpr of the thresholds that reach the target, 1 where none does; NaN where a class is missing."""
    curve = roc_curve(df, score, positive, by)
    return curve.groupBy(*(by or [])).agg(F.coalesce(F.min(F.when(F.col("tpr") >= target, F.col("fpr"))), F.lit(1.0)).alias("fpr_at_tpr"))  # NaN reaches any target


def average_precision(df: DataFrame, score: str, positive: Column, position: str, by: list[str] | None = None) -> DataFrame:
    """Mean over positives of the precision down to them; equal scores stand in the order of ``position``."""
    rows = df.select(*(by or []), F.col(score).alias("score"), F.col(position).alias("__position"), positive.cast("long").alias("p"), F.lit(1).cast("long").alias("one"))
    r = running(rows, "score", ["p", "one"], by, descending=True, ties=[F.col("__position").asc()])
    return r.groupBy(*(by or [])).agg((F.sum(F.when(F.col("p") == 1, F.col("cum_p") / F.col("cum_one"))) / F.expr("nullif(max(total_p), 0)")).alias("average_precision"))


def risk_coverage_states(df: DataFrame, state: str, truth_unknown: Column, by: list[str] | None = None) -> DataFrame:
    """Of three-state outcomes alone."""
    s = F.col(state)
    decisive = s != "uncertain_ecc"
    right = F.when(truth_unknown, s == "unknown_ecc").otherwise(s == "known_ecc")
    return df.groupBy(*(by or [])).agg(
        F.avg((~decisive).cast("double")).alias("uncertain_rate"),
        F.avg(decisive.cast("double")).alias("decisive_coverage"),
        F.coalesce(F.avg(F.when(decisive, right.cast("double"))), F.lit(0.0)).alias("decisive_binary_accuracy"),
    )


def share(condition: Column, among: Column | None = None) -> Column:
    """Mean of a condition over the rows of ``among``; null over none."""
    value = condition.cast("double")
    return F.avg(value if among is None else F.when(among, value))


def risk_coverage(df: DataFrame, truth: str, output: str, by: list[str] | None = None) -> DataFrame:
    """Of gated outputs, with the truth's families; one pass."""
    known, unknown = L.is_known(F.col(truth)), F.col(truth).isin("HEDGES", "DNA-Aeon")
    out, ecc = F.col(output), known | unknown
    out_known = L.is_known(out)
    seen = F.when(out_known, "known").when(out == "unknown_ecc", "unknown").otherwise("other")
    return df.groupBy(*(by or [])).agg(
        share(out_known, known).alias("known_ecc_output_rate"),
        share(out == "uncertain_ecc", ecc).alias("uncertain_ecc_output_rate"),
        share(out == "unknown_ecc", ecc).alias("unknown_ecc_output_rate"),
        share(~out_known, unknown).alias("unknown_risk_coverage"),
        share(out == "uncertain_ecc", known).alias("known_uncertain_rate"),
        share(out == "uncertain_ecc", unknown).alias("unknown_uncertain_rate"),
        share(out != "uncertain_ecc", ecc).alias("decisive_coverage_ecc"),
        share(seen == F.when(known, "known").otherwise("unknown"), ecc & (out != "uncertain_ecc")).alias("decisive_accuracy_ecc"),
        share(out == "uncertain_ecc").alias("manual_review_rate_all_archives"),
        share(out_known, unknown).alias("unknown_direct_known_rate"),
    )


def detector_rates(df: DataFrame, truth: str, output: str, by: list[str] | None = None) -> DataFrame:
    """Acceptance, recall and forcing rates of one method's outputs; one pass."""
    t, out = F.col(truth), F.col(output)
    known, unknown = L.is_known(t), t.isin("HEDGES", "DNA-Aeon")
    return df.groupBy(*(by or [])).agg(
        share(L.is_known(out), known).alias("known_acceptance_rate"),
        share(~L.is_known(out), known).alias("known_rejection_rate"),
        share(out == "no_ecc", t == "no_ecc").alias("no_ecc_specificity"),
        share(out == "unknown_ecc", t == "HEDGES").alias("HEDGES_unknown_recall"),
        share(out == "unknown_ecc", t == "DNA-Aeon").alias("DNA_Aeon_unknown_recall"),
        share(out == "unknown_ecc", unknown).alias("combined_unknown_recall"),
        share(L.is_known(out), unknown).alias("unknown_forced_known_rate"),
        share(out == "BCH", unknown).alias("unknown_misclassified_as_BCH_rate"),
        *[share(L.is_known(out), t == x).alias(f"{x}_acceptance") for x in L.KNOWN],
    )


METHODS = {"energy_only": "energy_score", "proxy_only": "proxy_score", "three_state": "proxy_score", "G_all": "proxy_score"}  # fixed values: methods and the score each ranks by


def evaluation(df: DataFrame, by: list[str], position: str, truth: str = "truth", closed: str = "closed", methods: dict[str, str] = METHODS) -> DataFrame:
    """One row per group and method: its rates, macro-F1 over known archives and the change from the closed set, and how its score ranks unknown against known archives.

    ``df`` holds a row per archive: truth, closed-set label, scores, and the output of each method under its name. Equal
    scores count known archives first, then the order of the numbers in ``position``.
    """
    keys = [*by, "method"]
    known, unknown = L.is_known(F.col(truth)), F.col(truth).isin("HEDGES", "DNA-Aeon")
    df = storage.stored(df.select(*dict.fromkeys([*by, position, truth, closed, *methods, *methods.values()])), "archives")  # every rate and rank looks through them again
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("output"), F.col(score).cast("double").alias("score")) for m, score in methods.items()])).alias("__e")
    long = df.select(*by, position, truth, closed, each).select(*by, position, truth, closed, "__e.*")
    ranked = long.where(known | unknown).select(*keys, "score", unknown.alias("unknown"), F.struct(unknown.alias("u"), F.col(position).alias("p")).alias("__order"))
    outputs = macro_f1(long.where(known), truth, "output", L.KNOWN, keys).withColumnRenamed("macro_f1", "known_type_macro_f1")
    base = macro_f1(df.where(known), truth, closed, L.KNOWN, by).withColumnRenamed("macro_f1", "closed_macro_f1")
    found = detector_rates(long, truth, "output", keys).join(outputs, keys)
    found = found.join(base, by) if by else found.crossJoin(F.broadcast(base))  # one row
    found = found.withColumn("known_type_macro_f1_change_from_closed", F.col("known_type_macro_f1") - F.col("closed_macro_f1"))
    ranks = auroc(ranked, "score", F.col("unknown"), keys).join(average_precision(ranked, "score", F.col("unknown"), "__order", keys), keys).join(fpr_at_tpr(ranked, "score", F.col("unknown"), by=keys), keys)
    return found.join(ranks, keys)


def success(df: DataFrame, acceptance: float = 0.93, recall: float = 0.8) -> DataFrame:
    """Of evaluation(): whether known archives are accepted, unknown ones found and uncoded ones told apart often enough."""
    return df.select("*", (F.col("known_acceptance_rate") >= acceptance).alias("known_accepted"), (F.col("combined_unknown_recall") >= recall).alias("unknown_found"), (F.col("no_ecc_specificity") >= acceptance).alias("uncoded_kept_apart"))


def best(df: DataFrame, name: str, value: str, by: list[str] | None = None) -> DataFrame:
    """The name of the largest value, the first by name of equal ones; NaN never wins."""
    kept = df.where(~F.isnan(value))
    top = kept.groupBy(*(by or [])).agg(F.min_by(F.struct(name, value), F.struct((-F.col(value)).alias("v"), name)).alias("__b"))
    return top.select(*(by or []), f"__b.{name}", f"__b.{value}")


def distribution(df: DataFrame, value: str, threshold: float, by: list[str]) -> DataFrame:
    """Count, moments, exact interpolated quantiles and shares on either side of a threshold."""
    v = F.col("__q")
    others = [F.count(v).alias("count"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), share(v < threshold).alias("below_tau1_rate"), share(v >= threshold).alias("at_or_above_tau1_rate")]
    found = grouped(df.select(*by, F.col(value).alias("__q")), by, ["__q"], [0.05, 0.25, 0.5, 0.75, 0.95], others)
    names = ("q05", "q25", "median", "q75", "q95")
    return found.select("*", *[F.element_at("__q", i + 1).alias(n) for i, n in enumerate(names)]).drop("__q")


def seed_summary(df: DataFrame, value: str, seed: str, by: list[str], lower_is_better: Column | None = None) -> DataFrame:
    """Mean, both deviations, best and worst seed over non-NaN values; the smaller seed of equal ones."""
    v = F.when(~F.isnan(value), F.col(value))
    signed = F.when(lower_is_better, -v).otherwise(v) if lower_is_better is not None else v
    best, worst = F.struct(signed.alias("s"), (-F.col(seed)).alias("k")), F.struct(signed.alias("s"), F.col(seed).alias("k"))
    kept = df.where(~F.isnan(value) & F.col(value).isNotNull())
    return kept.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.stddev_pop(v).alias("std_population"),
        F.max_by(seed, best).alias("best_seed"), F.max_by(value, best).alias("best_value"), F.min_by(seed, worst).alias("worst_seed"), F.min_by(value, worst).alias("worst_value"),
    )


def unpivoted(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(keys, values, "metric", "value")


def transfer(df: DataFrame, keys: list[str], kind: str, value: str, first: str, second: str) -> DataFrame:
    """Two kinds of one value side by side, and their difference."""
    wide = df.groupBy(*keys).agg(F.max(F.when(F.col(kind) == first, F.col(value))).alias(first), F.max(F.when(F.col(kind) == second, F.col(value))).alias(second))
    return wide.withColumn("difference", F.col(second) - F.col(first))


def agreement(df: DataFrame, detectors: list[str]) -> DataFrame:
    """Share of rows on which each pair of detectors agrees; one pass, no self join."""
    pairs = [(a, b) for a in detectors for b in detectors]
    wide = df.agg(*[share(F.col(a).eqNullSafe(F.col(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("detector_a"), F.lit(b).alias("detector_b"), F.col(f"p{i}").alias("agreement")) for i, (a, b) in enumerate(pairs)]))
    return wide.select(each.alias("__e")).select("__e.*")


def disagreement(df: DataFrame, rejected: list[str], by: str) -> DataFrame:
    every = reduce(lambda a, b: a & b, [F.col(r) for r in rejected])
    some = reduce(lambda a, b: a | b, [F.col(r) for r in rejected])
    return df.groupBy(by).agg(share(every | ~some).alias("unanimous_rate"), share(some & ~every).alias("disagreement_rate"))


