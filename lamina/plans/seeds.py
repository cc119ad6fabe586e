"""Repeated runs by seed as a graph of stages: scores, decisions and metrics of each seed, then summary, pooled metrics, matrices and intervals over all of them."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import labels as L
from lamina.operators import ablation, decisions, metrics, resample
from lamina.plans import pipelines
from lamina.plans import reads as R
from lamina.plans.catalog import big, query, r6
from lamina.plans.graph import Graph, Stage
from lamina.sources import files

SEEDS = (0, 1, 2, 3, 4)
METHODS = ("energy_only", "proxy_only", "three_state")
#: The metrics of which less is better.
LOWER = ("known_rejection_rate", "unknown_forced_known_rate", "unknown_misclassified_as_BCH_rate", "known_uncertain_rate", "unknown_direct_known_rate")


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def seed_scores(lines: DataFrame, seed: int, seeds: int) -> DataFrame:
    """A row per archive of the seed: votes, closed-set label and truth. Only the seed's lines are read on."""
    return R.archives_of(R.scored_lines(lines.where(F.col("l_suppkey") % seeds == seed))).withColumn("seed", F.lit(seed).cast("long"))


def seed_decisions(scores: DataFrame, presence: float, energy: float, proxy: float) -> DataFrame:
    outputs = decisions.frozen(F.col("ecc_score"), F.col("energy_score"), F.col("proxy_score"), F.col("closed"), presence, energy, proxy)
    return scores.select("seed", "archive_id", "truth", "closed", "molecules", "reads", "ecc_score", "energy_score", "proxy_score", *[outputs[m].alias(m) for m in METHODS])


def method_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, method, metric, value: rates of detection and of risk, macro-F1 over known archives and its change from the closed set."""
    long = rows.unpivot([*by, "truth", "closed"], list(METHODS), "method", "output")
    keys = [*by, "method"]
    risk = metrics.risk_coverage(long, "truth", "output", keys).select(*keys, "unknown_risk_coverage", "known_uncertain_rate", "unknown_direct_known_rate", "manual_review_rate_all_archives")
    known = long.where(L.is_known(F.col("truth")))
    after = metrics.macro_f1(known, "truth", "output", L.KNOWN, keys).withColumnRenamed("macro_f1", "known_type_macro_f1")
    base = metrics.macro_f1(known, "truth", "closed", L.KNOWN, keys).withColumnRenamed("macro_f1", "closed_macro_f1")
    wide = metrics.detector_rates(long, "truth", "output", keys).join(risk, keys).join(after, keys, "left").join(base, keys, "left")
    wide = wide.withColumn("known_type_macro_f1_change_from_closed", F.col("known_type_macro_f1") - F.col("closed_macro_f1")).drop("closed_macro_f1")
    return metrics.unpivoted(wide, keys, [c for c in wide.columns if c not in keys])


def summary(found: DataFrame) -> DataFrame:
    """Per method and metric: mean, population deviation, best and worst seed."""
    return metrics.seed_summary(found, "value", "seed", ["method", "metric"], F.col("metric").isin(*LOWER)).drop("std")


def matrices(rows: DataFrame) -> DataFrame:
    """Counts of the seven classes for each seed, and for all (seed null)."""
    each = rows.select("seed", L.collapsed(F.col("truth")).alias("truth"), F.col("three_state").alias("predicted"))
    both = each.unionByName(each.withColumn("seed", F.lit(None).cast("long")))
    return both.groupBy("seed", "truth", "predicted").agg(F.count("*").alias("n"))


def intervals(rows: DataFrame, repetitions: int, seed: int) -> DataFrame:
    """Seeds drawn with replacement, then archives within their classes: mean and 95 % interval of eight metrics."""
    known, unknown = L.is_known(F.col("truth")), F.col("truth").isin("HEDGES", "DNA-Aeon")
    proxy, three = F.col("proxy_only"), F.col("three_state")
    one = lambda c: c.cast("double")
    ratios = {
        "proxy_known_acceptance": (known & L.is_known(proxy), known),
        "proxy_unknown_recall": (unknown & (proxy == "unknown_ecc"), unknown),
        "proxy_forced_known": (unknown & L.is_known(proxy), unknown),
        "three_state_unknown_risk_coverage": (unknown & ~L.is_known(three), unknown),
        "three_state_known_uncertain": (known & (three == "uncertain_ecc"), known),
        "three_state_unknown_direct_known": (unknown & L.is_known(three), unknown),
        "three_state_manual_review": (three == "uncertain_ecc", F.lit(True)),
    }
    sums = {f"{n}{i}": one(c) for n, both in ratios.items() for i, c in enumerate(both)}
    for name, c in (("out", proxy), ("base", F.col("closed"))):
        sums |= {k: one(known) * v for k, v in resample.f1_sums(name, F.col("truth"), c, L.KNOWN).items()}
    drawn = resample.hierarchical_sums(rows, "seed", ["truth"], ["archive_id"], sums, repetitions, seed)
    change = resample.macro_f1_of_sums("out", L.KNOWN) - resample.macro_f1_of_sums("base", L.KNOWN)
    values = drawn.select("repetition", *[F.try_divide(f"{n}0", f"{n}1").alias(n) for n in ratios], change.alias("proxy_macro_f1_change"))
    return resample.intervals(values, [*ratios, "proxy_macro_f1_change"])


def counts(rows: DataFrame) -> DataFrame:
    """Archives, molecules and reads of each seed."""
    return rows.groupBy("seed").agg(F.count("*").alias("archives"), F.sum("molecules").alias("molecules"), F.sum("reads").alias("reads"))


def graph(spark: SparkSession, sf_dir: str, folder: str, presence: float = R.PRESENCE, energy: float = R.ENERGY, proxy: float = R.PROXY, seeds: tuple[int, ...] = SEEDS, repetitions: int = 2000) -> Graph:
    """All stages over the table of lines. A changed threshold leaves the scores as they are."""
    limits = {"presence": presence, "energy": energy, "proxy": proxy}
    stages = []
    for s in seeds:
        stages.append(Stage(f"scores-{s}", seed_scores, ("lines",), {"seed": s, "seeds": len(seeds)}))
        stages.append(Stage(f"decisions-{s}", seed_decisions, (f"scores-{s}",), limits))
        stages.append(Stage(f"metrics-{s}", lambda rows: method_metrics(rows, ["seed"]), (f"decisions-{s}",)))
    decided = tuple(f"decisions-{s}" for s in seeds)
    stages += [
        Stage("summary", lambda *m: summary(_all(*m)), tuple(f"metrics-{s}" for s in seeds)),
        Stage("pooled", lambda *d: method_metrics(_all(*d), []), decided),
        Stage("matrices", lambda *d: matrices(_all(*d)), decided),
        Stage("counts", lambda *d: counts(_all(*d)), decided),
        Stage("intervals", lambda *d, repetitions, seed: intervals(_all(*d), repetitions, seed), decided, {"repetitions": repetitions, "seed": 7}),
    ]
    return Graph(spark, folder, {"lines": f"{sf_dir}/lineitem.parquet"}, stages)


# queries


def _metrics_sql(by: str) -> str:
    """``m``: by, method, metric, value of ``rows`` (by, truth, closed, method, output)."""
    known, unknown = "truth IN (" + ", ".join(f"'{x}'" for x in L.KNOWN) + ")", "truth IN ('HEDGES', 'DNA-Aeon')"
    is_known = known.replace("truth", "output")
    share = lambda c, among="true": f"avg(CAST({c} AS INT)) FILTER (WHERE {among})"
    rates = {
        "known_acceptance_rate": share(is_known, known), "known_rejection_rate": share(f"NOT {is_known}", known), "no_ecc_specificity": share("output = 'no_ecc'", "truth = 'no_ecc'"),
        "HEDGES_unknown_recall": share("output = 'unknown_ecc'", "truth = 'HEDGES'"), "DNA_Aeon_unknown_recall": share("output = 'unknown_ecc'", "truth = 'DNA-Aeon'"), "combined_unknown_recall": share("output = 'unknown_ecc'", unknown),
        "unknown_forced_known_rate": share(is_known, unknown), "unknown_misclassified_as_BCH_rate": share("output = 'BCH'", unknown), **{f"{x}_acceptance": share(is_known, f"truth = '{x}'") for x in L.KNOWN},
        "unknown_risk_coverage": share(f"NOT {is_known}", unknown), "known_uncertain_rate": share("output = 'uncertain_ecc'", known), "unknown_direct_known_rate": share(is_known, unknown), "manual_review_rate_all_archives": share("output = 'uncertain_ecc'"),
    }
    hits = lambda c, x: f"CAST(2 * count(*) FILTER (WHERE truth = '{x}' AND {c} = '{x}') AS DOUBLE) / greatest(1, count(*) FILTER (WHERE {known} AND truth = '{x}') + count(*) FILTER (WHERE {known} AND {c} = '{x}'))"
    f1 = lambda c: "(" + " + ".join(hits(c, x) for x in L.KNOWN) + f") / {len(L.KNOWN)}"
    some = lambda e: f"CASE WHEN count(*) FILTER (WHERE {known}) > 0 THEN {e} END"  # noqa: E731  over no known archives there is none
    rates |= {"known_type_macro_f1": some(f1("output")), "known_type_macro_f1_change_from_closed": some(f"{f1('output')} - {f1('closed')}")}
    wide = f"SELECT {by}method, {', '.join(f'CAST({e} AS DOUBLE) AS "{n}"' for n, e in rates.items())} FROM rows GROUP BY ALL"
    names = ", ".join('"' + n + '"' for n in rates)
    return f"wide AS ({wide}), m AS (SELECT * FROM wide UNPIVOT INCLUDE NULLS (value FOR metric IN ({names})))"


_ROWS = f"WITH {R.DECIDED}, rows AS (SELECT archive_id % 5 AS seed, truth, closed, unnest(['energy_only', 'proxy_only', 'three_state']) AS method, unnest([energy_only, proxy_only, three_state]) AS output FROM decided), "
_SIGN = f"CASE WHEN metric IN ({', '.join(repr(x) for x in LOWER)}) THEN -value ELSE value END"


@query("seed_run_summary", f"""{_ROWS}{_metrics_sql("seed, ")}, s AS (SELECT *, {_SIGN} AS v FROM m WHERE value IS NOT NULL)
SELECT method, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_population, CAST(first(seed ORDER BY v DESC, seed) AS BIGINT) AS best_seed, round(first(value ORDER BY v DESC, seed), 6) AS best_value,
CAST(first(seed ORDER BY v, seed) AS BIGINT) AS worst_seed, round(first(value ORDER BY v, seed), 6) AS worst_value FROM s GROUP BY method, metric""")
def seed_run_summary(spark, sf_dir):
    """The five seeds' runs, each of its own stages, and their summary."""
    found = graph(spark, sf_dir, files.scratch(spark, "seeds")).run(("summary",))["summary"]
    return found.select("method", "metric", r6("mean", "mean"), r6("std_population", "std_population"), "best_seed", r6("best_value", "best_value"), "worst_seed", r6("worst_value", "worst_value"))


@query("seed_run_pooled", f"{_ROWS}{_metrics_sql('')} SELECT method, metric, round(value, 6) AS value FROM m")
def seed_run_pooled(spark, sf_dir):
    """Metrics of all seeds' archives together, from the seeds' written decisions."""
    found = graph(spark, sf_dir, files.scratch(spark, "seeds")).run(("pooled",))["pooled"]
    return found.select("method", "metric", r6("value", "value"))


def _intervals_sql() -> str:
    known, unknown = "t IN (" + ", ".join(f"'{x}'" for x in L.KNOWN) + ")", "t IN ('HEDGES', 'DNA-Aeon')"
    is_known = lambda c: known.replace("t IN", f"{c} IN")
    share = lambda c, among="true": f"avg(CAST({c} AS INT)) FILTER (WHERE {among})"
    hits = lambda c, x: f"CAST(2 * count(*) FILTER (WHERE t = '{x}' AND {c} = '{x}') AS DOUBLE) / greatest(1, count(*) FILTER (WHERE t = '{x}') + count(*) FILTER (WHERE {known} AND {c} = '{x}'))"
    f1 = lambda c: "(" + " + ".join(hits(c, x) for x in L.KNOWN) + f") / {len(L.KNOWN)}"
    metrics_ = {
        "proxy_known_acceptance": share(is_known("p"), known), "proxy_unknown_recall": share("p = 'unknown_ecc'", unknown), "proxy_forced_known": share(is_known("p"), unknown),
        "three_state_unknown_risk_coverage": share(f"NOT {is_known('s')}", unknown), "three_state_known_uncertain": share("s = 'uncertain_ecc'", known), "three_state_unknown_direct_known": share(is_known("s"), unknown),
        "three_state_manual_review": share("s = 'uncertain_ecc'"), "proxy_macro_f1_change": f"{f1('p')} - {f1('b')}",
    }
    draw = "CAST(floor(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::UBIGINT / 4294967296.0 * size) AS INT)"
    values = ", ".join(f"{e} AS {n}" for n, e in metrics_.items())
    return f"""WITH {R.DECIDED}, r AS (SELECT archive_id % 5 AS seed, truth AS category, proxy_only, three_state, closed, row_number() OVER (PARTITION BY archive_id % 5, truth ORDER BY archive_id) - 1 AS k, count(*) OVER (PARTITION BY archive_id % 5, truth) AS size FROM decided),
c AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS k, count(*) OVER () AS size FROM (SELECT DISTINCT seed FROM r)), reps AS (SELECT unnest(range(2000)) AS repetition),
chosen AS (SELECT s.repetition, s.spot, c.seed FROM (SELECT repetition, k AS spot, {draw.format(parts="'7', CAST(repetition AS VARCHAR), 'cluster', CAST(k AS VARCHAR)")} AS k FROM c CROSS JOIN reps) s JOIN c ON c.k = s.k),
d AS (SELECT r.seed, r.category, repetition, {draw.format(parts="'7', CAST(repetition AS VARCHAR), CAST(spot AS VARCHAR), category, CAST(k AS VARCHAR)")} AS k FROM r JOIN chosen ON r.seed = chosen.seed),
j AS (SELECT repetition, category AS t, proxy_only AS p, three_state AS s, closed AS b FROM d JOIN r USING (seed, category, k)), v AS (SELECT repetition, {values} FROM j GROUP BY repetition),
l AS (SELECT metric, value FROM v UNPIVOT (value FOR metric IN ({", ".join(metrics_)})))
SELECT metric, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS lower95, round(quantile_cont(value, 0.975), 6) AS upper95 FROM l GROUP BY metric"""


@query("seed_run_intervals", _intervals_sql())
def seed_run_intervals(spark, sf_dir):
    """Eight metrics over seeds and archives drawn with replacement, from the seeds' written decisions."""
    found = graph(spark, sf_dir, files.scratch(spark, "seeds")).run(("intervals",))["intervals"]
    return found.select("metric", r6("mean", "mean"), r6("lower95", "lower95"), r6("upper95", "upper95"))


_PROXY = 0.6  # another threshold, for a run after the first


def _rows_sql(proxy: float) -> str:
    """Rows of each stage's output, from the tables alone."""
    decided = R.DECIDED.replace(f"proxy_score > {R.PROXY}", f"proxy_score > {proxy}")
    cells = "SELECT DISTINCT {seed}CASE WHEN truth IN ('HEDGES', 'DNA-Aeon') THEN 'unknown_ecc' ELSE truth END AS truth, three_state FROM decided"
    return f"""WITH {decided}, n AS (SELECT archive_id % 5 AS s, count(*) AS n FROM decided GROUP BY 1)
SELECT unnest(['scores-', 'decisions-']) || s AS stage, n AS "rows" FROM n UNION ALL SELECT 'metrics-' || s, 54 FROM n UNION ALL SELECT * FROM (VALUES ('pooled', 54), ('intervals', 8)) t(a, b)
UNION ALL SELECT 'matrices', (SELECT count(*) FROM ({cells.format(seed='archive_id % 5 AS s, ')})) + (SELECT count(*) FROM ({cells.format(seed='')})) UNION ALL SELECT 'counts', count(*) FROM n"""


@query("resumed_run", f"""WITH a AS ({_rows_sql(R.PROXY)}), b AS ({_rows_sql(_PROXY)}) SELECT 1 AS run, stage, 'made' AS status, CAST("rows" AS BIGINT) AS "rows" FROM a UNION ALL SELECT 2, stage, 'kept', CAST("rows" AS BIGINT) FROM a
UNION ALL SELECT 3, stage, CASE WHEN stage LIKE 'scores-%' THEN 'kept' ELSE 'made' END, CAST("rows" AS BIGINT) FROM b""")
def resumed_run(spark, sf_dir):
    """Which stages three runs made: the first, one again, and one of another threshold. The summary is left out, as a metric that no seed has gives it no row."""
    folder, manifests = files.scratch(spark, "seeds"), []
    for number, proxy in enumerate((R.PROXY, R.PROXY, _PROXY), 1):
        g = graph(spark, sf_dir, folder, proxy=proxy, repetitions=100)
        g.run()
        manifests.append(g.manifest().select(F.lit(number).alias("run"), "stage", "status", "rows"))
    return _all(*manifests).where("stage <> 'summary'")


@query("seed_run_counts", "SELECT CAST(l_suppkey % 5 AS BIGINT) AS seed, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS archives, CAST(count(DISTINCT (l_suppkey, l_orderkey % 20)) AS BIGINT) AS molecules, CAST(count(*) AS BIGINT) AS reads FROM lineitem GROUP BY 1")
def seed_run_counts(spark, sf_dir):
    found = graph(spark, sf_dir, files.scratch(spark, "seeds")).run(("counts",))["counts"]
    return found.select("seed", *[big(c, c) for c in ("archives", "molecules", "reads")])


def _energies(x):
    """Minus the log of the summed exponentials, of a batch of logits."""
    most = x.max(axis=1)
    return -(most + np.log(np.exp(x - most[:, None]).sum(axis=1)))


@query("two_phase_scores", f"""WITH {R.SCORED}, v AS (SELECT archive_id FROM (SELECT archive_id, molecule_id, avg(presence) AS p FROM scored GROUP BY ALL) GROUP BY archive_id HAVING avg(p) >= {R.PRESENCE})
SELECT archive_id, CAST(count(*) AS BIGINT) AS reads, round(avg(energy), 6) AS energy, CAST(sum(count(*)) OVER () AS BIGINT) AS calls FROM scored WHERE archive_id IN (SELECT archive_id FROM v) GROUP BY archive_id""")
def two_phase_scores(spark, sf_dir):
    """The type model is called for reads of archives that pass the gate only; ``calls`` is what its accumulator counted."""
    calls, path = spark.sparkContext.accumulator(0), files.scratch(spark, "scores")
    lines = R.read_scores(spark, sf_dir).select("archive_id", "molecule_id", "presence", *[f"x{i}" for i in range(4)])
    scored = pipelines.two_phase(lines, lambda d: d, lambda d: pipelines.called(d, _energies, [f"x{i}" for i in range(4)], ["energy"], calls), R.PRESENCE, files.scratch(spark, "gate"))
    scored.select("archive_id", "energy").write.parquet(path)  # the calls are made here, once
    found = spark.read.parquet(path).groupBy("archive_id").agg(big(F.count("*"), "reads"), r6(F.avg("energy"), "energy"))
    return found.withColumn("calls", F.lit(calls.value).cast("long"))


LAYOUT = {"sequence": (0, 22), "embedding": (22, 43), "logits": (43, 64)}  # the places of a vector of 64, dealt to the three parts


@query("ablation_metrics")
def ablation_metrics(spark, sf_dir):
    """A detector for each part of the vectors and each pair of parts, fitted on vectors of even number and evaluated on odd ones; held against a plain version in the tests."""
    e = R.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("label") >= 8).cast("int").alias("anomaly"))
    even, odd = e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")
    found = ablation.evaluate(odd, "v", "anomaly", ablation.fit(even, "v", "anomaly", LAYOUT), LAYOUT)
    return found.select("ablation", "dimensions", "n", *[r6(c, c) for c in ("threshold", "known_acceptance", "unknown_recall", "auroc")])
