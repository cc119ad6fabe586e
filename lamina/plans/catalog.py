"""The registered queries of the engine, and the DuckDB SQL with the same results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina import storage
from lamina.functions import labels as L
from lamina.functions import scalars, sequences
from lamina.operators import audit, conformal, decisions, detectors, distances, features, metrics, models, ordered, resample, selection, structure, thresholds, votes
from lamina.plans import reads as R
from lamina.sources import delimited

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c.cast("double"), 6)
    return out.alias(name) if name else out


def big(c: Column | str, name: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """All other columns rounded to six places."""
    return df.select(*[F.col(c) if c in keep else r6(c, c) for c in df.columns])


# scores and votes


@query("two_level_vote", f"""WITH {R.SCORED} SELECT archive_id, round(avg(ecc), 6) AS ecc_score, round(avg(e), 6) AS energy_score, CAST(count(*) AS BIGINT) AS molecules, CAST(sum(n) AS BIGINT) AS reads
FROM (SELECT archive_id, molecule_id, avg(presence) AS ecc, avg(energy) AS e, count(*) AS n FROM scored GROUP BY ALL) GROUP BY archive_id""")
def two_level_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = votes.two_level(R.read_scores(spark, sf_dir), {"ecc_score": F.col("presence"), "energy_score": scalars.energy(R.logits())})
    return v.select("archive_id", r6("ecc_score", "ecc_score"), r6("energy_score", "energy_score"), big("molecules", "molecules"), big("reads", "reads"))


@query("vote_from_partials", f"""WITH {R.READS} SELECT archive_id, round(avg(v), 6) AS ecc_score FROM (SELECT archive_id, molecule_id, avg(presence) AS v FROM reads GROUP BY ALL) GROUP BY archive_id""")
def vote_from_partials(spark, sf_dir):
    reads = R.read_scores(spark, sf_dir)
    half = F.col("l_linenumber") % 2 == 0
    parts = [votes.partial(reads.where(c), {"ecc_score": F.col("presence")}) for c in (half, ~half)]
    return votes.merge(parts[0].unionByName(parts[1]), ["ecc_score"]).select("archive_id", r6("ecc_score", "ecc_score"))


SETTINGS = [(1, 1), (5, 2), (10, 5), (20, 10), (20, 50)]


@query("prefix_vote_sweep", f"""WITH {R.READS}, numbered AS (SELECT archive_id, molecule_id, presence, row_number() OVER (PARTITION BY archive_id, molecule_id ORDER BY {", ".join(R.ORDER)}) - 1 AS read_index FROM reads),
settings AS (SELECT * FROM (VALUES {", ".join(map(str, SETTINGS))}) t(m, q))
SELECT archive_id, CAST(m AS BIGINT) AS m, CAST(q AS BIGINT) AS q, round(avg(v), 6) AS ecc_score FROM (SELECT archive_id, m, q, molecule_id, avg(presence) AS v FROM numbered JOIN settings ON molecule_id < m AND read_index < q GROUP BY ALL) GROUP BY archive_id, m, q""")
def prefix_vote_sweep(spark, sf_dir):
    w = Window.partitionBy("archive_id", "molecule_id").orderBy(*R.ORDER)
    reads = R.read_scores(spark, sf_dir).withColumn("read_index", F.row_number().over(w) - 1).where(F.col("read_index") < max(q for _, q in SETTINGS))
    return votes.prefix(reads, {"ecc_score": F.col("presence")}, SETTINGS, molecule_index="molecule_id").select("archive_id", big("m", "m"), big("q", "q"), r6("ecc_score", "ecc_score"))


GRID = (20, 50)


@query("prefix_vote_grid", f"""WITH {R.SCORED}, numbered AS (SELECT archive_id, molecule_id, energy, row_number() OVER (PARTITION BY archive_id, molecule_id ORDER BY {", ".join(R.ORDER)}) - 1 AS read_index FROM scored),
settings AS (SELECT m, q FROM (SELECT unnest(range(1, {GRID[0] + 1})) AS m), (SELECT unnest(range(1, {GRID[1] + 1})) AS q))
SELECT archive_id, CAST(m AS BIGINT) AS m, CAST(q AS BIGINT) AS q, round(avg(v), 6) AS energy_score, CAST(count(*) AS BIGINT) AS molecules, CAST(sum(n) AS BIGINT) AS reads
FROM (SELECT archive_id, m, q, molecule_id, avg(energy) AS v, count(*) AS n FROM numbered JOIN settings ON molecule_id < m AND read_index < q GROUP BY ALL) GROUP BY archive_id, m, q""")
def prefix_vote_grid(spark, sf_dir):
    """Votes of all 1,000 settings at once."""
    w = Window.partitionBy("archive_id", "molecule_id").orderBy(*R.ORDER)
    reads = R.read_scores(spark, sf_dir).withColumn("read_index", F.row_number().over(w) - 1).where(F.col("read_index") < GRID[1])
    v = votes.prefix(reads, {"energy_score": scalars.energy(R.logits())}, votes.grid(*GRID), molecule_index="molecule_id")
    return v.select("archive_id", "m", "q", r6("energy_score", "energy_score"), "molecules", "reads")


_RECORDS = [("default", 20, 50), *[("q_sweep", 20, q) for q in (1, 5, 10, 20, 50)], *[("M_sweep", m, 50) for m in (1, 5, 10, 20)]]
_PASSED, _FAR = f"ecc_score >= {R.PRESENCE}", f"energy > {R.ENERGY}"


@query("prefix_records", f"""WITH {R.SCORED}, numbered AS (SELECT *, row_number() OVER (PARTITION BY archive_id, molecule_id ORDER BY {", ".join(R.ORDER)}) - 1 AS read_index FROM scored),
settings AS (SELECT * FROM (VALUES {", ".join(map(str, _RECORDS))}) t(setting, m, q)),
inner_ AS (SELECT archive_id, category, setting, settings.m AS m, settings.q AS q, molecule_id, avg(presence) AS ecc_score, avg(energy) AS energy, {", ".join(f"avg(p{i}) AS p{i}, avg(x{i}) AS x{i}" for i in range(4))} FROM numbered JOIN settings ON molecule_id < settings.m AND read_index < settings.q GROUP BY ALL),
v AS (SELECT archive_id, category, setting, m, q, avg(ecc_score) AS ecc_score, avg(energy) AS energy, {", ".join(f"avg(p{i}) AS p{i}, avg(x{i}) AS x{i}" for i in range(4))} FROM inner_ GROUP BY ALL),
c AS (SELECT *, {R._argmax} AS closed, CASE WHEN category IN ('HEDGES', 'DNA-Aeon') THEN 'unknown_ecc' ELSE category END AS truth, CASE WHEN NOT {_PASSED} THEN 'no_ecc' WHEN {_FAR} THEN 'unknown_ecc' ELSE 'known_ecc' END AS status FROM v)
SELECT archive_id, category, setting, CAST(m AS BIGINT) AS "M", CAST(q AS BIGINT) AS q, CAST(truth <> 'no_ecc' AS INT) AS true_presence, round(ecc_score + 1e-9, 6) AS ecc_score, CAST({_PASSED} AS INT) AS predicted_presence, round(energy, 6) AS stage2_energy, CAST({_FAR} AS INT) AS stage2_predicted_unknown,
closed AS standalone_type, status, CASE WHEN status = 'known_ecc' THEN closed END AS code_type, CASE WHEN {_PASSED} THEN round(energy, 6) END AS unknown_score, round(greatest(p0, p1, p2, p3), 6) AS max_type_probability, round(greatest(x0, x1, x2, x3) + 1e-9, 6) AS max_logit, truth AS true_final_label,
CASE WHEN status = 'known_ecc' THEN closed ELSE status END AS predicted_final_label, CAST({R.PRESENCE} AS DOUBLE) AS tau1, CAST({R.ENERGY} AS DOUBLE) AS tau2, {", ".join(f'round(p{i}, 6) AS "prob_{k}"' for i, k in enumerate(L.KNOWN))} FROM c""")
def prefix_records(spark, sf_dir):
    """The wide row of every archive and setting: default, sweep of reads, sweep of molecules."""
    from lamina.plans import pipelines

    w = Window.partitionBy("archive_id", "molecule_id").orderBy(*R.ORDER)
    reads = R.read_scores(spark, sf_dir).withColumn("read_index", F.row_number().over(w) - 1).where(F.col("read_index") < GRID[1])
    reads = reads.select("archive_id", "category", F.col("molecule_id").alias("molecule_index"), "read_index", "presence", F.array(*R.logits()).alias("logits"))
    r = pipelines.records(reads, thresholds.Thresholds(R.PRESENCE, R.ENERGY))
    scores = {"stage2_energy", "unknown_score", "max_type_probability", *[f"prob_{k}" for k in L.KNOWN]}
    even = {"ecc_score", "max_logit"}  # means of a few short decimals, many half-way between two rounded numbers, some so with 1e-9 too: the digits of noise go first
    return r.select(*[r6(c, c) if c in scores else r6(F.round(F.col(c) + 1e-9, 12), c) if c in even else F.col(c) for c in r.columns])


@query("softmax_argmax", f"""WITH {R.SCORED} SELECT {R._argmax} AS predicted, CAST(count(*) AS BIGINT) AS n, round(avg(greatest(p0, p1, p2, p3)), 6) AS mean_confidence FROM scored GROUP BY 1""")
def softmax_argmax(spark, sf_dir):
    p = scalars.softmax(R.logits())
    rows = R.read_scores(spark, sf_dir).select(scalars.argmax(p, L.KNOWN).alias("predicted"), F.greatest(*p).alias("c"))
    return rows.groupBy("predicted").agg(big(F.count("*"), "n"), r6(F.avg("c"), "mean_confidence"))


@query("energy_score", """WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / 2.0) AS h FROM embeddings), m AS (SELECT vec_id, h[1] AS a, h, list_max(h) AS m FROM h)
SELECT vec_id, round(-2.0 * (m + ln(list_sum(list_transform(h, lambda x: exp(x - m))))), 6) AS energy, round(CASE WHEN a >= 0 THEN 1 / (1 + exp(-a)) ELSE exp(a) / (1 + exp(a)) END, 6) AS sigmoid FROM m""")
def energy_score(spark, sf_dir):
    """The energy of all places at temperature 2, and the sigmoid of the first."""
    x = scalars.elements("embedding", 64)
    return R.table(spark, sf_dir, "embeddings").select("vec_id", r6(scalars.energy(x, 2.0), "energy"), r6(scalars.stable_sigmoid(x[0] / 2.0), "sigmoid"))


# decisions


@query("cascade_decision", f"WITH {R.DECIDED} SELECT archive_id, truth, closed, energy_only AS output, round(ecc_score, 6) AS ecc_score, round(energy_score, 6) AS energy_score FROM decided")
def cascade_decision(spark, sf_dir):
    a = R.archives(spark, sf_dir)
    out = decisions.cascade(F.col("ecc_score"), F.col("energy_score"), F.col("closed"), R.PRESENCE, R.ENERGY)
    return a.select("archive_id", "truth", "closed", out.alias("output"), r6("ecc_score", "ecc_score"), r6("energy_score", "energy_score"))


@query("frozen_decisions", f"WITH {R.DECIDED} SELECT archive_id, energy_only, proxy_only, three_state, proxy_only AS \"G_all\" FROM decided")
def frozen_decisions(spark, sf_dir):
    return R.decided(spark, sf_dir).select("archive_id", "energy_only", "proxy_only", "three_state", "G_all")


@query("three_state", f"""WITH {R.ARCHIVES} SELECT archive_id, CASE WHEN energy_score > {R.ENERGY} AND proxy_score > {R.PROXY} THEN 'unknown_ecc' WHEN energy_score > {R.ENERGY} OR proxy_score > {R.PROXY} THEN 'uncertain_ecc' ELSE 'known_ecc' END AS state FROM archives""")
def three_state(spark, sf_dir):
    a = R.archives(spark, sf_dir)
    return a.select("archive_id", decisions.three_state(scalars.exceeds(F.col("energy_score"), R.ENERGY), scalars.exceeds(F.col("proxy_score"), R.PROXY)).alias("state"))


def _rejected() -> dict[str, Column]:
    return {"energy": scalars.exceeds(F.col("energy_score"), R.ENERGY), "proxy": scalars.exceeds(F.col("proxy_score"), R.PROXY), "gate": F.col("ecc_score") < R.PRESENCE, "peak": F.greatest("p0", "p1", "p2", "p3") < 0.6}


_REJECTED_SQL = f"rejected AS (SELECT *, energy_score > {R.ENERGY} AS energy, proxy_score > {R.PROXY} AS proxy, ecc_score < {R.PRESENCE} AS gate, greatest(p0, p1, p2, p3) < 0.6 AS peak FROM archives)"


@query("multidetector_rules", f"""WITH {R.ARCHIVES}, {_REJECTED_SQL}, counted AS (SELECT archive_id, CAST(energy AS INT) + CAST(proxy AS INT) + CAST(gate AS INT) + CAST(peak AS INT) AS k FROM rejected)
SELECT archive_id, CASE k WHEN 0 THEN 'known_ecc' WHEN 4 THEN 'unknown_ecc' ELSE 'uncertain_ecc' END AS consensus, CASE k WHEN 4 THEN 'unknown_ecc' ELSE 'known_ecc' END AS and_reject,
CASE WHEN k > 0 THEN 'unknown_ecc' ELSE 'known_ecc' END AS or_reject, CASE WHEN k < 2 THEN 'known_ecc' WHEN k > 2 THEN 'unknown_ecc' ELSE 'uncertain_ecc' END AS majority FROM counted""")
def multidetector_rules(spark, sf_dir):
    a = R.archives(spark, sf_dir)
    return a.select("archive_id", *[decisions.combined(list(_rejected().values()), logic).alias(logic) for logic in selection.LOGICS])


@query("detector_agreement", f"WITH {R.ARCHIVES}, {_REJECTED_SQL}, long AS (SELECT archive_id, unnest(['energy', 'proxy', 'gate', 'peak']) AS d, unnest([energy, proxy, gate, peak]) AS v FROM rejected) SELECT a.d AS detector_a, b.d AS detector_b, round(avg(CAST(a.v = b.v AS INT)), 6) AS agreement FROM long a JOIN long b USING (archive_id) GROUP BY 1, 2")
def detector_agreement(spark, sf_dir):
    a = R.archives(spark, sf_dir).select(*[c.alias(n) for n, c in _rejected().items()])
    return rounded(metrics.agreement(a, list(_rejected())), "detector_a", "detector_b")


@query("detector_disagreement", f"WITH {R.ARCHIVES}, {_REJECTED_SQL} SELECT truth, round(avg(CAST((energy AND proxy AND gate AND peak) OR NOT (energy OR proxy OR gate OR peak) AS INT)), 6) AS unanimous_rate, round(avg(CAST((energy OR proxy OR gate OR peak) AND NOT (energy AND proxy AND gate AND peak) AS INT)), 6) AS disagreement_rate FROM rejected GROUP BY truth")
def detector_disagreement(spark, sf_dir):
    a = R.archives(spark, sf_dir).select("truth", *[c.alias(n) for n, c in _rejected().items()])
    return rounded(metrics.disagreement(a, list(_rejected()), "truth"), "truth")


# evaluation

_KNOWN = "(" + ", ".join(f"'{x}'" for x in L.KNOWN) + ")"
_SEVEN = ", ".join(f"('{x}')" for x in L.SEVEN)


@query("confusion_matrix", f"""WITH {R.DECIDED}, rows AS (SELECT CASE WHEN truth IN ('HEDGES', 'DNA-Aeon') THEN 'unknown_ecc' ELSE truth END AS truth, three_state AS predicted FROM decided), l AS (SELECT * FROM (VALUES {_SEVEN}) t(x))
SELECT a.x AS truth, b.x AS predicted, CAST((SELECT count(*) FROM rows WHERE rows.truth = a.x AND rows.predicted = b.x) AS BIGINT) AS n FROM l a CROSS JOIN l b""")
def confusion_matrix(spark, sf_dir):
    d = R.decided(spark, sf_dir).select(L.collapsed(F.col("truth")).alias("truth"), "three_state")
    return metrics.confusion(d, "truth", "three_state", L.SEVEN).select("truth", "predicted", big("n", "n"))


def _report_sql(rows: str) -> str:
    return f"""l AS (SELECT unnest(['{"', '".join(L.KNOWN)}']) AS label), c AS (SELECT label, count(*) FILTER (WHERE truth = label AND predicted = label) AS tp, count(*) FILTER (WHERE truth <> label AND predicted = label) AS fp, count(*) FILTER (WHERE truth = label AND predicted <> label) AS fn FROM l CROSS JOIN {rows} GROUP BY label)"""


@query("classification_report", f"""WITH {R.SCORED}, rows AS (SELECT category AS truth, {R._argmax} AS predicted FROM scored WHERE category IN {_KNOWN}), {_report_sql("rows")}
SELECT label, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, CAST(tp + fn AS BIGINT) AS support FROM c""")
def classification_report(spark, sf_dir):
    d = R.read_scores(spark, sf_dir).select("category", scalars.argmax(R.logits(), L.KNOWN).alias("predicted"))  # softmax keeps the order
    r = metrics.classification_report(d, "category", "predicted", L.KNOWN)
    return r.select("label", r6("precision", "precision"), r6("recall", "recall"), r6("f1", "f1"), big("support", "support"))


@query("report_from_matrix", ORACLES["classification_report"])
def report_from_matrix(spark, sf_dir):
    d = R.read_scores(spark, sf_dir).where(F.col("category").isin(*L.KNOWN)).select("category", scalars.argmax(R.logits(), L.KNOWN).alias("predicted"))
    r = metrics.report_from_matrix(metrics.confusion(d, "category", "predicted", L.KNOWN))
    return r.select("label", r6("precision", "precision"), r6("recall", "recall"), r6("f1", "f1"), big("support", "support"))


@query("macro_f1", f"""WITH {R.DECIDED}, rows AS (SELECT truth, energy_only AS predicted FROM decided WHERE truth IN {_KNOWN}), {_report_sql("rows")} SELECT round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1 FROM c""")
def macro_f1(spark, sf_dir):
    d = R.decided(spark, sf_dir).where(L.is_known(F.col("truth")))
    return rounded(metrics.macro_f1(d, "truth", "energy_only", L.KNOWN))


_BINARY = "b AS (SELECT quality, toxic, n_chars AS score, doc_id FROM labels JOIN documents USING (doc_id))"


def _binary(spark, sf_dir) -> DataFrame:
    return R.table(spark, sf_dir, "labels").join(R.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score")), "doc_id")


@query("auroc", f"WITH {_BINARY}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM b) SELECT round((sum(r) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2.0) / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0)), 6) AS auroc FROM r")
def auroc(spark, sf_dir):
    return rounded(metrics.auroc(_binary(spark, sf_dir), "score", F.col("quality") == 1))


@query("auroc_by_method", f"""WITH {R.READS}, s AS (SELECT category IN {_KNOWN} AS known, unnest(['x0', 'x3', 'presence']) AS method, unnest([x0, x3, presence]) AS score FROM reads),
r AS (SELECT method, known, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS r FROM s)
SELECT method, round((sum(r) FILTER (WHERE known) - count(*) FILTER (WHERE known) * (count(*) FILTER (WHERE known) + 1) / 2.0) / (CAST(count(*) FILTER (WHERE known) AS DOUBLE) * count(*) FILTER (WHERE NOT known)), 6) AS auroc FROM r GROUP BY method""")
def auroc_by_method(spark, sf_dir):
    reads = R.read_scores(spark, sf_dir).select(F.col("category").isin(*L.KNOWN).alias("known"), "x0", "x3", "presence")
    long = reads.unpivot(["known"], ["x0", "x3", "presence"], "method", "score")
    return rounded(metrics.auroc(long, "score", F.col("known"), ["method"]), "method")


@query("average_precision", f"WITH {_BINARY}, o AS (SELECT quality, sum(quality) OVER w AS tp, count(*) OVER w AS n FROM b WINDOW w AS (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT round(sum(tp / n) FILTER (WHERE quality = 1) / count(*) FILTER (WHERE quality = 1), 6) AS average_precision FROM o")
def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(_binary(spark, sf_dir), "score", F.col("quality") == 1, "doc_id"))


@query("fpr_at_tpr", f"WITH {_BINARY}, t AS (SELECT DISTINCT score AS t FROM b), c AS (SELECT t, count(*) FILTER (WHERE quality = 1 AND score >= t) / (SELECT count(*) FROM b WHERE quality = 1) AS tpr, count(*) FILTER (WHERE quality = 0 AND score >= t) / (SELECT count(*) FROM b WHERE quality = 0) AS fpr FROM t CROSS JOIN b GROUP BY t) SELECT round(coalesce(min(fpr) FILTER (WHERE tpr >= 0.95), 1.0), 6) AS fpr_at_tpr FROM c")
def fpr_at_tpr(spark, sf_dir):
    return rounded(metrics.fpr_at_tpr(_binary(spark, sf_dir), "score", F.col("quality") == 1))


@query("roc_curve", f"WITH {_BINARY}, g AS (SELECT score, sum(quality) AS p, sum(1 - quality) AS n FROM b GROUP BY score) SELECT CAST(score AS BIGINT) AS threshold, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) UNION ALL SELECT NULL, 0.0, 0.0")
def roc_curve(spark, sf_dir):
    return rounded(metrics.roc_curve(_binary(spark, sf_dir), "score", F.col("quality") == 1), "threshold")


def _share_sql(condition: str, among: str) -> str:
    return f"round(avg(CAST({condition} AS INT)) FILTER (WHERE {among}), 6)"


_K, _U = f"truth IN {_KNOWN}", "truth IN ('HEDGES', 'DNA-Aeon')"


@query("risk_coverage", f"""WITH {R.DECIDED}, o AS (SELECT truth, three_state AS o FROM decided) SELECT {_share_sql(f"o IN {_KNOWN}", _K)} AS known_ecc_output_rate, {_share_sql("o = 'uncertain_ecc'", f"{_K} OR {_U}")} AS uncertain_ecc_output_rate,
{_share_sql("o = 'unknown_ecc'", f"{_K} OR {_U}")} AS unknown_ecc_output_rate, {_share_sql(f"o NOT IN {_KNOWN}", _U)} AS unknown_risk_coverage, {_share_sql("o = 'uncertain_ecc'", _K)} AS known_uncertain_rate, {_share_sql("o = 'uncertain_ecc'", _U)} AS unknown_uncertain_rate,
{_share_sql("o <> 'uncertain_ecc'", f"{_K} OR {_U}")} AS decisive_coverage_ecc, {_share_sql(f"({_K} AND o IN {_KNOWN}) OR ({_U} AND o = 'unknown_ecc')", f"({_K} OR {_U}) AND o <> 'uncertain_ecc'")} AS decisive_accuracy_ecc, {_share_sql("o = 'uncertain_ecc'", "true")} AS manual_review_rate_all_archives, {_share_sql(f"o IN {_KNOWN}", _U)} AS unknown_direct_known_rate FROM o""")
def risk_coverage(spark, sf_dir):
    return rounded(metrics.risk_coverage(R.decided(spark, sf_dir), "truth", "three_state"))


@query("risk_coverage_states", f"""WITH {R.ARCHIVES}, s AS (SELECT {_U} AS unknown, CASE WHEN energy_score > {R.ENERGY} AND proxy_score > {R.PROXY} THEN 'unknown_ecc' WHEN energy_score > {R.ENERGY} OR proxy_score > {R.PROXY} THEN 'uncertain_ecc' ELSE 'known_ecc' END AS state FROM archives WHERE {_U} OR {_K})
SELECT round(avg(CAST(state = 'uncertain_ecc' AS INT)), 6) AS uncertain_rate, round(avg(CAST(state <> 'uncertain_ecc' AS INT)), 6) AS decisive_coverage, round(coalesce(avg(CAST(CASE WHEN unknown THEN state = 'unknown_ecc' ELSE state = 'known_ecc' END AS INT)) FILTER (WHERE state <> 'uncertain_ecc'), 0), 6) AS decisive_binary_accuracy FROM s""")
def risk_coverage_states(spark, sf_dir):
    unknown = F.col("truth").isin("HEDGES", "DNA-Aeon")
    a = R.archives(spark, sf_dir).where(unknown | L.is_known(F.col("truth")))
    a = a.withColumn("state", decisions.three_state(scalars.exceeds(F.col("energy_score"), R.ENERGY), scalars.exceeds(F.col("proxy_score"), R.PROXY)))
    return rounded(metrics.risk_coverage_states(a, "state", unknown))


@query("detector_rates", f"""WITH {R.DECIDED}, o AS (SELECT truth, unnest(['energy_only', 'proxy_only', 'three_state']) AS method, unnest([energy_only, proxy_only, three_state]) AS o FROM decided)
SELECT method, {_share_sql(f"o IN {_KNOWN}", _K)} AS known_acceptance_rate, {_share_sql(f"o NOT IN {_KNOWN}", _K)} AS known_rejection_rate, {_share_sql("o = 'no_ecc'", "truth = 'no_ecc'")} AS no_ecc_specificity, {_share_sql("o = 'unknown_ecc'", "truth = 'HEDGES'")} AS "HEDGES_unknown_recall", {_share_sql("o = 'unknown_ecc'", "truth = 'DNA-Aeon'")} AS "DNA_Aeon_unknown_recall",
{_share_sql("o = 'unknown_ecc'", _U)} AS combined_unknown_recall, {_share_sql(f"o IN {_KNOWN}", _U)} AS unknown_forced_known_rate, {_share_sql("o = 'BCH'", _U)} AS "unknown_misclassified_as_BCH_rate", {", ".join(_share_sql(f"o IN {_KNOWN}", f"truth = '{x}'") + f' AS "{x}_acceptance"' for x in L.KNOWN)} FROM o GROUP BY method""")
def detector_rates(spark, sf_dir):
    long = R.decided(spark, sf_dir).unpivot(["truth"], ["energy_only", "proxy_only", "three_state"], "method", "output")
    return rounded(metrics.detector_rates(long, "truth", "output", ["method"]), "method")


_DIST = f"CAST(count(s) AS BIGINT) AS count, round(avg(s), 6) AS mean, round(coalesce(stddev_samp(s), 0), 6) AS std, round(min(s), 6) AS min, round(max(s), 6) AS max, {', '.join(f'round(quantile_cont(s, {q}), 6) AS {n}' for q, n in ((0.05, 'q05'), (0.25, 'q25'), (0.5, 'median'), (0.75, 'q75'), (0.95, 'q95')))}, round(avg(CAST(s < {R.PRESENCE} AS INT)), 6) AS below_tau1_rate, round(avg(CAST(s >= {R.PRESENCE} AS INT)), 6) AS at_or_above_tau1_rate"


@query("ecc_score_distribution", f"WITH {R.ARCHIVES}, g AS (SELECT truth AS family, ecc_score AS s FROM archives UNION ALL SELECT 'all', ecc_score FROM archives) SELECT family, {_DIST} FROM g GROUP BY family")
def ecc_score_distribution(spark, sf_dir):
    a = R.archives(spark, sf_dir).select(F.explode(F.array("truth", F.lit("all"))).alias("family"), "ecc_score")
    d = metrics.distribution(a, "ecc_score", R.PRESENCE, ["family"])
    return rounded(d.withColumn("count", F.col("count").cast("long")), "family", "count")


@query("score_ecdf", f"""WITH {R.ARCHIVES}, g AS (SELECT truth AS family, round(ecc_score, 9) AS s FROM archives UNION ALL SELECT 'all', round(ecc_score, 9) FROM archives)
SELECT family, round(s + 1e-9, 6) AS score, CAST(count(*) AS BIGINT) AS n, round(sum(count(*)) OVER (PARTITION BY family ORDER BY s) / sum(count(*)) OVER (PARTITION BY family), 6) AS cumulative FROM g GROUP BY family, s""")
def score_ecdf(spark, sf_dir):
    """The curve of each family's scores, and of all."""
    a = R.archives(spark, sf_dir).select(F.explode(F.array("truth", F.lit("all"))).alias("family"), F.round("ecc_score", 9).alias("score"))
    e = ordered.ecdf(a, "score", ["family"])
    return e.select("family", r6(F.col("score") + 1e-9, "score"), big("n", "n"), r6("cumulative", "cumulative"))


@query("seed_summary", """WITH v AS (SELECT o_orderpriority AS method, year(o_orderdate) AS seed, avg(o_totalprice) AS value FROM orders GROUP BY ALL)
SELECT method, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(stddev_pop(value), 6) AS std_population, CAST(arg_max(seed, value) AS BIGINT) AS best_seed, round(max(value), 6) AS best_value, CAST(arg_min(seed, value) AS BIGINT) AS worst_seed, round(min(value), 6) AS worst_value FROM v GROUP BY method""")
def seed_summary(spark, sf_dir):
    v = R.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method"), F.year("o_orderdate").cast("long").alias("seed")).agg(F.avg("o_totalprice").alias("value"))
    return rounded(metrics.seed_summary(v, "value", "seed", ["method"]), "method", "best_seed", "worst_seed")


@query("sweep_curves", f"""WITH {R.READS} SELECT CASE WHEN grouping(l_discount) = 0 THEN 'error_rate' WHEN grouping(l_linenumber) = 0 THEN 'q' ELSE 'm' END AS sweep, CAST(coalesce(l_discount, l_linenumber, molecule_id) AS DOUBLE) AS setting, round(avg(presence), 6) AS ecc_score, CAST(count(*) AS BIGINT) AS n FROM reads GROUP BY GROUPING SETS ((l_discount), (l_linenumber), (molecule_id))""")
def sweep_curves(spark, sf_dir):
    reads = R.read_scores(spark, sf_dir).select("presence", "l_discount", "l_linenumber", "molecule_id")
    g = reads.groupingSets([[F.col("l_discount")], [F.col("l_linenumber")], [F.col("molecule_id")]], F.col("l_discount"), F.col("l_linenumber"), F.col("molecule_id")).agg(F.avg("presence").alias("v"), F.count("*").alias("n"), F.grouping("l_discount").alias("gd"), F.grouping("l_linenumber").alias("gl"))
    kind = F.when(F.col("gd") == 0, "error_rate").when(F.col("gl") == 0, "q").otherwise("m")
    return g.select(kind.alias("sweep"), F.coalesce(F.col("l_discount"), F.col("l_linenumber").cast("double"), F.col("molecule_id").cast("double")).alias("setting"), r6("v", "ecc_score"), big("n", "n"))


@query("metric_unpivot", "SELECT l_returnflag AS method, unnest(['quantity', 'price', 'discount']) AS metric, unnest([round(avg(l_quantity), 6), round(avg(l_extendedprice), 6), round(avg(l_discount), 6)]) AS value FROM lineitem GROUP BY l_returnflag")
def metric_unpivot(spark, sf_dir):
    g = R.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"))
    return rounded(metrics.unpivoted(g, ["method"], ["quantity", "price", "discount"]), "method", "metric")


@query("threshold_transfer", "WITH v AS (SELECT l_returnflag AS condition, l_linestatus AS kind, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL) SELECT condition, round(max(v) FILTER (WHERE kind = 'F'), 6) AS \"F\", round(max(v) FILTER (WHERE kind = 'O'), 6) AS \"O\", round(max(v) FILTER (WHERE kind = 'O') - max(v) FILTER (WHERE kind = 'F'), 6) AS difference FROM v GROUP BY condition")
def threshold_transfer(spark, sf_dir):
    v = R.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("condition"), F.col("l_linestatus").alias("kind")).agg(F.avg("l_extendedprice").alias("v"))
    return rounded(metrics.transfer(v, ["condition"], "kind", "v", "F", "O"), "condition")


# thresholds


@query("order_stat_threshold", """WITH o AS (SELECT l_returnflag, l_extendedprice AS s, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, t.target, s AS threshold FROM o JOIN (SELECT unnest([CAST(0.98 AS DOUBLE), CAST(0.95 AS DOUBLE), CAST(0.93 AS DOUBLE)]) AS target) t ON k = greatest(1, ceil(t.target * n))""")
def order_stat_threshold(spark, sf_dir):
    return thresholds.order_statistics(R.table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.98, 0.95, 0.93], ["l_returnflag"])


@query("tau1_scan", f"""WITH {_BINARY}, g AS (SELECT CAST(score AS DOUBLE) AS s, sum(quality) AS p, sum(1 - quality) AS n FROM b GROUP BY score), w AS (SELECT s, lead(s) OVER (ORDER BY s) AS nxt, sum(p) OVER () AS tp_all, sum(n) OVER () AS n_all, sum(p) OVER (ORDER BY s) AS cp, sum(n) OVER (ORDER BY s) AS cn FROM g),
c AS (SELECT (s + nxt) / 2 AS t, tp_all - cp AS tp, n_all - cn AS fp, tp_all AS p, n_all AS n FROM w WHERE nxt IS NOT NULL UNION ALL SELECT nextafter(min(s), CAST('-inf' AS DOUBLE)), max(tp_all), max(n_all), max(tp_all), max(n_all) FROM w UNION ALL SELECT nextafter(max(s), CAST('inf' AS DOUBLE)), 0, 0, max(tp_all), max(n_all) FROM w),
f AS (SELECT t, (2.0 * tp / (tp + fp + p) + 2.0 * (n - fp) / ((n - fp) + (p - tp) + n)) / 2 AS f1 FROM c) SELECT round(t, 6) AS threshold, round((SELECT max(f1) FROM f), 6) AS macro_f1 FROM f WHERE f1 >= (SELECT max(f1) FROM f) - 1e-12 ORDER BY abs(t - 0.5), t LIMIT 1""")
def tau1_scan(spark, sf_dir):
    b = _binary(spark, sf_dir).withColumn("score", F.col("score").cast("double"))
    return rounded(thresholds.best_threshold(thresholds.presence_scan(b, "score", F.col("quality") == 1)))


@query("calibrate_compare", f"""WITH {R.ARCHIVES}, cal AS (SELECT ecc_score AS s, CAST(truth <> 'no_ecc' AS INT) AS y, energy_score, truth FROM archives WHERE archive_id % 2 = 0), g AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM cal GROUP BY s),
w AS (SELECT s, lead(s) OVER (ORDER BY s) AS nxt, sum(p) OVER () AS tp_all, sum(n) OVER () AS n_all, sum(p) OVER (ORDER BY s) AS cp, sum(n) OVER (ORDER BY s) AS cn FROM g),
c AS (SELECT (s + nxt) / 2 AS t, tp_all - cp AS tp, n_all - cn AS fp, tp_all AS p, n_all AS n FROM w WHERE nxt IS NOT NULL UNION ALL SELECT nextafter(min(s), CAST('-inf' AS DOUBLE)), max(tp_all), max(n_all), max(tp_all), max(n_all) FROM w UNION ALL SELECT nextafter(max(s), CAST('inf' AS DOUBLE)), 0, 0, max(tp_all), max(n_all) FROM w),
f AS (SELECT t, (2.0 * tp / (tp + fp + p) + 2.0 * (n - fp) / ((n - fp) + (p - tp) + n)) / 2 AS f1 FROM c), tau1 AS (SELECT t FROM f WHERE f1 >= (SELECT max(f1) FROM f) - 1e-12 ORDER BY abs(t - 0.5), t LIMIT 1),
o AS (SELECT energy_score, row_number() OVER (ORDER BY energy_score) AS k, count(*) OVER () AS n FROM cal WHERE {_K}), tau2 AS (SELECT energy_score AS e FROM o WHERE k = greatest(1, ceil(CAST(0.95 AS DOUBLE) * n)))
SELECT archive_id, truth, closed, CASE WHEN ecc_score < (SELECT t FROM tau1) THEN 'no_ecc' WHEN energy_score > (SELECT e FROM tau2) THEN 'unknown_ecc' ELSE closed END AS output FROM archives WHERE archive_id % 2 = 1""")
def calibrate_compare(spark, sf_dir):
    """Calibration on one half of the archives, decisions on the other."""
    reads = R.read_scores(spark, sf_dir)
    t = thresholds.calibrate(reads.where("archive_id % 2 = 0"), "category", F.col("presence"), scalars.energy(R.logits()))
    a = R.archives(spark, sf_dir).where("archive_id % 2 = 1")
    out = decisions.cascade(F.col("ecc_score"), F.col("energy_score"), F.col("closed"), t.presence, t.unknown_energy)
    return a.select("archive_id", "truth", "closed", out.alias("output"))


# features and distances


def _stats_sql(value: str, name: str, five: bool = True) -> str:
    qs = ((0.05, "q05"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95")) if five else ((0.05, "q05"), (0.5, "q50"), (0.95, "q95"))
    return f'round(avg({value}), 6) AS "{name}_mean", round(coalesce(stddev_samp({value}), 0), 6) AS "{name}_std", ' + ", ".join(f'round(quantile_cont({value}, {q}), 6) AS "{name}_{n}"' for q, n in qs)


@query("quantile_stats", f"SELECT l_suppkey, {_stats_sql('l_quantity', 'quantity')}, {_stats_sql('l_extendedprice', 'price')} FROM lineitem GROUP BY l_suppkey")
def quantile_stats(spark, sf_dir):
    return rounded(features.quantile_stats(R.table(spark, sf_dir, "lineitem"), {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice")}, ["l_suppkey"]), "l_suppkey")


@query("logit_features", f"""WITH {R.SCORED}, f AS (SELECT *, greatest(p0, p1, p2, p3) - list_sort([p0, p1, p2, p3])[3] AS margin FROM scored) SELECT archive_id, {", ".join(_stats_sql(f"x{i}", f"logit_{k}") for i, k in enumerate(L.KNOWN))}, {_stats_sql("energy", "energy", False)}, {_stats_sql("entropy", "softmax_entropy", False)}, {_stats_sql("margin", "top1_top2_margin", False)} FROM f GROUP BY archive_id""")
def logit_features(spark, sf_dir):
    return rounded(features.logit_features(R.read_scores(spark, sf_dir), R.logits(), ["archive_id"]), "archive_id")


@query("embedding_moments", """SELECT label, pos, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT CAST(label AS BIGINT) AS label, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label, pos""")
def embedding_moments(spark, sf_dir):
    f = features.embedding_moments(R.table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    half = F.size("features") / 2
    return f.select("label", F.posexplode(F.slice("features", F.lit(1), half.cast("int"))).alias("pos", "m"), "features").select(big("label", "label"), big("pos", "pos"), r6("m", "mean"), r6(F.element_at("features", (F.col("pos") + 1 + half).cast("int")), "std"))


def _vectors(spark, sf_dir) -> tuple[DataFrame, distances.ClassModel]:
    """Whole vectors, and the model of all labels that the table has (a few)."""
    v = R.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    labels = tuple(sorted(r["label"] for r in v.where("label is not null").select("label").distinct().collect()))
    return v, distances.fit_vectors(v, "x", "label", labels)


_DIST_SQL = """v AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT pos, avg(x) AS a, greatest(stddev_samp(x), 1e-8) AS s FROM v GROUP BY pos), z AS (SELECT vec_id, label, pos, (x - a) / s AS x FROM v JOIN m USING (pos)),
k AS (SELECT label, pos, avg(x) AS m, greatest(var_samp(x), 1e-4) AS s FROM z GROUP BY label, pos),
d AS (SELECT vec_id, z.label AS truth, k.label AS class, sqrt(sum((x - m) * (x - m) / s)) AS distance FROM z JOIN k USING (pos) GROUP BY vec_id, z.label, k.label)"""


@query("diag_mahalanobis", f"WITH {_DIST_SQL} SELECT vec_id, class, round(distance, 6) AS distance FROM d")
def diag_mahalanobis(spark, sf_dir):
    v, model = _vectors(spark, sf_dir)
    d = v.select("vec_id", F.posexplode(distances.diagonal_vectors(F.col("x"), model)).alias("pos", "distance"))
    return d.select("vec_id", F.element_at(F.array(*map(F.lit, model.labels)), F.col("pos") + 1).alias("class"), r6("distance", "distance"))


@query("min_class_score", f"WITH {_DIST_SQL} SELECT vec_id, round(min(distance), 6) AS least, round(max(distance) FILTER (WHERE class = truth), 6) AS own FROM d GROUP BY vec_id")
def min_class_score(spark, sf_dir):
    v, model = _vectors(spark, sf_dir)
    d = v.select("vec_id", F.col("label").alias("truth"), distances.diagonal_vectors(F.col("x"), model).alias("d"))
    dist = [F.element_at("d", i + 1) for i in range(len(model.labels))]
    return d.select("vec_id", r6(distances.class_score(dist, F.col("truth"), model.labels, "minimum"), "least"), r6(distances.class_score(dist, F.col("truth"), model.labels, "predicted"), "own"))


@query("full_mahalanobis")
def full_mahalanobis(spark, sf_dir):
    """Shrunk covariances of all dimensions: dense algebra, held against a plain version in the tests."""
    v, model = _vectors(spark, sf_dir)
    return v.select("vec_id", F.transform(distances.full(F.col("x"), model), lambda x: F.round(x, 6)).alias("distances"))


_OWN_SQL = f"{_DIST_SQL}, l AS (SELECT vec_id, truth AS label, class, round(distance, 9) AS d FROM d), o AS (SELECT * FROM l WHERE label = class)"


def _distances(spark, sf_dir) -> tuple[DataFrame, tuple[str, ...]]:
    """vec_id, label and the distances of whole vectors to all classes. Rounded, so that equal vectors are equally far in any order of sums."""
    v, model = _vectors(spark, sf_dir)
    return v.select("vec_id", "label", F.transform(distances.diagonal_vectors(F.col("x"), model), lambda d: F.round(d, 9)).alias("distances")), model.labels


def _own(spark, sf_dir) -> DataFrame:
    d, labels = _distances(spark, sf_dir)
    return d.select("vec_id", "label", F.element_at("distances", F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int")).alias("score"))


@query("conformal_pvalues", f"""WITH {_OWN_SQL}, c AS (SELECT * FROM o WHERE vec_id % 2 = 0), t AS (SELECT * FROM o WHERE vec_id % 2 = 1)
SELECT t.vec_id, round((1.0 + count(c.vec_id) FILTER (WHERE c.d >= t.d)) / (1 + count(c.vec_id)), 6) AS p_value FROM t LEFT JOIN c ON c.label = t.label GROUP BY t.vec_id""")
def conformal_pvalues(spark, sf_dir):
    """Of vectors' distances to their own class, in all places."""
    e = _own(spark, sf_dir)
    return conformal.p_values(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")).select("vec_id", r6("p_value", "p_value"))


@query("conformal_loo", f"""WITH {_OWN_SQL} SELECT a.vec_id, round((1.0 + count(b.vec_id) FILTER (WHERE b.d >= a.d)) / (1 + count(b.vec_id)), 6) AS p_value FROM o a LEFT JOIN o b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id""")
def conformal_loo(spark, sf_dir):
    return conformal.leave_one_out(_own(spark, sf_dir)).select("vec_id", r6("p_value", "p_value"))


_CLOSED = "n AS (SELECT vec_id, arg_min(class, d) AS closed FROM l GROUP BY vec_id) SELECT vec_id, round(-max(p), 6) AS maximum, round(-max(p) FILTER (WHERE class = closed), 6) AS predicted FROM p JOIN n USING (vec_id) GROUP BY vec_id"


@query("conformal_all", f"""WITH {_OWN_SQL}, c AS (SELECT * FROM o WHERE vec_id % 2 = 0), p AS (SELECT t.vec_id, t.class, (1.0 + count(*) FILTER (WHERE c.d >= t.d)) / (1 + count(*)) AS p FROM l t JOIN c USING (class) WHERE t.vec_id % 2 = 1 GROUP BY ALL), {_CLOSED}""")
def conformal_all(spark, sf_dir):
    """p-values of all classes, and both scores made of them."""
    e, labels = _distances(spark, sf_dir)
    p = conformal.all_classes(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "vec_id", labels)
    return _conformal_scores(p, e)


def _conformal_scores(p: DataFrame, e: DataFrame) -> DataFrame:
    closed = F.array_position("distances", F.array_min("distances")) - 1
    both = p.join(e, "vec_id")
    return both.select("vec_id", r6(conformal.rejection_score(F.col("p_values"), "maximum"), "maximum"), r6(conformal.rejection_score(F.col("p_values"), "predicted", closed), "predicted"))


@query("conformal_loo_all", f"""WITH {_OWN_SQL}, p AS (SELECT t.vec_id, t.class, (1.0 + count(*) FILTER (WHERE c.d >= t.d AND c.vec_id <> t.vec_id)) / (1 + count(*) FILTER (WHERE c.vec_id <> t.vec_id)) AS p FROM l t JOIN o c USING (class) GROUP BY ALL), {_CLOSED}""")
def conformal_loo_all(spark, sf_dir):
    e, labels = _distances(spark, sf_dir)
    return _conformal_scores(conformal.all_classes(e, e, "vec_id", labels, own="label"), e)


def embedded_reads(spark, sf_dir) -> DataFrame:
    """Vectors as reads: six archives a label, three molecules an archive; the logits are sums of a quarter of the places each."""
    quarter = [F.aggregate(F.slice("e", 16 * i + 1, 16), F.lit(0.0), lambda a, x: a + x) for i in range(4)]
    e = R.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    category = F.element_at(F.array(*map(F.lit, (*L.KNOWN, "no_ecc", "HEDGES", "DNA-Aeon"))), F.least(F.col("label"), F.lit(6)).cast("int") + 1)
    return e.select((F.col("label") * 6 + F.floor(F.col("vec_id") / 3) % 6).cast("long").alias("archive_id"), category.alias("category"), (F.col("vec_id") % 3).cast("int").alias("molecule_id"), F.array(*quarter).alias("logits"), F.col("e").alias("embedding"))


@query("detector_system")
def detector_system(spark, sf_dir):
    """The four detectors over whole vectors with 16 components, fitted on known archives of even number and calibrated on odd ones; held against a plain version in the tests."""
    reads = embedded_reads(spark, sf_dir)
    known = reads.where(L.is_known(F.col("category")))
    return rounded(detectors.score(reads, detectors.fit(known.where("archive_id % 2 = 0"), known.where("archive_id % 2 = 1"))), "archive_id")


_SCORES = "o AS (SELECT archive_id, truth, closed, unnest(['energy_only', 'proxy_only', 'three_state', 'G_all']) AS method, unnest([energy_only, proxy_only, three_state, proxy_only]) AS o, unnest([energy_score, proxy_score, proxy_score, proxy_score]) AS s FROM decided)"
_BUNDLE = f"""WITH {R.DECIDED}, {_SCORES}, l AS (SELECT unnest(['{"', '".join(L.KNOWN)}']) AS label),
f AS (SELECT method, label, 2.0 * count(*) FILTER (WHERE truth = label AND o = label) / greatest(1, 2 * count(*) FILTER (WHERE truth = label AND o = label) + count(*) FILTER (WHERE truth <> label AND o = label) + count(*) FILTER (WHERE truth = label AND o <> label)) AS f1,
  2.0 * count(*) FILTER (WHERE truth = label AND closed = label) / greatest(1, 2 * count(*) FILTER (WHERE truth = label AND closed = label) + count(*) FILTER (WHERE truth <> label AND closed = label) + count(*) FILTER (WHERE truth = label AND closed <> label)) AS base FROM l CROSS JOIN o WHERE {_K} GROUP BY method, label),
m AS (SELECT method, avg(f1) AS macro, avg(base) AS base FROM f GROUP BY method), u AS (SELECT method, archive_id, s, {_U} AS unknown FROM o WHERE {_K} OR {_U}),
r AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY s) + (count(*) OVER (PARTITION BY method, s) - 1) / 2.0 AS r, sum(CAST(unknown AS INT)) OVER w AS tp, count(*) OVER w AS n FROM u WINDOW w AS (PARTITION BY method ORDER BY s DESC, unknown, archive_id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT method, (sum(r) FILTER (WHERE unknown) - count(*) FILTER (WHERE unknown) * (count(*) FILTER (WHERE unknown) + 1) / 2.0) / (count(*) FILTER (WHERE unknown) * count(*) FILTER (WHERE NOT unknown)) AS auroc, sum(tp / n) FILTER (WHERE unknown) / count(*) FILTER (WHERE unknown) AS ap FROM r GROUP BY method),
t AS (SELECT x.method, x.s, count(*) FILTER (WHERE y.unknown AND y.s >= x.s) / count(*) FILTER (WHERE y.unknown) AS tpr, count(*) FILTER (WHERE NOT y.unknown AND y.s >= x.s) / count(*) FILTER (WHERE NOT y.unknown) AS fpr FROM (SELECT DISTINCT method, s FROM u) x JOIN u y ON x.method = y.method GROUP BY x.method, x.s),
p AS (SELECT method, coalesce(min(fpr) FILTER (WHERE tpr >= 0.95), 1) AS fpr FROM t GROUP BY method),
d AS (SELECT method, {_share_sql(f"o IN {_KNOWN}", _K)} AS known_acceptance_rate, {_share_sql("o = 'unknown_ecc'", _U)} AS combined_unknown_recall, {_share_sql("o = 'no_ecc'", "truth = 'no_ecc'")} AS no_ecc_specificity FROM o GROUP BY method)
SELECT method, known_acceptance_rate, combined_unknown_recall, no_ecc_specificity, round(macro, 6) AS known_type_macro_f1, round(macro - base, 6) AS known_type_macro_f1_change_from_closed, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision, round(fpr, 6) AS fpr_at_tpr FROM d JOIN m USING (method) JOIN a USING (method) JOIN p USING (method)"""


@query("evaluation_bundle", _BUNDLE)
def evaluation_bundle(spark, sf_dir):
    found = metrics.evaluation(R.decided(spark, sf_dir), [], "archive_id")
    return rounded(found.select("method", "known_acceptance_rate", "combined_unknown_recall", "no_ecc_specificity", "known_type_macro_f1", "known_type_macro_f1_change_from_closed", "auroc", "average_precision", "fpr_at_tpr"), "method")


@query("success_criteria", f"SELECT method, known_acceptance_rate >= 0.93 AS known_accepted, combined_unknown_recall >= 0.8 AS unknown_found, no_ecc_specificity >= 0.93 AS uncoded_kept_apart FROM ({_BUNDLE})")
def success_criteria(spark, sf_dir):
    rates = metrics.detector_rates(R.decided(spark, sf_dir).unpivot(["truth"], list(metrics.METHODS), "method", "output"), "truth", "output", ["method"])
    return metrics.success(rates).select("method", "known_accepted", "unknown_found", "uncoded_kept_apart")


@query("best_method", f"SELECT method, auroc FROM ({_BUNDLE}) ORDER BY auroc DESC, method LIMIT 1")
def best_method(spark, sf_dir):
    return metrics.best(evaluation_bundle(spark, sf_dir), "method", "auroc")


@query("peak_scores", f"WITH {R.ARCHIVES} SELECT archive_id, round(-greatest(p0, p1, p2, p3), 6) AS max_probability, round(-greatest(m0, m1, m2, m3), 6) AS max_mean_logit FROM archives")
def peak_scores(spark, sf_dir):
    found = features.peak_scores([F.col(f"p{i}") for i in range(4)], [F.col(f"m{i}") for i in range(4)])
    return R.archives(spark, sf_dir).select("archive_id", *[r6(c, n) for n, c in found.items()])


@query("author_cascade", f"WITH {R.DECIDED} SELECT archive_id, CASE WHEN energy_only IN {_KNOWN} THEN 'known_ecc' ELSE energy_only END AS status, CASE WHEN energy_only IN {_KNOWN} THEN energy_only END AS code_type, CASE WHEN energy_only IN {_KNOWN} THEN '1/' || (archive_id % 3 + 2) END AS code_rate, CASE WHEN energy_only IN {_KNOWN} THEN CAST(molecules AS VARCHAR) END AS code_length FROM decided")
def author_cascade(spark, sf_dir):
    """Type, and where it is known rate and length too."""
    d = R.decided(spark, sf_dir)
    out = decisions.with_parameters(F.col("energy_only"), F.col("energy_only"), F.concat(F.lit("1/"), (F.col("archive_id") % 3 + 2).cast("string")), F.col("molecules").cast("string"))
    return d.select("archive_id", out.alias("o")).select("archive_id", "o.*")


@query("one_hot_pad", "SELECT event_id, length(s) AS bases, least(length(s), 6) AS inside, CAST(sum(CASE WHEN i <= length(s) AND i <= 6 THEN i * (instr('ACGT', substr(s, i, 1)) - 1 + 4 * (i - 1)) ELSE 0 END) AS BIGINT) AS weighted FROM (SELECT event_id, repeat('GATC', CAST(event_id % 3 AS INT)) AS s FROM events), (SELECT unnest(range(1, 7)) AS i) GROUP BY event_id, s")
def one_hot_pad(spark, sf_dir):
    """One-hot and mask-padded reads; the sums tell where the ones are."""
    e = R.table(spark, sf_dir, "events").select("event_id", F.repeat(F.lit("GATC"), (F.col("event_id") % 3).cast("int")).alias("s"))
    flat = F.flatten(sequences.one_hot(F.col("s"), 6))
    where = F.aggregate(F.zip_with(flat, F.sequence(F.lit(0), F.lit(23)), lambda x, i: x * i * (F.floor(i / 4) + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    inside = F.aggregate(sequences.masked(F.col("s"), 6)["mask"], F.lit(0).cast("long"), lambda a, x: a + x)
    return e.select("event_id", big(F.length("s"), "bases"), big(inside, "inside"), big(where, "weighted"))


# selection

_DETECTORS = ["energy_score", "proxy_score", "m0", "m1"]


def _family(truth: Column) -> Column:
    return F.when(L.is_known(truth), "known").when(truth == "no_ecc", "uncoded").otherwise(truth)


def _candidates(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    a = storage.stored(R.archives(spark, sf_dir).select(_family(F.col("truth")).alias("family"), *_DETECTORS), "archives")  # a score at its threshold must be the same number in both looks
    known = a.where("family = 'known'").select(*_DETECTORS).unpivot([], _DETECTORS, "detector", "score")
    found = {(r["target"], r["detector"]): r["threshold"] for r in thresholds.order_statistics(known, "score", list(selection.TARGETS), ["detector"]).collect()}
    return selection.candidate_metrics(a, "family", selection.registry(_DETECTORS, ("energy_score", "m0")), found), ["HEDGES", "DNA-Aeon", "uncoded"]


def _candidates_sql() -> str:
    known = f"thr AS (SELECT d, t.target, s FROM (SELECT d, s, row_number() OVER (PARTITION BY d ORDER BY s) AS k, count(*) OVER (PARTITION BY d) AS n FROM (SELECT unnest({_DETECTORS}) AS d, unnest([{', '.join(_DETECTORS)}]) AS s FROM archives WHERE {_K})) JOIN (SELECT unnest([CAST(0.98 AS DOUBLE), 0.95, 0.93]) AS target) t ON k = greatest(1, ceil(t.target * n)))"
    parts = []
    for c in selection.registry(_DETECTORS, ("energy_score", "m0")):
        k = " + ".join(f"CAST({d} > (SELECT s FROM thr WHERE d = '{d}' AND target = {c['target']}) AS INT)" for d in c["detectors"])
        n = len(c["detectors"])
        rule = {"consensus": f"CASE WHEN k = 0 THEN 'k' WHEN k = {n} THEN 'u' ELSE '?' END", "and_reject": f"CASE WHEN k = {n} THEN 'u' ELSE 'k' END", "or_reject": "CASE WHEN k > 0 THEN 'u' ELSE 'k' END", "majority": f"CASE WHEN 2 * k < {n} THEN 'k' WHEN 2 * k > {n} THEN 'u' ELSE '?' END", "energy_only": "CASE WHEN k = 1 THEN 'u' ELSE 'k' END"}[c["logic"]]
        parts.append(f"SELECT '{c['name']}' AS candidate, family, {rule} AS state FROM (SELECT family, {k} AS k FROM fam)")
    fam = f"fam AS (SELECT *, CASE WHEN {_K} THEN 'known' WHEN truth = 'no_ecc' THEN 'uncoded' ELSE truth END AS family FROM archives)"
    return f"{R.ARCHIVES}, {known}, {fam}, cand AS (SELECT family, candidate, avg(CAST(state = 'k' AS INT)) AS known_ecc, avg(CAST(state = 'u' AS INT)) AS unknown_ecc, avg(CAST(state = '?' AS INT)) AS uncertain_ecc FROM ({' UNION ALL '.join(parts)}) GROUP BY family, candidate)"


@query("candidate_registry", f"WITH {_candidates_sql()} SELECT family, candidate, round(known_ecc, 6) AS known_ecc, round(unknown_ecc, 6) AS unknown_ecc, round(uncertain_ecc, 6) AS uncertain_ecc FROM cand")
def candidate_registry(spark, sf_dir):
    return rounded(_candidates(spark, sf_dir)[0], "family", "candidate")


_KEYS = """one AS (SELECT held_out, candidate, max(known_ecc) FILTER (WHERE family = 'known') AS a, max(uncertain_ecc) FILTER (WHERE family = 'known') AS ku, min(unknown_ecc) FILTER (WHERE family <> 'known') AS mu, min(1 - known_ecc) FILTER (WHERE family <> 'known') AS mc, max(known_ecc) FILTER (WHERE family <> 'known') AS md FROM folds GROUP BY ALL),
best AS (SELECT held_out, candidate FROM (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY (a >= 0.93 AND ku <= 0.07) DESC, mu DESC, mc DESC, md, a DESC, candidate DESC) AS k FROM one) WHERE k = 1)"""


@query("lofo_select", f"WITH {_candidates_sql()}, folds AS (SELECT h.held_out, cand.* FROM cand CROSS JOIN (SELECT unnest(['HEDGES', 'DNA-Aeon', 'uncoded']) AS held_out) h WHERE cand.family <> h.held_out), {_KEYS} SELECT held_out, candidate, round(known_ecc, 6) AS known_ecc, round(unknown_ecc, 6) AS unknown_ecc, round(uncertain_ecc, 6) AS uncertain_ecc FROM best JOIN cand USING (candidate) WHERE cand.family = best.held_out")
def lofo_select(spark, sf_dir):
    found, families = _candidates(spark, sf_dir)
    found = spark.createDataFrame(found.collect(), found.schema)  # a row per candidate and family: made once, chosen from twice
    return rounded(selection.leave_one_family_out(found, "family", families, "balanced"), "held_out", "candidate")


# sequences

_SEQ = "q AS (SELECT doc_id, lang, translate(regexp_replace(text, '[^a-zA-Z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC') AS s FROM documents)"


def _sequences(spark, sf_dir) -> DataFrame:
    """Texts as base sequences, whole."""
    s = F.translate(F.regexp_replace("text", "[^a-zA-Z]", ""), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC")
    return R.table(spark, sf_dir, "documents").select("doc_id", "lang", s.alias("s"))


#: The same letters, mapped where they are counted.
_READ_AS = structure.read_as(dict(zip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC")))


def _counted(spark, sf_dir, *keys: str) -> DataFrame:
    """Counts of the base sequences of whole texts, as _sequences makes them."""
    return structure.counted(R.table(spark, sf_dir, "documents"), "text", list(keys), table=_READ_AS)


def sequence_query(name: str, sql: str):
    def add(f):
        query(name, sql)(lambda spark, sf_dir: f(_sequences(spark, sf_dir)))
        return f

    return add


def counts_query(name: str, sql: str):
    """Of the counts of each text."""

    def add(f):
        query(name, sql)(lambda spark, sf_dir: f(_counted(spark, sf_dir, "doc_id")))
        return f

    return add


@counts_query("homopolymer", f"WITH {_SEQ}, r AS (SELECT doc_id, length(s) AS n, list_transform(regexp_extract_all(s, '(A+|C+|G+|T+)'), lambda x: length(x)) AS runs FROM q) SELECT doc_id, CAST(coalesce(list_max(runs), 0) AS BIGINT) AS longest_run, round(CASE WHEN n = 0 THEN 0 ELSE coalesce(list_sum(list_filter(runs, lambda x: x >= 3)), 0) / n END, 6) AS long_run_fraction FROM r")
def homopolymer(q):
    return q.select("doc_id", big("longest_run", "longest_run"), r6(scalars.rate_or_zero(F.col("long_bases"), F.col("length")), "long_run_fraction"))


@counts_query("dinucleotide_freq", f"WITH {_SEQ}, p AS (SELECT doc_id, unnest(regexp_extract_all(s, '..') || regexp_extract_all(substr(s, 2), '..')) AS pair, length(s) - 1 AS n FROM q) SELECT doc_id, pair, round(count(*) / max(n), 6) AS frequency FROM p GROUP BY doc_id, pair")
def dinucleotide_freq(q):
    each = F.array(*[F.struct(F.lit(p).alias("pair"), F.col(f"pair_{p}").alias("n")) for p in structure.PAIRS])
    long = q.select("doc_id", "length", F.explode(F.filter(each, lambda p: p["n"] > 0)).alias("p"))
    return long.select("doc_id", "p.pair", r6(F.col("p.n") / (F.col("length") - 1), "frequency"))


@counts_query("lag_match", f"WITH {_SEQ} SELECT doc_id, {', '.join(f'round(CASE WHEN len(l) > {k} THEN len(list_filter(list_zip(l[{k + 1}:], l[:len(l) - {k}]), lambda p: p[1] = p[2])) / (len(l) - {k}) ELSE 0 END, 6) AS lag_{k}' for k in sequences.LAGS)} FROM (SELECT doc_id, CASE WHEN s = '' THEN [] ELSE string_split(s, '') END AS l FROM q)")
def lag_match(q):
    found = structure.features(1)
    return rounded(q.select("doc_id", *[found[f"lag_{k}"].alias(f"lag_{k}") for k in sequences.LAGS]), "doc_id")


@sequence_query("seq_entropy", f"WITH {_SEQ}, f AS (SELECT doc_id, unnest(['A', 'C', 'G', 'T']) AS b, s FROM q), p AS (SELECT doc_id, b, CASE WHEN length(s) = 0 THEN 0 ELSE (length(s) - length(replace(s, b, ''))) / length(s) END AS p FROM f) SELECT doc_id, round(sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END), 6) AS entropy, round(sum(p) FILTER (WHERE b IN ('G', 'C')), 6) AS gc FROM p GROUP BY doc_id")
def seq_entropy(q):
    s = F.col("s")
    return q.select("doc_id", r6(scalars.frequency_entropy(sequences.frequencies(s)), "entropy"), r6(sequences.gc_fraction(s), "gc"))


@query("sequence_features")
def sequence_features(spark, sf_dir):
    """All 165, of whole texts; the parts have queries of their own."""
    return features.sequence_features(R.table(spark, sf_dir, "documents"), "text", ["lang"], table=_READ_AS)


@query("reference_audit", f"""WITH {_SEQ}, u AS (SELECT lang, s, count(*) AS n, CASE WHEN length(s) = 0 THEN 0 ELSE (length(s) - length(replace(replace(s, 'G', ''), 'C', ''))) / length(s) END AS g, coalesce(list_max(list_transform(regexp_extract_all(s, '(A+|C+|G+|T+)'), lambda x: length(x))), 0) AS r FROM q GROUP BY lang, s)
SELECT lang, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS "distinct", CAST(min(length(s)) AS BIGINT) AS min_length, CAST(max(length(s)) AS BIGINT) AS max_length, round(sum(g * n) / sum(n), 6) AS gc_mean, CAST(max(r) AS BIGINT) AS longest_run, CAST(sum(CASE WHEN NOT (g BETWEEN 0.3 AND 0.7) OR r > 6 THEN n ELSE 0 END) AS BIGINT) AS violations FROM u GROUP BY lang""")
def reference_audit(spark, sf_dir):
    """Whole texts have no common length, so there is no rule for it; is_legal() drops empty ones in both forms."""
    a = audit.reference_audit(_sequences(spark, sf_dir), "s", "lang", None, (0.3, 0.7), 6)
    return a.select("lang", r6("gc_mean", "gc_mean"), *[big(c, c) for c in ("n", "distinct", "min_length", "max_length", "longest_run", "violations")])


@sequence_query("sequence_digest", f"WITH {_SEQ} SELECT doc_id, sha256(unhex(array_to_string(list_transform(string_split(translate(s, 'ACGT', '0123'), ''), lambda c: '0' || c), ''))) AS digest FROM q WHERE s <> ''")
def sequence_digest(q):
    return q.where("s <> ''").select("doc_id", sequences.digest(F.col("s")).alias("digest"))


@query("stable_seed", "SELECT event_id, CAST(CAST('0x' || array_to_string(list_transform(range(8), lambda i: substr(h, 15 - 2 * i, 2)), '') AS UBIGINT) AS VARCHAR) AS seed FROM (SELECT event_id, substr(sha256(concat_ws(chr(31), 'channel', CAST(event_id AS VARCHAR), event_type)), 1, 16) AS h FROM events)")
def stable_seed(spark, sf_dir):
    return R.table(spark, sf_dir, "events").select("event_id", sequences.stable_seed(F.lit("channel"), F.col("event_id"), F.col("event_type")).cast("string").alias("seed"))


# audits


@query("fingerprint_dups", "SELECT sha256(text) AS fingerprint, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def fingerprint_dups(spark, sf_dir):
    return audit.duplicates(R.table(spark, sf_dir, "documents"), F.sha2("text", 256), "doc_id").select("fingerprint", big("n", "n"), "first")


@query("cross_split_overlap", "WITH s AS (SELECT DISTINCT md5(text) AS f, source FROM documents) SELECT a.source AS split_a, b.source AS split_b, CAST(count(*) AS BIGINT) AS shared FROM s a JOIN s b ON a.f = b.f AND a.source < b.source GROUP BY 1, 2")
def cross_split_overlap(spark, sf_dir):
    return audit.split_overlap(R.table(spark, sf_dir, "documents"), F.md5("text"), "source").select("split_a", "split_b", big("shared", "shared"))


@query("snapshot_diff", """WITH a AS (SELECT p_partkey, md5(p_name || p_brand) AS d FROM part WHERE p_partkey % 10 <> 3), b AS (SELECT p_partkey, md5(p_name || CASE WHEN p_partkey % 10 = 5 THEN 'x' ELSE p_brand END) AS d FROM part WHERE p_partkey % 10 <> 4)
SELECT p_partkey, CASE WHEN b.d IS NULL THEN 'missing' WHEN a.d IS NULL THEN 'unexpected' ELSE 'changed' END AS state FROM a FULL JOIN b USING (p_partkey) WHERE a.d IS DISTINCT FROM b.d""")
def snapshot_diff(spark, sf_dir):
    p = R.table(spark, sf_dir, "part")
    a = p.where("p_partkey % 10 <> 3").select("p_partkey", F.md5(F.concat("p_name", "p_brand")).alias("d"))
    b = p.where("p_partkey % 10 <> 4").select("p_partkey", F.md5(F.concat("p_name", F.when(F.col("p_partkey") % 10 == 5, "x").otherwise(F.col("p_brand")))).alias("d"))
    return audit.snapshot_diff(a, b, "p_partkey", "d")


@query("anti_join_resume", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_join_resume(spark, sf_dir):
    done = R.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return audit.pending(R.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("known_semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def known_semi_join(spark, sf_dir):
    kept = R.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return R.table(spark, sf_dir, "documents").select("doc_id", "source").join(kept, "doc_id", "left_semi")


@query("full_outer_allclose", """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS k, o_totalprice + (o_orderkey % 3) * 0.001 AS v FROM orders WHERE o_orderkey % 11 <> 0)
SELECT CAST(count(*) FILTER (WHERE b.v IS NULL) AS BIGINT) AS only_left, CAST(count(*) FILTER (WHERE a.v IS NULL) AS BIGINT) AS only_right, round(max(abs(a.v - b.v)), 6) AS max_difference, false AS close FROM a FULL JOIN b USING (k)""")
def full_outer_allclose(spark, sf_dir):
    o = R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    a = o.where("k % 7 <> 0")
    b = o.where("k % 11 <> 0").withColumn("v", F.col("v") + (F.col("k") % 3) * F.lit(0.001))
    return audit.aligned(a, b, "k", "v", 1e-6).select(big("only_left", "only_left"), big("only_right", "only_right"), r6("max_difference", "max_difference"), "close")


@query("stable_split", """WITH h AS (SELECT lang, doc_id, sha256(concat_ws(chr(31), 'split', '7', lang, CAST(doc_id AS VARCHAR))) AS x FROM documents), o AS (SELECT lang, doc_id, CAST('0x' || array_to_string(list_transform(range(8), lambda i: substr(x, 15 - 2 * i, 2)), '') AS UBIGINT) AS s FROM h)
SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY s, doc_id) <= count(*) OVER (PARTITION BY lang) // 2 THEN 'fit' ELSE 'calibration' END AS split FROM o""")
def stable_split(spark, sf_dir):
    d = R.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return audit.stable_halves(d, "lang", "doc_id", F.lit("split"), F.lit(7)).select("doc_id", "lang", "split")


@query("lt_xor", "SELECT l_orderkey AS droplet, CAST(count(*) AS BIGINT) AS degree, bit_xor(v) AS v FROM lineitem JOIN (SELECT p_partkey, p_partkey * 2654435761 % 1000003 AS v FROM part) ON l_partkey = p_partkey GROUP BY l_orderkey")
def lt_xor(spark, sf_dir):
    members = R.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("droplet"), F.col("l_partkey").alias("block"))
    blocks = R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("block"), F.expr("p_partkey * 2654435761 % 1000003").alias("v"))
    return audit.xor_blocks(members, blocks, "droplet", "block", "v").select("droplet", big("degree", "degree"), "v")


@query("parity_hamming", """WITH b AS (SELECT event_id, CAST(event_id AS INT) & 1 AS a, (CAST(event_id AS INT) >> 1) & 1 AS b, (CAST(event_id AS INT) >> 2) & 1 AS c, (CAST(event_id AS INT) >> 3) & 1 AS d FROM events), p AS (SELECT *, xor(xor(a, b), d) AS p1, xor(xor(a, c), d) AS p2, xor(xor(b, c), d) AS p3 FROM b)
SELECT event_id, CAST(p1 AS BIGINT) AS p1, CAST(p2 AS BIGINT) AS p2, CAST(p3 AS BIGINT) AS p3, CAST(xor(xor(xor(a, b), xor(c, d)), xor(xor(p1, p2), p3)) AS BIGINT) AS p4 FROM p""")
def parity_hamming(spark, sf_dir):
    e = R.table(spark, sf_dir, "events").select("event_id")
    bits = [F.shiftright(F.col("event_id").cast("int"), i).bitwiseAND(F.lit(1)) for i in range(4)]
    return e.select("event_id", *[big(c, f"p{i + 1}") for i, c in enumerate(sequences.hamming_parities(bits))])


# resampling

_REPETITIONS = 2000  # fixed value
_DRAW = "CAST(floor(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::UBIGINT / 4294967296.0 * {size}) AS INT)"


@query("stratified_bootstrap", f"""WITH n AS (SELECT quality, toxic, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY quality) AS size FROM labels),
d AS (SELECT quality, repetition, {_DRAW.format(parts="'7', CAST(repetition AS VARCHAR), CAST(quality AS VARCHAR), CAST(k AS VARCHAR)", size="size")} AS k FROM n CROSS JOIN (SELECT unnest(range({_REPETITIONS})) AS repetition))
SELECT CAST(d.repetition AS BIGINT) AS repetition, round(sum(n.toxic) / count(*), 6) AS toxic_rate, round(sum(n.toxic * n.quality) / sum(n.quality), 6) AS toxic_among_good FROM d JOIN n USING (quality, k) GROUP BY d.repetition""")
def stratified_bootstrap(spark, sf_dir):
    labels = R.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    one, good = F.lit(1.0), F.col("quality").cast("double")
    s = resample.stratified(labels, ["quality"], ["doc_id"], {"toxic_rate": (F.col("toxic") * one, one), "toxic_among_good": (F.col("toxic") * good, good)}, _REPETITIONS)
    return s.select(big("repetition", "repetition"), r6("toxic_rate", "toxic_rate"), r6("toxic_among_good", "toxic_among_good"))


@query("hierarchical_bootstrap", f"""WITH r AS (SELECT c_nationkey AS seed, c_mktsegment AS category, c_acctbal, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS size FROM customer),
c AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS k, count(*) OVER () AS size FROM (SELECT DISTINCT seed FROM r)), reps AS (SELECT unnest(range({_REPETITIONS})) AS repetition),
chosen AS (SELECT s.repetition, s.spot, c.seed FROM (SELECT repetition, k AS spot, {_DRAW.format(parts="'7', CAST(repetition AS VARCHAR), 'cluster', CAST(k AS VARCHAR)", size="size")} AS k FROM c CROSS JOIN reps) s JOIN c ON c.k = s.k),
d AS (SELECT r.seed, r.category, repetition, {_DRAW.format(parts="'7', CAST(repetition AS VARCHAR), CAST(spot AS VARCHAR), category, CAST(k AS VARCHAR)", size="size")} AS k FROM r JOIN chosen ON r.seed = chosen.seed),
s AS (SELECT repetition, sum(CAST(r.c_acctbal < 0 AS INT)) / count(*) AS v FROM d JOIN r USING (seed, category, k) GROUP BY repetition)
SELECT 'negative_rate' AS metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lower95, round(quantile_cont(v, 0.975), 6) AS upper95 FROM s""")
def hierarchical_bootstrap(spark, sf_dir):
    c = R.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("seed"), F.col("c_mktsegment").alias("category"), "c_acctbal")
    s = resample.hierarchical(c, "seed", ["category"], ["c_custkey"], {"negative_rate": ((F.col("c_acctbal") < 0).cast("double"), F.lit(1.0))}, _REPETITIONS)
    return rounded(resample.intervals(s, ["negative_rate"]), "metric")


@query("independent_bootstrap", f"""WITH n AS (SELECT CAST(c_acctbal < 0 AS INT) AS bad, row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () AS size FROM customer),
d AS (SELECT repetition, {_DRAW.format(parts="'7', CAST(repetition AS VARCHAR), '0', CAST(k AS VARCHAR)", size="size")} AS k FROM n CROSS JOIN (SELECT unnest(range(1000)) AS repetition)), s AS (SELECT repetition, avg(bad) AS v FROM d JOIN n USING (k) GROUP BY repetition)
SELECT 'negative_rate' AS metric, round((SELECT avg(bad) FROM n), 6) AS estimate, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM s""")
def independent_bootstrap(spark, sf_dir):
    c = R.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).cast("double").alias("bad"))
    return rounded(resample.independent(c, ["c_custkey"], {"negative_rate": (F.col("bad"), F.lit(1.0))}), "metric")


@query("macro_f1_bootstrap", f"""WITH {R.DECIDED}, r AS (SELECT archive_id % 5 AS seed, truth AS category, energy_only, closed, row_number() OVER (PARTITION BY archive_id % 5, truth ORDER BY archive_id) - 1 AS k, count(*) OVER (PARTITION BY archive_id % 5, truth) AS size FROM decided WHERE {_K}),
c AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS k, count(*) OVER () AS size FROM (SELECT DISTINCT seed FROM r)), reps AS (SELECT unnest(range({_REPETITIONS})) AS repetition),
chosen AS (SELECT s.repetition, s.spot, c.seed FROM (SELECT repetition, k AS spot, {_DRAW.format(parts="'7', CAST(repetition AS VARCHAR), 'cluster', CAST(k AS VARCHAR)", size="size")} AS k FROM c CROSS JOIN reps) s JOIN c ON c.k = s.k),
d AS (SELECT r.seed, r.category, repetition, {_DRAW.format(parts="'7', CAST(repetition AS VARCHAR), CAST(spot AS VARCHAR), category, CAST(k AS VARCHAR)", size="size")} AS k FROM r JOIN chosen ON r.seed = chosen.seed),
j AS (SELECT repetition, category, energy_only AS o, closed AS b FROM d JOIN r USING (seed, category, k)), l AS (SELECT unnest(['{"', '".join(L.KNOWN)}']) AS label),
f AS (SELECT repetition, label, 2.0 * count(*) FILTER (WHERE category = label AND o = label) / greatest(1, 2 * count(*) FILTER (WHERE category = label AND o = label) + count(*) FILTER (WHERE category <> label AND o = label) + count(*) FILTER (WHERE category = label AND o <> label)) AS f1,
  2.0 * count(*) FILTER (WHERE category = label AND b = label) / greatest(1, 2 * count(*) FILTER (WHERE category = label AND b = label) + count(*) FILTER (WHERE category <> label AND b = label) + count(*) FILTER (WHERE category = label AND b <> label)) AS base FROM j CROSS JOIN l GROUP BY repetition, label),
s AS (SELECT repetition, avg(f1) - avg(base) AS v FROM f GROUP BY repetition) SELECT 'macro_f1_change' AS metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lower95, round(quantile_cont(v, 0.975), 6) AS upper95 FROM s""")
def macro_f1_bootstrap(spark, sf_dir):
    """The change of macro-F1 from the closed set, over seeds and archives drawn with replacement."""
    d = R.decided(spark, sf_dir).where(L.is_known(F.col("truth"))).select("archive_id", (F.col("archive_id") % 5).alias("seed"), "truth", "closed", "energy_only")
    sums = {k: v for n, c in (("out", "energy_only"), ("base", "closed")) for k, v in resample.f1_sums(n, F.col("truth"), F.col(c), L.KNOWN).items()}
    drawn = resample.hierarchical_sums(d, "seed", ["truth"], ["archive_id"], sums, _REPETITIONS)
    change = resample.macro_f1_of_sums("out", L.KNOWN) - resample.macro_f1_of_sums("base", L.KNOWN)
    return rounded(resample.intervals(drawn.select("repetition", change.alias("macro_f1_change")), ["macro_f1_change"]), "metric")


# models, sources and channel


@query("proxy_scores")
def proxy_scores(spark, sf_dir):
    """A logistic score over principal components; held against a plain fit in the tests."""
    e = R.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") >= 8).cast("int").alias("anomaly"))
    return e.select("vec_id", r6(models.proxy_score("embedding", models.fit_proxy(e, "embedding", "anomaly")), "proxy_score"))


@query("distinct_types", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT text) AS BIGINT) AS distinct_texts FROM documents")
def distinct_types(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").agg(big(F.count("*"), "n"), big(F.count_distinct("text"), "distinct_texts"))


@query("degree_histogram", "SELECT degree, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(count(*) AS BIGINT) AS degree FROM lineitem GROUP BY l_orderkey) GROUP BY degree")
def degree_histogram(spark, sf_dir):
    d = R.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("degree"))
    return d.groupBy("degree").agg(big(F.count("*"), "n"))


@query("union_of_columns", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(c_custkey) AS BIGINT) AS customers, CAST(count(s_suppkey) AS BIGINT) AS suppliers FROM (SELECT c_custkey, c_name, NULL AS s_suppkey FROM customer UNION ALL SELECT NULL, s_name, s_suppkey FROM supplier)")
def union_of_columns(spark, sf_dir):
    u = delimited.union_of_columns([R.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name")), R.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))])
    return u.agg(big(F.count("*"), "n"), big(F.count("c_custkey"), "customers"), big(F.count("s_suppkey"), "suppliers"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(avg(v), 6) AS vote FROM (SELECT ts, event_type, value AS v FROM events) GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """The batch form of the streaming vote's event-time windows."""
    e = R.table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(big(F.count("*"), "n"), r6(F.avg("value"), "vote")).select(F.col("w.start").alias("start"), "event_type", "n", "vote")


_PAIRS = [a + b for a in sequences.BASES for b in sequences.BASES]


@query("composition", f"""WITH {_SEQ}, p AS (SELECT lang, pair, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(s, '..') || regexp_extract_all(substr(s, 2), '..')) AS pair FROM q) GROUP BY ALL), langs AS (SELECT DISTINCT lang FROM q), grid AS (SELECT lang, unnest({_PAIRS}) AS pair FROM langs),
d AS (SELECT lang, sum(abs(coalesce(n, 0) / t - 1 / 16)) AS pair_distance FROM grid LEFT JOIN p USING (lang, pair) JOIN (SELECT lang, sum(n) AS t FROM p GROUP BY lang) USING (lang) GROUP BY lang),
r AS (SELECT lang, CASE WHEN length(s) = 0 THEN 0 ELSE (length(s) - length(replace(replace(s, 'G', ''), 'C', ''))) / length(s) END AS g, coalesce(list_max(list_transform(regexp_extract_all(s, '(A+|C+|G+|T+)'), lambda x: length(x))), 0) AS r FROM q)
SELECT lang, round(avg(g), 6) AS gc_mean, round(stddev_pop(g), 6) AS gc_std, round(avg(r), 6) AS run_mean, round(quantile_cont(r, 0.95), 6) AS run_q95, round(max(pair_distance), 6) AS pair_distance FROM r JOIN d USING (lang) GROUP BY lang""")
def composition(spark, sf_dir):
    return rounded(audit.composition(R.table(spark, sf_dir, "documents"), "text", "lang", _READ_AS), "lang")


from lamina.plans import seeds, stores, streams  # noqa: E402, F401  register their queries
