import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import labels as L
from lamina.operators import conformal, distances, features, metrics, models, ordered, resample, selection


def binary(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, float(s), int(y)) for i, (s, y) in enumerate(zip(rng.integers(0, 30, n) / 3, rng.integers(0, 2, n)))]
    return rows, spark.createDataFrame(rows, "pos int, s double, y int").repartition(5)


def test_rank_metrics_equal_pairwise_definitions(spark):
    rows, df = binary(spark)
    s, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    p, n = s[y == 1], s[y == 0]
    positive = F.col("y") == 1
    want = (p[:, None] > n).mean() + 0.5 * (p[:, None] == n).mean()
    assert metrics.auroc(df, "s", positive).first().auroc == pytest.approx(want, abs=1e-12)
    order = np.argsort(-s, kind="stable")
    precision = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    assert metrics.average_precision(df, "s", positive, "pos").first().average_precision == pytest.approx(precision[y[order] == 1].mean(), abs=1e-12)
    want = min([(n >= t).mean() for t in np.unique(s) if (p >= t).mean() >= 0.95], default=1.0)
    assert metrics.fpr_at_tpr(df, "s", positive).first().fpr_at_tpr == pytest.approx(want, abs=1e-12)


def test_perfect_ranking_and_missing_class(spark):
    df = spark.createDataFrame([(0, 0.1, 0), (1, 0.2, 0), (2, 0.8, 1), (3, 0.9, 1)], "pos int, s double, y int")
    assert metrics.auroc(df, "s", F.col("y") == 1).first().auroc == 1.0
    assert metrics.average_precision(df, "s", F.col("y") == 1, "pos").first().average_precision == 1.0
    assert math.isnan(metrics.auroc(df.where("y = 1"), "s", F.col("y") == 1).first().auroc)


def test_running_sums_over_ranges_and_groups(spark):
    rng = np.random.default_rng(1)
    values = rng.permutation(500)
    df = spark.createDataFrame([(float(v), int(v) % 3, 1) for v in values], "v double, g int, one int")
    got = ordered.running(df, "v", ["one"], ["g"], ranges=7).collect()
    for r in got:
        own = sorted(v for v in values if v % 3 == r.g)
        assert r.cum_one == own.index(r.v) + 1 and r.total_one == len(own)
        assert r.next_value == (own[own.index(r.v) + 1] if r.v != own[-1] else None)
    down = ordered.running(df, "v", ["one"], descending=True, ranges=7).collect()
    assert all(r.cum_one == 500 - r.v for r in down)


def test_seven_class_confusion_keeps_empty_rows(spark):
    rows = [(x, x) for x in L.SEVEN if x != "uncertain_ecc"]
    m = metrics.confusion(spark.createDataFrame(rows, "t string, p string"), "t", "p", L.SEVEN).collect()
    assert len(m) == 49 and sum(r.n for r in m if r.truth == r.predicted) == 6 and sum(r.n for r in m if r.truth == "uncertain_ecc") == 0
    with pytest.raises(Exception, match="confusion"):
        metrics.confusion(spark.createDataFrame([("odd", "BCH")], "t string, p string"), "t", "p", L.SEVEN).collect()


def test_reports_by_rows_and_by_matrix(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "a")] * 2 + [("b", "b")] * 4
    df = spark.createDataFrame(rows, "t string, p string")
    one = sorted(map(tuple, metrics.classification_report(df, "t", "p", ("a", "b")).collect()))
    two = sorted(map(tuple, metrics.report_from_matrix(metrics.confusion(df, "t", "p", ("a", "b"))).collect()))
    assert one == two and one[0][3] == pytest.approx(2 / 3)


def test_predictions_outside_count_or_drop(spark):
    df = spark.createDataFrame([("BCH", "BCH"), ("BCH", "unknown_ecc")], "t string, p string")
    counted = {r.label: r.f1 for r in metrics.classification_report(df, "t", "p", L.KNOWN, outside=True).collect()}
    dropped = {r.label: r.f1 for r in metrics.classification_report(df, "t", "p", L.KNOWN, outside=False).collect()}
    assert counted["BCH"] == pytest.approx(2 / 3) and dropped["BCH"] == 1.0 and counted["LDPC"] == 0.0


def test_risk_coverage(spark):
    df = spark.createDataFrame([("known_ecc", False), ("unknown_ecc", True), ("known_ecc", True), ("uncertain_ecc", True)], "s string, u boolean")
    r = metrics.risk_coverage_states(df, "s", F.col("u")).first()
    assert (r.uncertain_rate, r.decisive_coverage) == (0.25, 0.75) and r.decisive_binary_accuracy == pytest.approx(2 / 3)


def test_conformal_values(spark):
    cal = spark.createDataFrame([("c", x) for x in (1.0, 2.0, 3.0)], "label string, score double")
    points = spark.createDataFrame([(0, "c", 0.5), (1, "c", 2.0), (2, "c", 4.0), (3, "c", 1.0)], "id int, label string, score double")
    assert [r.p_value for r in conformal.p_values(cal, points).orderBy("id").collect()] == [1.0, 0.75, 0.25, 1.0]
    assert sorted(r.p_value for r in conformal.leave_one_out(cal).collect()) == pytest.approx([1 / 3, 2 / 3, 1.0])
    with pytest.raises(Exception, match="calibration"):
        conformal.p_values(cal, spark.createDataFrame([(0, "d", 0.5)], "id int, label string, score double")).collect()


def test_distances_equal_plain_algebra(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(4 * i, 0.2, (8, 3)) for i in range(4)])
    names = ["f0", "f1", "f2"]
    df = spark.createDataFrame([(L.KNOWN[i // 8], *map(float, r)) for i, r in enumerate(x)], "category string, f0 double, f1 double, f2 double")
    model = distances.fit(df, names, "category", L.KNOWN)
    assert ((model.shrinkage >= 0) & (model.shrinkage <= 1)).all()
    got = np.array([r[0] for r in df.select(F.array(*distances.diagonal([F.col(n) for n in names], model))).collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    want = np.stack([np.sqrt((((z - z[8 * c : 8 * c + 8].mean(axis=0)) ** 2) / z[8 * c : 8 * c + 8].var(axis=0, ddof=1)).sum(axis=1)) for c in range(4)], axis=1)
    assert np.allclose(np.sort(got, axis=0), np.sort(want, axis=0))
    full = np.array([r[0] for r in df.select(distances.full(F.array(*names), model)).collect()])
    assert full.shape == (32, 4) and (full.argmin(axis=1).reshape(4, 8) == np.arange(4)[:, None]).all()


def test_logit_features(spark):
    rows = [(a, m, r, [2.0 if a == 0 and k == 0 else 0.0 for k in range(4)]) for a in range(2) for m in range(2) for r in range(3)]
    df = spark.createDataFrame(rows, "archive_id int, m int, r int, x array<double>")
    f = features.logit_features(df, [F.col("x")[i] for i in range(4)], ["archive_id"])
    assert len(f.columns) == 44
    assert all(np.isfinite(list(r)[1:]).all() for r in f.collect())


def test_feature_blocks(spark):
    df = spark.createDataFrame([(list(map(float, range(464))),)], "x array<double>")
    r = df.select(features.block("x", "sequence").alias("s"), features.block("x", "embedding").alias("e"), features.block("x", "logits", "sequence").alias("l")).first()
    assert (len(r.s), len(r.e), len(r.l)) == (165, 256, 208) and r.e[0] == 165 and r.l[0] == 421


def test_embedding_moments(spark):
    x = np.random.default_rng(3).normal(size=(12, 5))
    df = spark.createDataFrame([(i % 2, r.tolist()) for i, r in enumerate(x)], "a int, e array<double>")
    for r in features.embedding_moments(df, "e", ["a"]).collect():
        own = x[r.a :: 2]
        assert np.allclose(r.features, np.concatenate([own.mean(axis=0), own.std(axis=0)]))


def test_proxy_model_separates(spark):
    rng = np.random.default_rng(4)
    rows = [(y, rng.normal(1 if y else -1, 0.1, 8).tolist()) for y in (0, 1) for _ in range(30)]
    df = spark.createDataFrame(rows, "label int, x array<double>")
    model = models.fit_proxy(df, "x", "label", 3)
    assert np.allclose(model.components, models.fit_proxy(df, "x", "label", 3).components)
    z = (np.array([r[1] for r in rows]) - model.mean) / model.scale
    want = 1 / (1 + np.exp(-(z @ model.components.T @ model.coefficients + model.intercept)))
    got = [r[0] for r in df.select(models.proxy_score("x", model)).collect()]
    assert np.allclose(got, want) and np.mean(got[30:]) > 0.9 > 0.1 > np.mean(got[:30])


def test_selection(spark):
    names = ["e", "r", "p", "q"]
    reg = selection.registry(names, ("e", "r"))
    assert len(reg) == 36 and len({c["name"] for c in reg}) == 36
    rows = [("known", "good", 0.95, 0.05, 0.0), ("f", "good", 0.1, 0.9, 0.0), ("g", "good", 0.2, 0.8, 0.0), ("known", "eager", 0.5, 0.5, 0.0), ("f", "eager", 0.0, 1.0, 0.0), ("g", "eager", 0.0, 1.0, 0.0)]
    m = spark.createDataFrame(rows, "family string, candidate string, known_ecc double, unknown_ecc double, uncertain_ecc double")
    assert selection.select(m, "family", "balanced").first().candidate == "good"
    folds = {r.held_out: r.candidate for r in selection.leave_one_family_out(m, "family", ["f", "g"], "safety").collect()}
    assert folds == {"f": "good", "g": "good"}


def test_bootstrap_keeps_strata_and_repeats(spark):
    df = spark.createDataFrame([(i, i % 8, float(i % 2)) for i in range(16)], "id int, c int, v double")
    metric = {"m": (F.col("v"), F.lit(1.0)), "n": (F.lit(1.0), F.lit(16.0))}
    a = sorted(map(tuple, resample.stratified(df, ["c"], ["id"], metric, 20).collect()))
    assert a == sorted(map(tuple, resample.stratified(df.repartition(3), ["c"], ["id"], metric, 20).collect()))
    assert len(a) == 20
    each = {f"n{k}": (F.col("c") == k).cast("double") for k in range(8)}
    sizes = resample.stratified_sums(df, ["c"], ["id"], each, 20).collect()
    assert {r[f"n{k}"] for r in sizes for k in range(8)} == {2.0}
    h = resample.hierarchical(df.withColumn("seed", F.col("id") % 4), "seed", ["c"], ["id"], metric, 10)
    assert h.count() == 10 and resample.intervals(h, ["m"]).first().lower95 <= resample.intervals(h, ["m"]).first().upper95


def plain_draws(rows, size, prefix):
    digests = [hashlib.md5(f"{prefix}:{k}".encode()).hexdigest()[:8] for k in range(size)]
    return [rows[int(int(d, 16) / 2**32 * size)] for d in digests]


def test_packed_draws_equal_the_plain_ones(spark):
    rows = [(i, ["x", "y", None][i % 3], i % 5, None if i == 7 else float(i * i % 11)) for i in range(61)]
    df = spark.createDataFrame(rows, "id int, c string, g int, v double").repartition(4)
    got = {r.repetition: r.s for r in resample.stratified_sums(df, ["c"], ["id"], {"s": F.col("v")}, 9, seed=3).collect()}
    for r in range(9):
        want = 0.0
        for c in ("x", "y", None):
            own = [x[3] or 0.0 for x in rows if x[1] == c]
            want += sum(plain_draws(own, len(own), ":".join(["3", str(r), *([c] if c else [])])))
        assert got[r] == want
    got = {r.repetition: r.s for r in resample.hierarchical_sums(df, "g", ["c"], ["id"], {"s": F.col("v")}, 70, seed=3).collect()}
    for r in range(70):
        want = 0.0
        for spot, g in enumerate(plain_draws(list(range(5)), 5, f"3:{r}:cluster")):
            for c in ("x", "y", None):
                own = [x[3] or 0.0 for x in rows if x[1] == c and x[2] == g]
                want += sum(plain_draws(own, len(own), ":".join(["3", str(r), str(spot), *([c] if c else [])])))
        assert got[r] == want


def test_large_strata_are_drawn_by_chunks(spark):
    """Every repetition draws as many rows as there are, sums have the mean and spread of draws with replacement, and dealing doesn't matter."""
    df = spark.range(3000).selectExpr("id", "id % 2 AS c", "double(id % 10) AS v")
    sums = {"v": F.col("v"), "n0": (F.col("c") == 0).cast("double"), "n1": (F.col("c") == 1).cast("double")}
    run = lambda d: sorted(map(tuple, resample.stratified_sums(d, ["c"], ["id"], sums, 300, pack=100).collect()))
    got = run(df)
    assert got == run(df.repartition(7)) and len(got) == 300
    assert {(x[2], x[3]) for x in got} == {(1500.0, 1500.0)}
    v = np.array([x[1] for x in got])
    assert abs(v.mean() - 13500) < 4 * 155 / 300**0.5 and 0.85 < v.std() / (3000 * 8.0) ** 0.5 < 1.15  # variance 8 within each stratum
    sizes = np.array([70, 1, 200, 30, 99])
    draws = [resample.draws_in_chunk("a:b", sizes, k)[0] for k in range(5)]
    assert sum(draws) == 400 and resample.independent(df, ["id"], {"m": (F.col("v"), F.lit(1.0))}, 100, pack=100).first().estimate == 4.5


def test_ecdf_counts_ties_once(spark):
    r = np.random.default_rng(5)
    rows = [(g, float(v)) for g in ("a", "b") for v in r.integers(0, 20, 300)] + [("a", None), ("b", float("nan")), ("c", 1.0)]
    got = {(x.g, x.v): (x.n, x.cumulative) for x in ordered.ecdf(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], 5).collect()}
    for g in "abc":
        own = np.array([v for k, v in rows if k == g and v is not None and v == v])
        assert {v for k, v in got if k == g} == set(own)
        for v in set(own):
            assert got[g, v] == ((own == v).sum(), pytest.approx((own <= v).mean()))
