import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import labels as L
from lamina.functions import scalars
from lamina.operators import decisions, thresholds, votes
from lamina.plans import catalog, pipelines

READ = "archive_id string, category string, molecule_index int, read_index int, presence double, logits array<double>"


def archive(name, category, presence, logits, molecules=2, reads=3):
    return [(name, category, m, r, presence, logits) for m in range(molecules) for r in range(reads)]


def hot(i, value=5.0):
    return [value if i == k else 0.0 for k in range(4)]


def test_vote_is_a_mean_of_means(spark):
    cube = np.arange(24.0).reshape(2, 3, 4)
    rows = [(m, r, cube[m, r].tolist()) for m in range(2) for r in range(3)]
    df = spark.createDataFrame(rows, "molecule_id int, read_id int, v array<double>").withColumn("archive_id", F.lit("a"))
    got = votes.two_level(df, {f"v{i}": F.col("v")[i] for i in range(4)}).first()
    assert [got[f"v{i}"] for i in range(4)] == cube.mean(axis=1).mean(axis=0).tolist()


def test_ragged_molecules_weigh_alike_and_partials_agree(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 2.0), ("a", 1, 10.0)], "archive_id string, molecule_id int, v double")
    assert votes.two_level(df, {"v": F.col("v")}).first().v == 5.75
    parts = votes.partial(df.limit(1), {"v": F.col("v")}).unionByName(votes.partial(df.exceptAll(df.limit(1)), {"v": F.col("v")}))
    assert votes.merge(parts, ["v"]).first().v == 5.75


def test_prefix_vote_equals_an_explicit_mean(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 5, 7))
    rows = [(str(a), m, m, q, float(x[a, m, q])) for a in range(3) for m in range(5) for q in range(7)]
    df = spark.createDataFrame(rows, "archive_id string, molecule_id int, molecule_index int, read_index int, v double")
    got = {(r.archive_id, r.m, r.q): r.v for r in votes.prefix(df, {"v": F.col("v")}, [(2, 3), (5, 7)]).collect()}
    for a in range(3):
        assert got[str(a), 2, 3] == pytest.approx(x[a, :2, :3].mean())
        assert got[str(a), 5, 7] == pytest.approx(x[a].mean())


def test_prefix_vote_on_a_threshold_passes_in_any_order_of_molecules(spark):
    x = [26, 15, 38, 36, 53, 13, 59, 3, 42, 35, 49, 55, 58, 13, 30, 57, 35, 43, 29, 31]  # 36 on average; added one by one as hundredths they end just below 0.36
    orders = [x, x[::-1], sorted(x), sorted(x, reverse=True), *[np.random.default_rng(i).permutation(x).tolist() for i in range(20)]]
    assert np.cumsum([n / 100 for n in x])[-1] / 20 < 0.36
    rows = [(a, m, 0, n / 100) for a, order in enumerate(orders) for m, n in enumerate(order)] + [(-1, m, 0, v) for m, v in enumerate((1.0, float("inf"), 2.0))]
    df = spark.createDataFrame(rows, "archive_id long, molecule_index int, read_index int, v double")
    got = {(r.archive_id, r.m): r.v for r in votes.prefix(df, {"v": F.col("v")}, [(20, 1), (1, 1)], molecule="molecule_index").collect()}
    assert [got[a, 20] for a in range(len(orders))] == [0.36] * len(orders)
    assert got[-1, 20] == float("inf") and got[-1, 1] == 1.0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_prefix_records_round_up_what_lies_half_way(spark, tmp_path):
    """The mean of this archive's largest logit is 5.551297499, which with the nudge of 1e-9 is half-way between two numbers of six places."""
    spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").where("l_suppkey = 44").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = catalog.QUERIES["prefix_records"](spark, str(tmp_path)).where("M = 20 and q = 20").collect()
    assert [r.max_logit for r in rows] == [5.551298]


def test_scalar_scores(spark):
    x = np.array([[0.0, 0, 0, 0], [1000, 0, -1000, 5], [1, 2, 3, 3]])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    c = scalars.elements("x", 4)
    got = df.select(F.array(*scalars.softmax(c)).alias("p"), scalars.energy(c).alias("e"), scalars.margin(c).alias("m"), scalars.argmax(c, L.KNOWN).alias("k"), scalars.stable_sigmoid(c[1]).alias("s")).collect()
    e = np.exp(x - x.max(axis=1, keepdims=True))
    assert np.allclose([r.p for r in got], e / e.sum(axis=1, keepdims=True))
    assert np.allclose([r.e for r in got], -(x.max(axis=1) + np.log(e.sum(axis=1))))
    assert [r.m for r in got] == [0, 995, 0] and [r.k for r in got] == ["BCH", "BCH", "LDPC"]
    with pytest.raises(ValueError):
        scalars.energy(c, 0)


def test_cascade_is_strict_and_ignores_nan(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.4, 9.0), (0.5, 1.1), (0.9, float("nan"))], "ecc double, e double")
    out = [r[0] for r in df.select(decisions.cascade(F.col("ecc"), F.col("e"), F.lit("LDPC"), 0.5, 1.0)).collect()]
    assert out == ["LDPC", "no_ecc", "unknown_ecc", "LDPC"]


def test_combination_rules(spark):
    df = spark.createDataFrame([(False, False), (True, True), (True, False)], "a boolean, b boolean")
    r = [F.col("a"), F.col("b")]
    got = {logic: [x[0] for x in df.select(decisions.combined(r, logic)).collect()] for logic in ("consensus", "and_reject", "or_reject", "majority")}
    k, u, q = "known_ecc", "unknown_ecc", "uncertain_ecc"
    assert got == {"consensus": [k, u, q], "and_reject": [k, u, k], "or_reject": [k, u, u], "majority": [k, u, q]}
    with pytest.raises(ValueError):
        decisions.combined(r, "energy_only")
    with pytest.raises(ValueError):
        decisions.combined([], "majority")


def test_frozen_methods(spark):
    df = spark.createDataFrame([(0.1, 9.0, 9.0), (0.9, 0.0, 0.0), (0.9, 9.0, 0.0), (0.9, 9.0, 9.0)], "ecc double, e double, p double")
    out = decisions.frozen(F.col("ecc"), F.col("e"), F.col("p"), F.lit("BCH"), 0.5, 1.0, 1.0)
    got = df.select(*[c.alias(n) for n, c in out.items()]).collect()
    assert [r.three_state for r in got] == ["no_ecc", "BCH", "uncertain_ecc", "unknown_ecc"]
    assert [r.energy_only for r in got] == ["no_ecc", "BCH", "unknown_ecc", "unknown_ecc"]
    assert [r.G_all for r in got] == [r.proxy_only for r in got] == ["no_ecc", "BCH", "BCH", "unknown_ecc"]


def test_calibrate_and_compare(spark):
    known = [row for i, k in enumerate(L.KNOWN) for row in archive(f"k{i}", k, 0.9, hot(i))]
    uncoded = archive("n0", "NoECC-Random", 0.1, hot(0)) + archive("n1", "NoECC-Constrained", 0.2, hot(1))
    t = pipelines.calibrate(spark.createDataFrame(known + uncoded, READ))
    assert 0.2 < t.presence < 0.9
    with_families = known + uncoded + archive("h", "HEDGES", 0.9, hot(0, 0.0)) + archive("d", "DNA-Aeon", 0.9, hot(0, 0.0))
    assert pipelines.calibrate(spark.createDataFrame(with_families, READ)).unknown_energy == t.unknown_energy
    with pytest.raises(Exception, match="kept for tests"):
        pipelines.calibrate(spark.createDataFrame(known + uncoded + archive("f", "Fountain", 0.9, hot(0)), READ))
    test = known + uncoded + archive("f", "Fountain", 0.9, hot(0, 0.0))
    compared = pipelines.compare(spark.createDataFrame(test, READ), t)
    s = {r.method: r for r in pipelines.summary(compared).collect()}
    assert s["closed_output"].no_ecc_false_known_rate == 1.0 and s["cascade_output"].no_ecc_false_known_rate == 0.0
    assert s["cascade_output"].macro_f1 == 1.0 and s["cascade_output"].unknown_recall == 1.0 and s["cascade_output"].no_ecc_specificity == 1.0


def test_thresholds(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(20)], "s double, g int")
    got = {r.target: r.threshold for r in thresholds.order_statistics(df, "s", [0.95, 1.0, 0.01]).collect()}
    assert got == {0.95: 18.0, 1.0: 19.0, 0.01: 0.0}
    scan = thresholds.presence_scan(spark.createDataFrame([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)], "s double, y int"), "s", F.col("y") == 1)
    best = thresholds.best_threshold(scan).first()
    assert best.threshold == 0.5 and best.macro_f1 == 1.0
    with pytest.raises(ValueError):
        thresholds.presence_scan(spark.createDataFrame([(0.1, 1)], "s double, y int"), "s", F.col("y") == 1)


def test_labels_outside_the_domain_fail(spark):
    with pytest.raises(Exception, match="outside the domains"):
        spark.createDataFrame([("odd",)], "t string").select(L.collapsed(F.col("t"))).collect()


def test_lazy_gate_limits_the_model(spark, tmp_path):
    rows = archive("a", "BCH", 0.9, hot(0)) + archive("b", "NoECC-Random", 0.1, hot(0))
    reads = spark.createDataFrame([(r[0], r[2], r[3], r[4]) for r in rows], "archive_id string, molecule_id int, read_index int, p double")
    seen = pipelines.two_phase(reads, lambda d: d.withColumn("presence", F.col("p")), lambda d: d, 0.5, str(tmp_path / "gate"))
    assert {r.archive_id for r in seen.collect()} == {"a"}
