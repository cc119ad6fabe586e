"""Registered queries read whole texts and whole vectors; held against plain versions."""

import hashlib
import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.plans import catalog

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = dict(zip(ALPHABET, "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC"))


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(11)
    opening = "".join(rng.choices(ALPHABET + " .", k=600))
    rows = [(1, opening + "a" * 40), (2, opening + "b" * 30 + "zz"), (3, opening + "".join(rng.choices(ALPHABET, k=3000))), (4, "short"), (5, " 12 ")]
    folder = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    return folder, {i: "".join(BASES[c] for c in t if c in BASES) for i, t in rows}

FOLDER = "/root/testdata/sf0.001"


def runs(s):
    return [len(list(g)) for _, g in itertools.groupby(s)]


def collected(spark, name, folder):
    return {r.doc_id: r for r in catalog.QUERIES[name](spark, folder).collect()}


def test_sequence_queries_read_whole_texts(spark, texts):
    folder, sequences = texts
    assert max(map(len, sequences.values())) > 3000
    run, entropy, lags, digest = (collected(spark, n, folder) for n in ("homopolymer", "seq_entropy", "lag_match", "sequence_digest"))
    pairs = {(r.doc_id, r.pair): r.frequency for r in catalog.QUERIES["dinucleotide_freq"](spark, folder).collect()}
    for i, s in sequences.items():
        n = len(s)
        assert run[i].longest_run == max(runs(s), default=0)
        assert run[i].long_run_fraction == pytest.approx(sum(x for x in runs(s) if x >= 3) / n if n else 0, abs=1e-6)
        share = [s.count(b) / n for b in "ACGT"] if n else []
        assert entropy[i].entropy == pytest.approx(-sum(p * math.log2(p) for p in share if p), abs=1e-6)
        for k in catalog.sequences.LAGS:
            assert lags[i][f"lag_{k}"] == pytest.approx(sum(a == b for a, b in zip(s, s[k:])) / (n - k) if n > k else 0, abs=1e-6)
        for p in set(map("".join, zip(s, s[1:]))):
            assert pairs[i, p] == pytest.approx(sum(a + b == p for a, b in zip(s, s[1:])) / (n - 1), abs=1e-6)
        if s:
            assert digest[i].digest == hashlib.sha256(bytes("ACGT".index(c) for c in s)).hexdigest()
    assert len({r.digest for r in digest.values()}) == 4  # equal openings, different texts


def test_sequence_summaries_read_whole_texts(spark, texts):
    folder, sequences = texts
    filled = [s for s in sequences.values() if s]
    found = catalog.QUERIES["sequence_features"](spark, folder).collect()[0]
    assert found.length_mean == pytest.approx(np.mean([len(s) / 400 for s in filled]))
    assert found.longest_run_mean == pytest.approx(np.mean([max(runs(s)) / len(s) for s in filled]))
    audited = catalog.QUERIES["reference_audit"](spark, folder).collect()[0]
    assert (audited.n, audited.distinct, audited.max_length, audited.longest_run) == (5, 5, max(map(len, filled)), max(max(runs(s)) for s in filled))
    gc = [(s.count("G") + s.count("C")) / len(s) for s in filled]
    assert audited.violations == 1 + sum(not 0.3 <= g <= 0.7 or max(runs(s)) > 6 for g, s in zip(gc, filled))
    pooled = [a + b for s in filled for a, b in zip(s, s[1:])]
    summary = catalog.QUERIES["composition"](spark, folder).collect()[0]
    assert summary.run_mean == pytest.approx(sum(max(runs(s)) for s in filled) / 5, abs=1e-6)
    assert summary.pair_distance == pytest.approx(sum(abs(pooled.count(a + b) / len(pooled) - 1 / 16) for a in "ACGT" for b in "ACGT"), abs=1e-6)


def test_distances_read_whole_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(240, 9)), np.arange(240) % 5
    x[:, 8] += 4 * label  # told apart by the last dimension alone
    x[:, 1] = x[:, 0]
    x[label == 2, 3] = 0.25  # no spread within a class: the floor
    spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x))], "vec_id long, label int, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    diagonal, full = np.empty((240, 5)), np.empty((240, 5))
    for k in range(5):
        own, gap = z[label == k], z - z[label == k].mean(axis=0)
        diagonal[:, k] = np.sqrt((gap**2 / np.maximum(own.var(axis=0, ddof=1), 1e-4)).sum(axis=1))
        n, s = len(own), np.cov(own.T, ddof=0)  # as published: rows n, dimension 9
        t2, t = np.trace(s @ s), np.trace(s)
        rho = min(1.0, ((1 - 2 / 9) * t2 + t**2) / ((n + 1 - 2 / 9) * (t2 - t**2 / 9)))
        assert 0 < rho < 1
        inverse = np.linalg.pinv((1 - rho) * s + rho * t / 9 * np.eye(9) + max(t / 9, 1) * 1e-8 * np.eye(9), hermitian=True)
        full[:, k] = np.sqrt(np.einsum("nd,de,ne->n", gap, inverse, gap))
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert all(r.distance == pytest.approx(diagonal[r.vec_id, int(r["class"])], abs=2e-6) for r in run("diag_mahalanobis"))
    assert all(r.distances == pytest.approx(full[r.vec_id], abs=2e-6) for r in run("full_mahalanobis"))
    for r in run("min_class_score"):
        assert r.least == pytest.approx(diagonal[r.vec_id].min(), abs=2e-6)
        assert r.own == pytest.approx(diagonal[r.vec_id, label[r.vec_id]], abs=2e-6)
    own = [diagonal[i, label[i]] for i in range(240)]
    for r in run("conformal_pvalues"):  # all places and labels
        others = [i for i in range(0, 240, 2) if label[i] == label[r.vec_id]]
        assert r.p_value == pytest.approx((1 + sum(own[i] >= own[r.vec_id] - 1e-9 for i in others)) / (1 + len(others)), abs=2e-6)


def test_bootstraps_draw_2000_repetitions(spark, tmp_path):
    rng = random.Random(3)
    labels = [(i, i % 2, int(rng.random() < 0.3)) for i in range(40)]
    customers = [(i, i % 3, "ab"[i % 2], rng.uniform(-1, 1)) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    rates = sorted(catalog.QUERIES["stratified_bootstrap"](spark, str(tmp_path)).collect())
    assert [r.repetition for r in rates] == list(range(2000))
    draw = lambda *parts, size: int(int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32 * size)
    strata = {q: [x for x in labels if x[1] == q] for q in (0, 1)}
    for r in rates[1500:1510]:
        drawn = [strata[q][draw(7, r.repetition, q, k, size=20)] for q in (0, 1) for k in range(20)]
        assert r.toxic_rate == pytest.approx(sum(x[2] for x in drawn) / 40, abs=1e-6)
    values = []
    for rep in range(2000):
        drawn = []
        for spot in range(3):
            seed = draw(7, rep, "cluster", spot, size=3)
            for category in "ab":
                rows = [x for x in customers if x[1] == seed and x[2] == category]
                drawn += [rows[draw(7, rep, spot, category, k, size=len(rows))][3] < 0 for k in range(len(rows))]
        values.append(np.mean(drawn))
    found = catalog.QUERIES["hierarchical_bootstrap"](spark, str(tmp_path)).collect()[0]
    assert (found["mean"], found.lower95, found.upper95) == pytest.approx((np.mean(values), *np.quantile(values, [0.025, 0.975])), abs=2e-6)


def plain_system(by, label, fit, held, count):
    """Scores of the four detectors for every archive of ``by`` (archive -> rows), from the published formulas; ``label`` is -1 where a class isn't known."""
    logits = {a: np.array([r[3] for r in by[a]]) for a in by}
    energy = {a: -(x.max(axis=1) + np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1))) for a, x in logits.items()}
    def features(a):
        x = logits[a]
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True)
        top = np.sort(p, axis=1)
        out = [v for c in x.T for v in (c.mean(), c.std(ddof=1), *np.quantile(c, [0.05, 0.25, 0.5, 0.75, 0.95]))]
        for c in (energy[a], -(p * np.log(np.maximum(p, 1e-15))).sum(axis=1), top[:, -1] - top[:, -2]):
            out += [c.mean(), c.std(ddof=1), *np.quantile(c, [0.05, 0.5, 0.95])]
        return np.array(out)

    def model(x, y):
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0, ddof=1), 1e-8)
        z = (x - mean) / scale
        return mean, scale, [(z[y == k].mean(axis=0), np.maximum(z[y == k].var(axis=0, ddof=1), 1e-4), z[y == k]) for k in range(4)]

    def diagonal(x, m):
        z = (x - m[0]) / m[1]
        return np.array([np.sqrt(((z - c) ** 2 / v).sum()) for c, v, _ in m[2]])

    def full(x, m):
        out = []
        for c, _, own in m[2]:
            d, n, s = own.shape[1], len(own), np.cov(own.T, ddof=0)
            t2, t = np.trace(s @ s), np.trace(s)
            rho = min(1.0, ((1 - 2 / d) * t2 + t**2) / ((n + 1 - 2 / d) * (t2 - t**2 / d)))
            gap = (x - m[0]) / m[1] - c
            out.append(np.sqrt(gap @ np.linalg.pinv((1 - rho) * s + (rho * t / d + max(t / d, 1) * 1e-8) * np.eye(d), hermitian=True) @ gap))
        return np.array(out)

    embedded = {a: np.array([r[4] for r in by[a]]) for a in by}
    first = np.concatenate([embedded[a] for a in fit])
    centre = first.mean(axis=0)
    axes = np.linalg.eigh(np.cov(first.T))[1][:, ::-1][:, :count]
    moments = lambda x: np.append(x.mean(axis=0), x.std(axis=0, ddof=1))
    raw, small = ({a: moments(e if kind == "raw" else (e - centre) @ axes) for a, e in embedded.items()} for kind in ("raw", "small"))
    logit = {a: features(a) for a in by}
    own = np.array([label[a] for a in fit])
    made = [model(np.array([v[a] for a in fit]), own) for v in (small, raw, logit)]
    calibration = {a: full(raw[a], made[1]) for a in held}
    scores = {}
    for a in by:
        at = full(raw[a], made[1])
        p = [(1 + sum(calibration[b][k] >= at[k] - 1e-12 for b in held if label[b] == k)) / (1 + sum(label[b] == k for b in held)) for k in range(4)]
        molecules = {}
        for r, e in zip(by[a], energy[a]):
            molecules.setdefault(r[2], []).append(e)
        scores[a] = (np.mean([np.mean(m) for m in molecules.values()]), diagonal(small[a], made[0]).min(), -max(p), diagonal(logit[a], made[2]).min())
    return scores


def test_detector_system_equals_a_plain_version(spark):
    """Energy, components, conformal values and logit features on a small set, archive by archive."""
    from lamina.functions.labels import KNOWN
    from lamina.operators import detectors

    rng, rows = np.random.default_rng(7), []
    for archive in range(48):
        k = archive % 4
        for molecule in range(2):
            for _ in range(3):
                logits = rng.normal(0, 0.6, 4) + 3 * (np.arange(4) == k)
                rows.append((archive, KNOWN[k], molecule, logits.tolist(), (rng.normal(0, 1, 5) + k).tolist()))
    schema = "archive_id long, category string, molecule_id int, logits array<double>, embedding array<double>"
    reads = spark.createDataFrame(rows, schema)
    fit, held = reads.where("archive_id < 24"), reads.where("archive_id >= 24")
    system = detectors.fit(fit, held, 2)
    got = {r.archive_id: r for r in detectors.score(held, system).collect()}
    by = {a: [r for r in rows if r[0] == a] for a in range(48)}
    want = plain_system(by, {a: a % 4 for a in by}, range(24), range(24, 48), 2)
    for a in range(24, 48):
        assert [got[a][d] for d in detectors.DETECTORS] == pytest.approx(want[a], abs=1e-6)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_registered_detector_system_equals_a_plain_version(spark):
    """All places, all labels, 16 components."""
    from lamina.functions.labels import KNOWN
    from lamina.operators import detectors

    by = {}
    for r in catalog.embedded_reads(spark, FOLDER).collect():
        by.setdefault(r.archive_id, []).append((r.archive_id, r.category, r.molecule_id, r.logits, r.embedding))
    label = {a: KNOWN.index(x[0][1]) if x[0][1] in KNOWN else -1 for a, x in by.items()}
    known = sorted(a for a in by if label[a] >= 0)
    want = plain_system(by, label, [a for a in known if a % 2 == 0], [a for a in known if a % 2], 16)
    got = {r.archive_id: r for r in catalog.QUERIES["detector_system"](spark, FOLDER).collect()}
    assert set(got) == set(want) and len(got) > 40
    for a, scores in want.items():
        assert [got[a][d] for d in detectors.DETECTORS] == pytest.approx(scores, rel=1e-5, abs=2e-5)


def plain_newton(x, y, w, ridge):
    """The published iteration on dense arrays."""
    design, at = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    penalty = ridge * np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        hessian = design.T @ ((w * p * (1 - p))[:, None] * design) + penalty + 1e-9 * np.eye(len(at))
        step = np.linalg.solve(hessian, design.T @ (w * (p - y)) + penalty @ at)
        at = at - step
        if np.linalg.norm(step) < 1e-8:
            break
    return at


def test_newton_equals_a_plain_one(spark):
    from lamina.operators import models

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(400, 6)), rng.integers(0, 2, 400)
    x[y == 1, 0] += 1.5
    w = rng.random(400) / 400
    w[:5] = 0
    rows = [(v.tolist(), int(k), float(u)) for v, k, u in zip(x, y, w)]
    df = spark.createDataFrame(rows, "x array<double>, y int, w double").unionByName(spark.createDataFrame([(None, 1, 1.0)], "x array<double>, y int, w double")).repartition(5)
    for ridge in (1e-3, 1e-2, 1.0):
        assert np.allclose(models.newton(df, ridge), plain_newton(x, y, w, ridge), rtol=0, atol=1e-8)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_registered_proxy_scores_equal_a_plain_version(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    x, y = np.array([r.embedding for r in rows], float), np.array([r.label >= 8 for r in rows], float)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    reduced = z @ np.linalg.svd(z, full_matrices=False)[2][:8].T
    at = plain_newton(reduced, y, np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()), 1e-2)
    want = dict(zip([r.vec_id for r in rows], 1 / (1 + np.exp(-(reduced @ at[:-1] + at[-1])))))
    got = {r.vec_id: r.proxy_score for r in catalog.QUERIES["proxy_scores"](spark, FOLDER).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=2e-6) for i in want)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_registered_ablations_equal_a_plain_version(spark):
    from lamina.operators.features import ABLATIONS
    from lamina.plans.seeds import LAYOUT

    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    whole, y, even = np.array([r.embedding for r in rows], float), np.array([r.label >= 8 for r in rows], float), np.array([r.vec_id % 2 == 0 for r in rows])
    got = {r.ablation: r for r in catalog.QUERIES["ablation_metrics"](spark, FOLDER).collect()}
    assert set(got) == set(ABLATIONS)
    for name, parts in ABLATIONS.items():
        x = np.concatenate([whole[:, slice(*LAYOUT[p])] for p in parts], axis=1)
        mean, scale = x[even].mean(axis=0), x[even].std(axis=0)
        z = (x - mean) / scale
        axes = np.linalg.svd(z[even], full_matrices=False)[2][:8].T
        own = y[even]
        at = plain_newton(z[even] @ axes, own, np.where(own == 1, 0.5 / own.sum(), 0.5 / (1 - own).sum()), 1e-2)
        score = 1 / (1 + np.exp(-(z @ axes @ at[:-1] + at[-1])))
        known = np.sort(score[even & (y == 0)])
        limit = known[max(1, math.ceil(0.95 * len(known))) - 1]
        a, b = score[~even & (y == 0)], score[~even & (y == 1)]
        r = got[name]
        assert (r.dimensions, r.n) == (x.shape[1], (~even).sum())
        want = limit, (a <= limit).mean(), (b > limit).mean(), (b[:, None] > a).mean()
        assert (r.threshold, r.known_acceptance, r.unknown_recall, r.auroc) == pytest.approx(want, abs=1e-5)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_registered_sequence_features_equal_a_plain_version(spark):
    """All 165 of a language's whole texts."""
    texts = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang", "text").collect():
        s = "".join(BASES[c] for c in r.text if c in BASES)
        if s:
            texts.setdefault(r.lang, []).append(s)

    def one(s):
        n, pairs = len(s), [a + b for a, b in zip(s, s[1:])]
        base, pair = [s.count(b) / n for b in "ACGT"], [pairs.count(a + b) / max(n - 1, 1) for a in "ACGT" for b in "ACGT"]
        entropy = lambda p: -sum(v * math.log2(v) for v in p if v > 0)
        lengths = [len(list(g)) for _, g in itertools.groupby(s)]
        lags = [sum(a == b for a, b in zip(s, s[k:])) / (n - k) if n > k else 0.0 for k in (1, 2, 3, 4, 6, 8, 12)]
        return [n / 400, *base, base[1] + base[2], entropy(base), *pair, entropy(pair), max(lengths) / n, sum(v for v in lengths if v >= 3) / n, *lags]

    for r in catalog.QUERIES["sequence_features"](spark, FOLDER).collect():
        x = np.array([one(s) for s in texts[r.lang]])
        want = np.stack([x.mean(axis=0), x.std(axis=0), *np.quantile(x, [0.1, 0.5, 0.9], axis=0)], 1).ravel()
        assert np.allclose(np.array(r[1:], float), want, rtol=1e-7, atol=1e-9)


def test_missing_classes_and_origins(spark):
    from pyspark.sql import functions as F

    from lamina.operators import metrics

    one = spark.createDataFrame([(1.0, 1), (2.0, 1)], "score double, y int")
    assert math.isnan(metrics.auroc(one, "score", F.col("y") == 1).first()[0])
    assert math.isnan(metrics.fpr_at_tpr(one, "score", F.col("y") == 1).first()[0])
    both = one.union(spark.createDataFrame([(0.5, 0)], "score double, y int"))
    curve = metrics.roc_curve(both, "score", F.col("y") == 1).collect()
    assert [(r.tpr, r.fpr) for r in curve if r.threshold is None] == [(0.0, 0.0)] and len(curve) == 4


def test_joins_splits_and_choices_fail_closed(spark):
    from pyspark.sql import functions as F

    from lamina.operators import audit, selection

    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, 0.5), (2, 0.7)], "k int, w double")
    assert audit.one_to_one(a, b, "k").count() == 2
    for wrong in (b.where("k = 1"), b.union(b.limit(1))):
        with pytest.raises(Exception, match="one to one"):
            audit.one_to_one(a, wrong, "k").collect()
    rows = spark.createDataFrame([(i, "p") for i in range(4)] + [(9, "q")], "id int, label string")
    with pytest.raises(Exception, match="too small"):
        audit.stable_halves(rows, "label", "id", F.lit(1)).collect()
    with pytest.raises(Exception, match="unknown"):
        audit.stable_halves(rows.where("label = 'p'"), "label", "id", F.lit(1), labels=("z",)).collect()
    chosen = spark.createDataFrame([("a", "r2"), ("b", "r1"), ("c", "r2")], "held_out string, candidate string")
    assert tuple(selection.majority_choice(chosen).first()) == ("r2", 2)


def test_tables_are_made_once_and_stored_by_category(spark, tmp_path):
    from lamina.sources import delimited

    calls = []
    make = lambda: calls.append(1) or spark.createDataFrame([(1, "p"), (2, "q")], "id int, category string")
    for _ in range(2):
        assert delimited.load_or_make(spark, f"{tmp_path}/made", make).count() == 2
    assert len(calls) == 1
    delimited.write_store(make(), f"{tmp_path}/store")
    assert spark.read.parquet(f"{tmp_path}/store/category=p").count() == 1
    delimited.write_report(make(), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 2 and len(list((tmp_path / "report").glob("*.json"))) == 1


def test_weighed_parts_equal_the_ablated_vectors(spark):
    """Short, null and negative vectors too; the parts in an order of their own."""
    from lamina.operators import features

    layout, ablations = {"a": (0, 2), "b": (2, 5), "c": (5, 6)}, {"x": ("b",), "y": ("c", "a"), "z": ("b", "c", "a")}
    rows = [(1, [3, -1, 4, 1, 5, 9]), (2, [2, 7, 1]), (3, []), (4, None), (5, [1, None, 2, 3, 4, 5])]
    df = spark.createDataFrame(rows, "k long, v array<long>")
    got = {r.k: [r[n] for n in ablations] for r in features.weighed(df, "k", "v", layout, ablations).collect()}
    for k, v in rows:
        whole = {n: None if v is None else [x for p in parts for x in v[slice(*layout[p])]] for n, parts in ablations.items()}
        assert got[k] == [None if w is None or None in w else sum(x * (i + 1) for i, x in enumerate(w)) for w in whole.values()]


def test_a_grid_holds_few_archives_at_once(spark, monkeypatch):
    """The votes don't depend on how many archives are summed side by side."""
    from lamina.operators import votes

    df = spark.range(400).selectExpr("id % 9 AS archive_id", "(id div 9) % 3 AS molecule_id", "(id div 27) % 4 AS read_index", "(id div 9) % 3 AS molecule_index", "double(id * id % 17) AS v")
    run = lambda: sorted(tuple(r) for r in votes.prefix(df, {"v": F.col("v")}, votes.grid(3, 4)).collect())
    want = run()
    assert votes.CELLS <= 1 << 18
    monkeypatch.setattr(votes, "CELLS", 24)
    assert len(want) == 9 * 12 and run() == want


def test_thresholds_and_metrics_see_the_same_scores(spark, monkeypatch):
    """Sums of another order may put a score above a threshold that it made."""
    made = []
    kept = catalog.R.archives
    monkeypatch.setattr(catalog.R, "archives", lambda *a: made.append(kept(*a).withColumn("energy_score", F.col("energy_score") + F.rand())) or made[-1])
    found, _ = catalog._candidates(spark, FOLDER)
    for r in found.where("family = 'known' AND candidate IN ('t98_energy_only', 't95_energy_only', 't93_energy_only')").collect():
        assert r.known_ecc >= int(r.candidate[1:3]) / 100
