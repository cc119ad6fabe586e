import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import language, quality

FOLDER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_grams_equal_brute_force(monkeypatch):
    for block in (1 << 20, 5):
        monkeypatch.setattr(language, "BLOCK", block)
        for text in ("Ab, c!! déf", "", "123", "a", "x" * 40, "zwölf 日本語 😀 end"):
            words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
            want = {}
            for w in words:
                p = f" {w} "
                for n in (1, 2, 3):
                    for i in range(len(p) - n + 1):
                        g = p[i : i + n]
                        if g != " ":
                            want[g] = want.get(g, 0) + 1
            # a space between words stands for the end of one and the start of the next
            keys, counts = language.grams(language.words_only(text))
            got = {}
            for k, c in zip(keys.tolist(), counts.tolist()):
                g = "".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0) if k >> s)
                got[g] = c
            assert got == want


def test_out_of_place_distance_equals_brute_force():
    profiles = {"aa": list(range(100, 140)), "bb": list(range(120, 160))}
    model = language.Profiles(profiles, 50)
    text = "any words will do here"
    top = language.ranked(*language.grams(language.words_only(text)), 50).tolist()
    model = language.Profiles(profiles | {"cc": top[::-1]}, 50)
    want = {}
    for name, own in (profiles | {"cc": top[::-1]}).items():
        want[name] = sum(abs(own.index(g) - i) if g in own else 50 for i, g in enumerate(top))
    best, second = sorted(want.values())[:2]
    assert model.predict(text) == ("cc", pytest.approx(1 - best / second))


def test_language_edges(spark):
    rows = [(i, t, la) for i, (t, la) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de")] * 20)]
    df = spark.createDataFrame([*rows, (90, None, "en"), (91, "", None), (92, "12 34 !!", "de"), (None, "the house", "en"), (93, "das haus " * 30_000, None)], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    model = language.learn(language.eligible(df))
    got = df.select("doc_id", language.language(F.col("text"), model).alias("f")).collect()
    pred = {r.doc_id: (r.f.lang_pred, r.f.score) for r in got}
    assert pred[0][0] == "en" and pred[1][0] == "de" and pred[93][0] == "de"
    assert pred[90] == pred[91] == pred[92] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in pred.values())
    kept = language.language_stage(df)
    assert kept.columns == df.columns and {90, 91, 92}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() == 42
    empty = df.limit(0)
    assert language.language_stage(empty).count() == 0
    assert language.learn(language.eligible(empty)).predict("text") == ("und", 0.0)


def test_learned_profiles_equal_plain_counts(spark, monkeypatch):
    rows = [(i, f"{'le chat et la maison' if i % 3 else 'der hund und das haus'} {'abc'[i % 2]}", "fr" if i % 3 else "de") for i in range(60)]
    df = spark.createDataFrame([*rows, (60, None, "fr"), (61, "the cat", None)], "doc_id long, text string, lang string")
    eligible = [(t, la) for i, t, la in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    model = language.learn(language.eligible(df), 25)
    assert model.languages == ["de", "fr"]
    for k, name in enumerate(model.languages):
        counts = {}
        for text in (t for t, la in eligible if la == name):
            for g, n in zip(*(x.tolist() for x in language.grams(language.words_only(text)))):
                counts[g] = counts.get(g, 0) + n
        want = sorted(counts, key=lambda g: (-counts[g], g))[:25]
        assert [int(g) for g in model.known[np.argsort(model.ranks[k, :-1], kind="stable")][:25]] == want
    monkeypatch.setattr(language, "LANGUAGES", 1)
    with pytest.raises(ValueError):
        language.learn(language.eligible(df), 25)


@tables
def test_held_out_languages(spark):
    rows = language.op6_language_id(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_prior_is_estimated():
    rng = np.random.default_rng(0)
    for prior in (0.3, 0.8):
        p = rng.normal(1, 0.3, 4000)
        u = np.concatenate([rng.normal(1, 0.3, int(4000 * prior)), rng.normal(-1, 0.3, 4000 - int(4000 * prior))])
        assert quality.estimate_prior(p, u) == pytest.approx(prior, abs=0.06)


def test_fit_finds_negatives_it_never_saw_labelled():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 0.5, (3000, 4)), rng.normal(-1, 0.5, (600, 4))
    model, prior = quality.fit(good[:800], np.vstack([good[800:], bad]))
    assert 0.7 < prior < 0.9
    assert (model.score(good) >= 0.5).mean() > 0.97 and (model.score(bad) < 0.5).mean() > 0.97


def test_risk_and_steps_equal_a_plain_version():
    """Non-negative risk: its gradient by differences, and the step back where the bracket is below zero."""
    rng = np.random.default_rng(2)
    p, u = np.hstack([rng.normal(0.5, 1, (40, 3)), np.ones((40, 1))]), np.hstack([rng.normal(-0.2, 1, (90, 3)), np.ones((90, 1))])
    loss = lambda x, w, y: np.log1p(np.exp(-y * (x @ w)))
    for prior in (0.3, 0.9):
        gradient = quality.risk_gradient(p, u, prior)
        for w in (np.zeros(4), rng.normal(0, 1, 4), np.array([3.0, 3, 3, 3]), np.array([-4.0, -4, -4, -6])):
            bracket = lambda w: loss(u, w, -1).mean() - prior * loss(p, w, -1).mean()
            risk = (lambda w: prior * loss(p, w, 1).mean() + bracket(w)) if bracket(w) >= 0 else (lambda w: -bracket(w))
            steps = np.eye(4) * 1e-6
            assert gradient(w) == pytest.approx([(risk(w + s) - risk(w - s)) / 2e-6 for s in steps], abs=1e-6)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, ""), (None, "null id"), (5, "word " * 200_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (3, None)], "doc_id long, quality int")
    scores = docs.select(quality.quality(F.col("text"), quality.learn(docs, labels)).alias("s")).collect()
    assert len(scores) == 5 and all(0 <= r.s <= 1 for r in scores)
    none = quality.learn(docs, labels.limit(0))
    assert none is None and {r.s for r in docs.select(quality.quality(F.col("text"), none).alias("s")).collect()} == {0.5}
    assert quality.quality_stage(docs.limit(0), labels).count() == 0
    assert quality.quality_stage(docs, labels.limit(0)).columns == docs.columns


@tables
def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality.op5_quality(spark, FOLDER).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93
