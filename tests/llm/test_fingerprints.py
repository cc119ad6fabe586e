import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import fingerprints as f


def brute(text, k, w):
    p = np.frombuffer(text.encode("utf-32-le"), "<u4")
    grams = [int(f.gram_hashes(p[i : i + k], k)[0]) for i in range(max(1, len(text) - k + 1))] if text else []
    chosen = {}
    for i in range(max(1, len(grams) - w + 1) if grams else 0):
        window = grams[i : i + w]
        chosen[i + max(j for j, g in enumerate(window) if g == min(window))] = min(window)
    return sorted(chosen.items())


@pytest.mark.parametrize("k,w", [(12, 12), (5, 4), (3, 7), (1, 1), (8, 2)])
def test_choices_equal_brute_force(monkeypatch, k, w):
    rng = random.Random(k * w)
    for block in (1 << 20, 7, 1):
        monkeypatch.setattr(f, "BLOCK", block)
        for n in (0, 1, 2, k - 1, k, k + w - 1, k + w, 40, 150):
            text = "".join(rng.choice("abé😀") for _ in range(n))
            hashes, places = f.winnow(text, k, w)
            assert list(zip(places.tolist(), hashes.tolist())) == brute(text, k, w)


def test_shared_passages_are_found():
    rng = random.Random(1)
    letters = "abcdefghijklmnop"
    for _ in range(200):
        passage = "".join(rng.choices(letters, k=f.GRAM + f.WINDOW - 1))
        a, b = ("".join(rng.choices(letters, k=rng.randint(0, 60))) + passage + "".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(2))
        (ha, pa_), (hb, pb) = f.winnow(a), f.winnow(b)
        same = set(ha.tolist()) & set(hb.tolist())
        assert any(a[p : p + f.GRAM] in passage for h, p in zip(ha.tolist(), pa_.tolist()) if h in same)


def test_written_fingerprints_read_back():
    text = "some words and some more of them " * 30
    h, p = f.winnow(text)
    h2, p2 = f.read(f.written(h, p))
    assert (h == h2).all() and (p == p2).all() and f.written(*f.winnow("")) == ""


def test_hash_of_grams_depends_on_all_characters():
    for k in (3, 5, 12, 16):
        base = np.arange(k, dtype="u4")
        whole = f.gram_hashes(base, k)[0]
        for i in range(k):
            other = base.copy()
            other[i] += 1
            assert f.gram_hashes(other, k)[0] != whole


def test_compare_with_next(spark):
    rng = random.Random(2)
    rows = [(i * 3, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(0, 60)))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "é" * 100), (503, "é" * 100), (None, "no id"), (7000, "long words " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("clash")).withColumn("ghost", F.lit("clash")).repartition(5)
    got = {r.doc_id: r for r in f.compare_with_next(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        r, changed = got[doc_id], f.edited(text, following)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        own = f.winnow(text)
        assert r.fingerprint == f.written(*own) and r.edited_fingerprint == f.written(*f.winnow(changed))
        assert r.near_next == f.likeness(own[0], f.winnow(following)[0]) and r.near_edited == f.likeness(own[0], f.winnow(changed)[0])
    assert got[503].near_next == 1.0 and got[503].fingerprint == got[502].fingerprint
    assert f.compare_with_next(df.limit(0)).count() == 0
    one = f.compare_with_next(df.where("doc_id = 502")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (0, "c")], "doc_id long, text string").repartition(4)
    assert sorted((r.doc_id, r.n_chars) for r in f.compare_with_next(df).collect()) == [(0, 1), (1, 1), (1, 1), (1, 1)]


def test_hot_ids_are_split(spark):
    """A third of all rows under one id and a third under none: several ranges each, and the chain of next texts stays whole."""
    rows = [(i, f"text {i} " * 3) for i in range(200)] + [(77, f"hot {i}") for i in range(200)] + [(None, f"none {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt, ranges = f.in_ranges(df, 12)
    sizes = {r["range"]: r["n"] for r in dealt.where("not ghost").groupBy("range").agg(F.count("*").alias("n")).collect()}
    assert max(sizes.values()) < 120 and len(sizes) > 9 and max(sizes) < ranges
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]], r[1]))
    want = sorted((i is None, i or 0, hashlib.sha256(f.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    got = f.compare_with_next(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.edited_sha256) for r in got) == want
