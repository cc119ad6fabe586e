import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import common, near_dedup
from lamina.llm import components as stars
from lamina.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2)) if len(words) > 2 else frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                p, q = sorted((top(i), top(j)))
                root[q] = p
    return {i: (len(s), top(i), top(i) == i) for i, s in sets}


def corpus(seed, families=12, members=8, passage=True):
    """Families of ever more distant copies, a passage that half of all documents share, and repeated and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)] + ["Ünï", "É"]
    common = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.choice([8, 30, 120, 300]))
        for _ in range(rng.randint(1, members)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 18))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            text = rng.choice([" ", "\n", "  \t"]).join(copy)
            texts.append(text.upper() if rng.random() < 0.3 else text)
        if passage and rng.random() < 0.5:
            texts.append(" ".join(rng.choices(vocabulary, k=40)) + " " + common)
    texts += ["", None, "  \n ", "one", "One", "two words", "two  words", "a b c d e f g", "a b c d e f h", "x " * 5000, "x " * 5001, " lead and trail ", "lead and trail"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("digest", F.lit(1)).repartition(3)
    out = near_dedup.near_duplicates(df).collect()
    assert len(out) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("limit,frequent,hot", [(1000, 3, 1000), (3, 10**9, 2), (2, 3, 1)])
def test_large_groups_are_split_and_stood_for(spark, monkeypatch, limit, frequent, hot):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 5)
    monkeypatch.setattr(near_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(near_dedup, "LIST", limit)
    monkeypatch.setattr(near_dedup.common, "HOT_ROWS", hot)
    rows = corpus(3, families=3, members=40)
    assert result(spark, rows) == brute(rows)


def test_pure_parts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, 30).astype("u8")) for _ in range(25)]
    nodes = np.arange(100, 125)
    edges, rest = near_dedup.block_links(nodes, sets, None)
    root = {int(n): int(n) for n in nodes}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        i = np.intersect1d(sets[a - 100], sets[b - 100]).size
        assert 100 * i >= 85 * (len(sets[a - 100]) + len(sets[b - 100]) - i)
        root[max(top(a), top(b))] = min(top(a), top(b))
    for i in range(25):
        for j in range(i):
            n = np.intersect1d(sets[i], sets[j]).size
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                assert top(100 + i) == top(100 + j)


def test_lists_are_read_in_parts(spark, monkeypatch):
    """However a list falls into batches, what agrees on enough places is tied, or left open on both sides but for what the first class settles."""
    rng = np.random.default_rng(1)
    monkeypatch.setattr(near_dedup, "LIST", 6)
    threshold = near_dedup.OP9
    like, settled = threshold.like
    rows, shown = [], {}
    for value, n in enumerate([1, 2, 3, 30, 1, 14, 2, 40]):
        base = rng.integers(0, 256, near_dedup.COORDINATES).astype("u1")
        for _ in range(n):
            own = base.copy()
            own[: rng.choice([0, 10, 30, 90])] = rng.integers(0, 256)
            shown[len(rows)] = own
            rows.append((value, len(rows), own.tobytes()))
    lists = spark.createDataFrame(rows, "value long, node long, places binary").coalesce(1)
    for batch in (1, 4, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        for last in (False, True):
            found = near_dedup.ties(lists, threshold, last).collect()
            open_ = {r.a for r in found if r.b is None}
            assert not (last and open_)
            root = {i: i for i in shown}

            def top(i):
                while root[i] != i:
                    i = root[i]
                return i

            for r in found:
                if r.b is not None:
                    assert (shown[r.a] == shown[r.b]).sum() >= like
                    root[top(r.a)] = top(r.b)
            for i, (v, _, _) in enumerate(rows):
                for j in range(i):
                    if rows[j][0] == v and (shown[i] == shown[j]).sum() >= threshold.matches:
                        assert top(i) == top(j) or {i, j} <= open_
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_posted_places_meet():
    """Sets at the threshold share a posted pair, even if a passage that all documents have leaves few places rare."""
    rng = np.random.default_rng(2)
    threshold, missed = near_dedup.OP9, 0
    for boilerplate in (0, 300, 600):
        common = rng.integers(1, 2**62, boilerplate).astype("u8")
        frequent = set(near_dedup.pairs(near_dedup.signature(np.unique(common))[None])[0].tolist()) if boilerplate else set()
        for _ in range(60):
            shared, a, b = (rng.integers(1, 2**62, n).astype("u8") for n in (1000 - boilerplate, 88, 88))
            both = []
            for extra in (a, b):
                minima = near_dedup.signature(np.unique(np.concatenate([common, shared, extra])))
                values = near_dedup.pairs(minima[None])[0]
                rare = np.array([v not in frequent for v in values.tolist()])
                assert rare.sum() >= threshold.rare
                both.append((minima, set(values[rare][: int(threshold.posted(rare.sum()))].tolist())))
            assert (near_dedup.places(both[0][0]) == near_dedup.places(both[1][0])).sum() >= threshold.matches
            missed += not both[0][1] & both[1][1]
    assert missed == 0


def test_shared_passages_and_large_families_at_size(spark):
    """Recall against exact links where six words of ten are in most documents, and families of near copies stand among them."""
    rng = np.random.default_rng(3)
    common, rows, planted = [f"c{i}" for i in range(90)], [], []
    for family in range(700):
        own = [f"f{family}x{i}" for i in range(60)]
        for copy in range(40 if family == 0 else int(rng.integers(1, 3))):
            words = list(own)
            words[int(rng.integers(0, 60))] = f"y{family}c{copy}"
            rows.append((len(rows), " ".join(common + words)))
            planted.append(family)
    want = brute(rows)
    got = result(spark, rows)
    assert len({c for _, c, _ in want.values()}) > 600
    assert np.mean([got[i] == want[i] for i in want]) >= 0.99


def test_unlike_sets_of_a_block_are_not_compared():
    """Sets that share seven shingles of ten, none linked: the index of rare shingles leaves no pairs."""
    rng = np.random.default_rng(4)
    common = rng.integers(1, 2**62, 700).astype("u8")
    sets = [np.unique(np.concatenate([common, rng.integers(1, 2**62, 300).astype("u8")])) for _ in range(600)]
    edges, rest = near_dedup.block_links(np.arange(600), sets, 0)
    assert edges == [] and len(rest) == 599


def test_stage_keeps_one_of_each_group(spark):
    text = "the same words stand here again and again in many rows of a table " * 3
    rows = [(3, text, "a"), (1, text, "b"), (1, text, "c"), (7, "something else altogether in this one", "d"), (8, None, "e"), (None, "no id here at all", "f"), (None, "nor does this one have any", "h"), (None, "no id here at all", "i"), (9, "", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = near_dedup.near_dedup_stage(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "7", "8", "9", "None", "None"]
    assert near_dedup.near_dedup_stage(df.limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(5)
    for n, m in ((1, 0), (40, 30), (60, 200)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 140)]
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        root = {}
        for a, b in edges:
            root.setdefault(a, a), root.setdefault(b, b)
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                low = min(root[a], root[b])
                changed |= root[a] != low or root[b] != low
                root[a] = root[b] = low
        touched = {x for a, b in edges if a != b for x in (a, b)}
        assert got == {k: v for k, v in root.items() if k in touched}


def test_components_leave_no_files_of_earlier_rounds(spark):
    """Of all rounds one table stays, and no shuffle files: on many partitions these took more disk than the data."""
    folder = common.checkpoint_folder(spark).removeprefix("file:")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    def folders():
        return {os.path.join(d, x) for d, names, _ in os.walk(folder) for x in names if not x.startswith("_")}

    shuffles, tables = files(), folders()
    found = components(spark.range(0, 3000).selectExpr("id as a", "id + 1 as b").repartition(4))
    deadline = time.time() + 20
    while files() - shuffles and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - shuffles
    assert len(folders() - tables) == 1
    assert [tuple(r) for r in found.groupBy("component").count().collect()] == [(0, 3001)]


def test_stars_connect_the_same_nodes_in_slices(monkeypatch):
    rng = np.random.default_rng(2)

    def reached(a, b):
        least = {x: x for x in [*a, *b]}
        while any(least[x] != least[y] for x, y in zip(a, b)):
            for x, y in zip(a, b):
                least[x] = least[y] = min(least[x], least[y])
        return least

    for slice_, hub in ((1000, False), (1, True), (7, False), (7, True)):
        monkeypatch.setattr(stars, "SLICE", slice_)
        a, b = np.sort(rng.integers(-300, 300, (2, 400)), axis=0)[::-1]
        a, b = np.append(a, np.full(50, 900)), np.append(b, rng.integers(-300, 300, 50)) if hub else np.append(b, np.full(50, 850))
        a, b = a[a > b], b[a > b]
        order = np.argsort(a, kind="stable")
        rows = near_dedup.pa.RecordBatch.from_arrays([near_dedup.pa.array(a[order]), near_dedup.pa.array(b[order])], ["a", "b"])
        got = near_dedup.pa.Table.from_batches(stars._stars(rows.slice(i, 5) for i in range(0, len(a), 5)))
        ends = got.column("a").to_pylist(), got.column("b").to_pylist()
        want = reached(a.tolist(), b.tolist())
        assert all(x > y for x, y in zip(*ends)) and reached(*ends) == want
        x, y = stars.star(a, b)
        assert dict(zip(x.tolist(), y.tolist())) == {k: v for k, v in want.items() if k != v}


def test_stage_links_from_80_percent_of_five_words(spark):
    words = [f"w{i}" for i in range(1200)]
    other = [f"x{i}" for i in range(1260)]
    rows = [(1, " ".join(words[:1000])), (2, " ".join(words)), (3, " ".join(other[:1000])), (4, " ".join(other)), (5, " ".join(words[:1000] + other[:250]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.near_dedup_stage(df).collect()) == [1, 3, 4, 5]  # 996 of 1196 are enough, 996 of 1256 are not
    assert sorted(r.doc_id for r in near_dedup.near_duplicates(df).where("kept").collect()) == [1, 2, 3, 4, 5]


def test_stage_threshold_equals_brute_force(spark):
    rows = [(i, t) for i, t in corpus(4) if t]
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)}))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, near_dedup.STAGE_WORDS, near_dedup.STAGE).collect()}
    want = {}
    adjacent = {i: [j for j in sets if i == j or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in sets}
    for i in sorted(sets):
        reached, todo = {i}, [i]
        while todo:
            new = set(adjacent[todo.pop()]) - reached
            reached |= new
            todo += new
        want[i] = min(reached)
    assert got == want


def test_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    shared = near_dedup.pa.table({"node": [1, 1, 2, 3], "shingles": [s.tobytes() for s in near_dedup.shingle_sets(near_dedup.pa.array([a, b, b + " more", a + " more"]))], "hub": [1] * 4})
    assert {frozenset(x) for x in zip(*near_dedup._block(shared, False).to_pydict().values()) if x[1] is not None and x[0] != x[1]} == {frozenset((1, 2)), frozenset((1, 3))}
    rows = [(0, b + " more"), (1, a), (1, b), (1, a), (2, a + " more"), (4, c), (4, c + " more")]
    out = near_dedup.near_dedup_stage(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = [r.text for r in out.collect()]
    assert len(kept) == 3 and sorted(t[0] for t in kept) == ["a", "b", "c"]
