import hashlib
import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lamina.llm import repeats

FOLDER = "/root/testdata/sf0.01"


def plain(rows):
    """All windows in a dictionary."""
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    large = lambda i: (1, 0) if i is None else (0, i)
    for i, words in texts:
        for p in range(len(words) - 12):
            key = tuple(words[p : p + 13])
            first[key] = min(first.get(key, large(i)), large(i))
    found = []
    for i, words in texts:
        gone = set()
        for p in range(len(words) - 12):
            if first[tuple(words[p : p + 13])] < large(i):
                gone |= set(range(p, p + 13))
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone)
        found.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def made(seed):
    r = random.Random(seed)
    passages = [words(r, n) for n in (12, 13, 14, 30, 60, 200)]
    line = words(r, 20)
    rows = []
    for i in range(120):
        text = words(r, r.choice([0, 3, 12, 13, 50, 200]))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randrange(0, max(1, len(p) - 12))
            text[len(text) // 2 : len(text) // 2] = p[a : a + r.randint(12, 60)]
        if i % 3 == 0:
            text += line
        rows.append((i * 7 - 50, " ".join(text)))
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(1000, rows[5][1]), (-900, rows[6][1] + " and more")]  # copies
    rows += [(2000, "\t".join(words(r, 30)) + "\n\n" + " ".join(line)), (2001, " ".join(line).upper()), (2002, None), (2003, ""), (2004, " \x0b\x0c ")]
    rows += [(None, rows[9][1]), (None, rows[9][1]), (None, "ß " * 30), (3000, "a " * 40), (3001, "a " * 13), (3000, "x " + "a " * 20)]
    rows += [(rows[3][0], " ".join(words(r, 20) + passages[4])), (rows[3][0], " ".join(words(r, 20) + passages[4]))]
    r.shuffle(rows)
    return rows


def test_registered_query_equals_the_plain_version(spark, tmp_path):
    rows = made(1)
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, chunk int, packed string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(repeats.op12_substring_dedup(spark, str(tmp_path))) == plain(rows)


def test_edges_branch_and_paths_hold_what_stands_together(spark):
    r = random.Random(7)
    a, b, c = words(r, 40, 10**6), words(r, 40, 10**6), words(r, 40, 10**6)
    rows = [(1, " ".join(a + b)), (2, " ".join(a + c)), (3, " ".join(c + b)), (4, " ".join(a[5:] + b[:20]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    edges = repeats._edges(repeats._texts(df), 3, 0)
    paths = repeats._paths(edges).collect()
    assert sum(p.n for p in paths) == edges.count()
    assert len(paths) < 12  # runs between branches, not windows
    assert got(repeats.without_repeats(df)) == plain(rows)


def test_one_long_text_and_no_rows(spark):
    r = random.Random(3)
    long = words(r, 60000, 10**6)
    rows = [(1, " ".join(long)), (2, " ".join(long[100:40000] + ["new"] + long[:100])), (3, " ".join(words(r, 13)))]
    assert got(repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hashes_that_many_texts_have_go_to_all_chunks(spark):
    """One line in all of 300 texts, which differ else: posted once for each block."""
    r = random.Random(11)
    line = words(r, 25)
    rows = [(i, " ".join(words(r, 20, 10**6) + line + words(r, 5, 10**6))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    chunks = [x.chunk for x in repeats._posted(repeats._texts(df), 7, 0).collect()]
    assert set(chunks) == set(range(7)) and len(chunks) < 300
    assert got(repeats.without_repeats(df)) == plain(rows)


def test_least_values_and_grams():
    x = np.random.default_rng(1).integers(0, 2**63, 100).astype("u8")
    assert repeats.least(x, 9).tolist() == [min(x[i : i + 9]) for i in range(92)]
    five, windows = repeats.gram_hashes(x)
    assert len(windows) == 88 and len(five) == 96 and not len(repeats.gram_hashes(x[:12])[1])
    assert windows[7] == repeats.gram_hashes(x[7:20])[1][0] and five[80] == repeats.gram_hashes(x[80:95])[0][0]
    assert len(set(windows.tolist() + repeats.gram_hashes(np.append(x[1:], x[:1]))[1].tolist())) == 89


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_given_table_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    want = sorted(c.sql(f"select doc_id, n_words, n_removed, kept_sha256 from ({repeats.ORACLE})").fetchall(), key=repr)
    found = got(repeats.op12_substring_dedup(spark, FOLDER))
    assert found == want and sum(r[2] for r in found) > 0


def test_hashes_and_windows_are_grouped_from_sorted_rows(spark):
    """Not by aggregation in tables of objects."""
    df = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    plan = repeats._edges(repeats._texts(df), 3, 0)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.count("Sort [") == 3


def test_words_of_many_texts_at_once():
    r = random.Random(5)
    letters = ["a", "b", "ß", "日", "\x00", "\x1c", "\x85", "\xa0", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r"]
    texts = ["".join(r.choices(letters, k=r.choice([0, 1, 5, 90]))).encode() for _ in range(300)]
    texts += [b"", b" ", b"x" * 63, b"x" * 64, b"x" * 65, b"x" * 200 + b" " + b"x" * 199, b"x" * 8 + b" " + b"x" * 9, b"\xff\xfe \x00\x00 \x00", b""]
    found = repeats.Words(texts)
    hashes, again = found.hashes(0), repeats.Words(texts[::-1]).hashes(0)
    plain = [t.split() for t in texts]
    assert [found.data[a:b].tobytes() for a, b in zip(found.starts, found.ends)] == [w for x in plain for w in x]
    assert np.diff(found.bounds).tolist() == [len(x) for x in plain] and found.owners().tolist() == [i for i, x in enumerate(plain) for _ in x]
    data, at = found.spaced()
    assert data.tobytes() == b"".join(w + b" " for x in plain for w in x) and at[-1] == len(data)
    by_word = dict(zip((w for x in plain for w in x), hashes.tolist()))
    assert len(set(by_word.values())) == len(by_word)  # words of one hash are of one text
    assert [by_word[w] for x in plain[::-1] for w in x] == again.tolist()
    assert not set(by_word.values()) & set(found.hashes(1).tolist())
    _, windows, whole = found.windows(0)
    assert windows[whole].tolist() == [h for x in plain for h in repeats.gram_hashes(np.array([by_word[w] for w in x], "u8"))[1].tolist()]


def test_texts_taken_apart_at_once_do_not_share_windows(spark):
    """Results don't depend on how texts are put together, and words of two texts are no window."""
    rows = [(i, " ".join(f"w{j}" for j in range(i * 6, i * 6 + 6))) for i in range(40)] + [(99, " ".join(f"w{j}" for j in range(240)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert got(repeats.without_repeats(df)) == plain(rows) == sorted([(i, len(t.split()), 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows], key=repr)


def test_order_and_search_of_hashes():
    r = np.random.default_rng(2)
    a, b, c = r.integers(0, 300, 500).astype("u8"), r.integers(0, 3, 500), r.integers(0, 3, 500)
    order = repeats.ordered(a, b, c)
    assert list(zip(a[order], b[order], c[order])) == sorted(zip(a, b, c))
    assert not len(repeats.ordered(a[:0], b[:0]))
    wanted = np.unique(r.integers(0, 2**63, 400).astype("u8"))
    hashes = np.append(wanted[::7], r.integers(0, 2**63, 5000).astype("u8"))
    at, which = repeats.Among(wanted)(hashes)
    assert at.tolist() == np.flatnonzero(np.isin(hashes, wanted)).tolist() and (wanted[which] == hashes[at]).all()
    assert not len(repeats.Among(wanted[:0])(hashes)[0])


def test_keys_are_not_cut_by_batches():
    keys = np.sort(np.random.default_rng(4).integers(0, 20, 300))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7]), pa.array(np.arange(i, min(i + 7, 300)))], ["k", "i"]) for i in range(0, 300, 7)]
    parts = list(repeats._whole_keys(iter(batches)))
    assert np.concatenate([k for k, _ in parts]).tolist() == keys.tolist() and np.concatenate([i for _, i in parts]).tolist() == list(range(300))
    assert sum(len(np.unique(k)) for k, _ in parts) == len(np.unique(keys)) and not list(repeats._whole_keys(iter([])))
