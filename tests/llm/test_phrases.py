import os
import random
import re
import time
from collections import Counter

import duckdb
import pytest

from lamina.llm import phrases

FOLDER = "/root/testdata/sf0.01"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, longest=5, top=2000):
    """Every phrase counted in one dictionary."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    frequent = {p: c for p, c in f.items() if c >= least and len(p) > 2}
    found = {}
    for (lang, *ws), a in frequent.items():
        if any(q[0] == lang and len(q) > len(ws) + 1 and c * 100 >= 100 * a and any(list(q[1 + i : 1 + i + len(ws)]) == ws for i in range(len(q) - len(ws))) for q, c in frequent.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, *ws[:k]] * f[lang, *ws[k:]]), k, f[lang, *ws[:k]], f[lang, *ws[k:]]) for k in range(1, len(ws)))
        found.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in found.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def made(seed, n=150):
    r = random.Random(seed)
    fixed = ["new york city", "a b c d e f", "So It Goes", "über Straße", "the the the the"]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(r.randint(0, 25)):
            text += r.choice(fixed) if r.random() < 0.4 else r.choice(["x", "y", "THE", "of", "\x0bz", "q\x00", "É"])
            text += r.choice([" ", " ", " ", "\t", ". ", ",", "\r\n", "  ", "? "])
        rows.append((i, text, r.choice(["en", "en", "de", None, "und"])))
    return rows + [(900, None, "en"), (901, "", "fr"), (902, " \n.", None), (5, rows[5][1], rows[5][2]), (None, "new york city " * 30, "en"), (None, "new york city " * 30, "en")]


def test_equals_the_plain_version(spark):
    rows = made(1)
    df = spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, lang string, word string, segment int").repartition(3)
    for least, longest, top in ((12, 5, 2000), (30, 3, 4)):
        want = plain([(x[2], x[1]) for x in rows], least, longest, top)
        assert want and got(phrases.collocations(df, least, longest, top)) == want


def test_registered_query_equals_the_plain_version(spark, tmp_path):
    rows = made(2, 500)
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = plain([(x[2], x[1]) for x in rows], 100)
    assert want and got(phrases.op11_phrases(spark, str(tmp_path))) == want


def test_lists_are_deleted_when_they_are_used_up(spark, tmp_path):
    from lamina.llm import common

    folder = common.checkpoint_folder(spark).removeprefix("file://")
    there = set(os.listdir(folder))
    df = spark.createDataFrame(made(3, 40), "doc_id long, text string, lang string")
    assert phrases.collocations(df, 5).count() > 0
    assert not [x for x in set(os.listdir(folder)) - there if x.startswith(("phrases-lists", "phrases-words"))]


def test_shuffles_of_written_tables_are_deleted(spark):
    from lamina.llm import common

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles().mkString("\n").split("\n")
        return {f for f in files if "/shuffle_" in f}

    there, before = shuffled(), spark.conf.get(common._CLEANUP, None)
    df = common.written(spark.range(1000).repartition(3, "id"), "shuffle-test")
    until = time.time() + 20
    while shuffled() - there and time.time() < until:  # executors are told without waiting for them
        time.sleep(0.1)
    assert not shuffled() - there and df.count() == 1000
    assert spark.conf.get(common._CLEANUP, None) == before


def test_large_numbers_are_exact(spark):
    """Products that pass 64 bits: the score's own expression on made frequencies is held by integers."""
    a, n, l, r = 3 * 10**12 + 7, 9 * 10**15 + 1, 4 * 10**12 + 3, 5 * 10**12 + 9
    value = spark.sql(f"select (cast(1000 * {a}L as decimal(20, 0)) * cast({n}L as decimal(17, 0))) div (cast({l}L as decimal(18, 0)) * cast({r}L as decimal(18, 0)))").first()[0]
    assert value == 1000 * a * n // (l * r)


def test_no_rows_and_nothing_frequent(spark):
    schema = "doc_id long, text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], schema)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "a b c", "en")], schema)).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_given_table_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    want = sorted(c.sql(f"select {', '.join(COLUMNS)} from ({phrases.oracle()})").fetchall())
    assert want and got(phrases.op11_phrases(spark, FOLDER)) == want
