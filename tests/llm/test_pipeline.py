import os

import pytest

import corpus_pipeline
from lamina.llm import common

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages_take_effect_and_run_composes_them(spark, tmp_path):
    docs = common.documents(spark, FOLDER)
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= before
        before = docs.count()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = docs.select("doc_id")
    all_docs = common.documents(spark, FOLDER)
    assert all_docs.join(labels.where("quality = 1"), "doc_id", "left_semi").join(kept, "doc_id", "left_anti").count() < 0.2 * before
    assert docs.where("text rlike '(?i)token *= *\"[0-9a-f]{40}'").count() == 0
    pieces = corpus_pipeline.run(spark, FOLDER)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_entry_registers_everything():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {n.split("_")[0] + "_" for n in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "near_duplicates", "secret_scan", "packing"]


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    """The whole pipeline over null texts and ids, repeated rows and no rows at all."""
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    good = "A plain sentence of ordinary words stands here, and another one follows it. " * 6
    rows = [(i, f"{good} Number {i} has words of its own: {'word' * (i % 5)} {i * 7919}.", "en", "s", 1) for i in range(30)]
    rows += [(3, rows[3][1], "en", "s", 1), (None, good, "en", None, None), (40, None, None, None, None), (41, "", "en", "s", 0)]
    for name, table in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(table, docs).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(0, 30, 2)] if table else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        pieces = corpus_pipeline.run(spark, folder).collect()
        assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(pieces[0].asDict() if pieces else {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"})
        assert bool(pieces) == bool(table) and not {40, 41} & {p.doc_id for p in pieces}
        assert len({(p.doc_id, p.start) for p in pieces}) == len(pieces)
