import gzip
import json
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina import cli
from lamina.functions import codes, sequences
from lamina.operators import audit, features
from lamina.sources import delimited, fasta, files, logits, simulate
from lamina.streaming import votes as streaming


def read_features(s, padded):
    """A plain version of the 33 features."""
    n, counts = len(s), [s.count(b) for b in "ACGT"]
    base = [c / n for c in counts]
    pairs = [sum(s[i : i + 2] == a + b for i in range(n - 1)) / max(1, n - 1) for a in "ACGT" for b in "ACGT"]
    entropy = lambda p: -sum(x * np.log2(x) for x in p if x > 0)
    runs, i = [], 0
    while i < n:
        j = i
        while j < n and s[j] == s[i]:
            j += 1
        runs.append(j - i)
        i = j
    lags = [sum(s[i] == s[i + k] for i in range(n - k)) / (n - k) if n > k else 0.0 for k in sequences.LAGS]
    return [n / padded, *base, base[1] + base[2], entropy(base), *pairs, entropy(pairs), max(runs) / n, sum(r for r in runs if r >= 3) / n, *lags]


def test_read_features(spark):
    rng = np.random.default_rng(0)
    rows = ["".join(rng.choice(list("ACGT"), rng.integers(1, 60))) for _ in range(40)] + ["A", "AAAA", "ACACACAC"]
    df = spark.createDataFrame([(s,) for s in rows], "s string")
    got = df.select(*[c.alias(n) for n, c in sequences.read_features(F.col("s"), 100).items()]).collect()
    assert len(got[0]) == 33
    assert np.allclose([list(r) for r in got], [read_features(s, 100) for s in rows])


def test_sequence_features_per_archive(spark):
    rows = [("a", "ACGTACGT"), ("a", "AAACCC"), ("b", "GGGG")]
    out = features.sequence_features(spark.createDataFrame(rows, "a string, s string"), "s", ["a"], 12)
    assert len(out.columns) == 166
    r = {x.a: x for x in out.collect()}
    assert r["a"].length_mean == pytest.approx(7 / 12) and r["b"].length_std == 0.0 and r["a"].gc_mean == pytest.approx(0.5)


def test_seeds_and_digests(spark):
    import hashlib

    df = spark.createDataFrame([("x", 7, 0.05)], "a string, b int, c double")
    got = df.select(sequences.stable_seed(F.lit("k"), F.col("a"), F.col("b"), F.col("c")).alias("s"), sequences.digest(F.lit("ACGT")).alias("d")).first()
    assert got.s == Decimal(codes.stable_seed("k", "x", 7, 0.05))
    assert got.d == hashlib.sha256(bytes([0, 1, 2, 3])).hexdigest()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=0, max_size=50))
def test_bits_and_bases(bits):
    x = np.array(bits, "u1")
    back = codes.to_bits(codes.to_bases(x))
    assert back[: len(x)].tolist() == bits and len(back) == len(x) + len(x) % 2


@pytest.mark.parametrize("n,k,g", codes.BCH)
def test_cyclic_codewords_divide(n, k, g):
    m = codes.cyclic_matrix(n, k, g)
    for message in np.random.default_rng(1).integers(0, 2, (20, k), "u1"):
        word = codes.linear(message, m)
        assert word[:k].tolist() == message.tolist()
        assert codes.remainder(int("".join(map(str, word)), 2), g) == 0
    with pytest.raises(ValueError):
        codes.cyclic_matrix(n, k, g ^ 0b10)


@pytest.mark.parametrize("n,k", codes.SIZES)
def test_sparse_and_polar_codes_are_linear(n, k):
    g, h = codes.sparse_matrix(n, k, 5)
    assert codes.rank(g) == k and codes.rank(h) == n - k and not (g.astype(int) @ h.T % 2).any()
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2, (2, k), "u1")
    assert (codes.polar(a ^ b, n) == codes.polar(a, n) ^ codes.polar(b, n)).all()
    x = rng.integers(0, 2, n, "u1")
    assert (codes.polar_transform(codes.polar_transform(x)) == x).all()


def test_polar_reliabilities_keep_capacity():
    z = codes.erasure_reliabilities(64, 0.3)
    assert z.mean() == pytest.approx(0.3) and z.argmin() == 63
    with pytest.raises(ValueError):
        codes.erasure_reliabilities(12)


def test_convolutional_lengths_and_linearity():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2, (2, 300), "u1")
    for rate, n in (("1_2", 600), ("1_3", 900), ("1_4", 1200), ("3_4", 400)):
        assert len(codes.convolutional(a, rate)) == n
        assert (codes.convolutional(a ^ b, rate) == codes.convolutional(a, rate) ^ codes.convolutional(b, rate)).all()
    impulse = codes.convolutional(np.eye(1, 4, dtype="u1")[0], "1_2").reshape(4, 2)
    assert impulse.T.tolist() == [[1, 1, 1, 1], [1, 0, 1, 1]]


def test_droplets_and_soliton():
    p = codes.robust_soliton(8)
    assert p.sum() == pytest.approx(1) and (p > 0).all() and codes.robust_soliton(1).tolist() == [1.0]
    blocks = np.random.default_rng(4).integers(0, 2, (8, 768), "u1")
    for chosen, bits in codes.droplets(blocks, 20, np.random.default_rng(5)):
        assert (np.bitwise_xor.reduce(blocks[list(chosen)], axis=0) == bits).all()


def test_outer_codes():
    assert codes.reed_solomon(np.array([5, 0, 0])).tolist() == [5] * 96
    assert codes.reed_solomon(np.array([0, 1]), 4).tolist() == [1, 2, 3, 4]
    words = codes.extended_hamming(np.array([[int(b) for b in f"{i:04b}"] for i in range(16)], "u1"))
    gaps = (words[:, None] != words[None]).sum(axis=2)
    assert gaps[~np.eye(16, dtype=bool)].min() == 4
    payload = np.random.default_rng(6).integers(0, 2, 256, "u1")
    assert (codes.turbo(payload, np.arange(256))[:256] == payload).all()
    assert codes.xorshift_states(1, 3)[0] == 1 and len(set(codes.xorshift_states(1, 3))) == 3


def test_channel_rates_and_truncation():
    template = np.random.default_rng(7).integers(0, 4, 100_000, "u1")
    read, e = codes.noisy(template, np.random.default_rng(8), 0.1, 0.1, 0.1)
    assert e.insertions / e.bases == pytest.approx(0.1, abs=0.006) and e.deletions / e.bases == pytest.approx(0.1, abs=0.006)
    assert e.substitutions / e.bases == pytest.approx(0.09, abs=0.006) and len(read) == e.bases + e.insertions - e.deletions
    same, none = codes.noisy(template, np.random.default_rng(8), 0, 0, 0, 400)
    assert (same == template[:400]).all() and none.insertions == none.deletions == none.substitutions == 0
    with pytest.raises(ValueError):
        codes.noisy(template, np.random.default_rng(8), 1.2, 0, 0)


def test_simulated_tables_repeat(spark):
    refs = simulate.references(spark, ["BCH", "Polar", "NoECC-Constrained"], 2, 3)
    rows = refs.orderBy("category", "archive_id", "molecule_id").collect()
    again = refs.repartition(7).orderBy("category", "archive_id", "molecule_id").collect()
    assert rows == again and len(rows) == 18 and all(len(r.sequence) == 384 for r in rows)
    reads = simulate.reads(refs, 4, 0.05)
    assert reads.count() == 72 and reads.where("length(sequence) > 400").count() == 0
    with pytest.raises(ValueError):
        codes.reference("Fountain", "train", 0, 0)
    audited = audit.reference_audit(refs, "sequence", "category", 384)
    assert audit.fail_closed(audited).count() == 3
    twice = audit.reference_audit(refs.union(refs), "sequence", "category")
    with pytest.raises(Exception, match="audit failed"):
        audit.fail_closed(twice).collect()


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT" * 30), ("b", "GG")], "id string, sequence string")
    fasta.write(df, str(tmp_path / "f"), compression="gzip")
    assert sorted((r.id, r.sequence) for r in fasta.read(spark, str(tmp_path / "f")).collect()) == [("a", "ACGT" * 30), ("b", "GG")]
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "x.fasta").write_text(">one extra words\nacg\nt\r\n\n>two\nGG\n>empty\n")
    got = {r.id: (r.description, r.sequence) for r in fasta.read(spark, str(tmp_path / "deep"), recursive=True).collect()}
    assert got == {"one": ("one extra words", "ACGT"), "two": ("two", "GG"), "empty": ("empty", "")}


def test_delimited_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("ok", [1.0, 2.0])], "status string, matrix array<double>")
    b = spark.createDataFrame([(0.5, "x,\"y\"")], "score double, status string")
    both = delimited.union_of_columns([a, b])
    assert both.columns == ["status", "matrix", "score"]
    delimited.write_csv(both, str(tmp_path / "c"), compression="gzip")
    back = delimited.read_csv(spark, str(tmp_path / "c"), T.StructType.fromDDL("status string, matrix array<double>, score double"))
    assert sorted(map(str, back.collect())) == sorted(map(str, both.collect()))


def test_shards_resume(spark, tmp_path):
    df = spark.createDataFrame([(s, i, float(i)) for s in range(3) for i in range(4)], "seed int, i int, v double")
    path = str(tmp_path / "s")
    first = delimited.write_pending(spark, df, path, ["seed"])
    assert {r.seed: r.rows for r in first.collect()} == {0: 4, 1: 4, 2: 4}
    import shutil

    shutil.rmtree(f"{path}/data/seed=1")
    stamp = {p: p.stat().st_mtime for p in (tmp_path / "s" / "data" / "seed=0").glob("*.parquet")}
    again = delimited.write_pending(spark, df, path, ["seed"])
    assert {r.seed: r.rows for r in again.collect()} == {0: 4, 1: 4, 2: 4}
    assert stamp == {p: p.stat().st_mtime for p in (tmp_path / "s" / "data" / "seed=0").glob("*.parquet")}


def test_file_inventories(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "type_cnn_f1_0.91.pt").write_bytes(b"one")
    (tmp_path / "in" / "b.txt").write_bytes(b"two")
    found = files.hashes(spark, str(tmp_path / "in"))
    kept = spark.createDataFrame(found.select("path", "sha256").collect())
    assert files.verify(found, kept).count() == 0
    (tmp_path / "in" / "b.txt").write_bytes(b"three")
    (tmp_path / "in" / "c.txt").write_bytes(b"new")
    state = {r.path: r.state for r in files.verify(files.hashes(spark, str(tmp_path / "in")), kept.union(spark.createDataFrame([("gone", "0")], kept.schema))).collect()}
    assert state == {"b.txt": "changed", "c.txt": "unexpected", "gone": "missing"}
    w = files.weights(files.hashes(spark, str(tmp_path / "in")), expected=kept).first()
    assert (w.task, w.model, w.f1, w.hash_matches) == ("type", "cnn", 0.91, True)


def test_array_files_and_command_line(spark, tmp_path):
    rng = np.random.default_rng(9)
    categories = np.array(["BCH", "Convolutional", "LDPC", "Polar", "NoECC-Random", "NoECC-Constrained", "HEDGES"])
    presence = np.where(np.arange(7) < 4, 0.9, 0.1)[:, None, None] + rng.random((7, 2, 3)) / 100
    presence[6] = 0.9
    x = rng.normal(0, 0.1, (7, 2, 3, 4))
    for i in range(4):
        x[i, ..., i] += 5
    np.savez_compressed(tmp_path / "one.npz", categories=categories, presence=presence.astype("f4"), type_logits=x.astype("f4"))
    df = logits.from_arrays(spark, str(tmp_path))
    (tmp_path / "other").mkdir()  # the names that shared logits are saved under
    np.savez_compressed(tmp_path / "other" / "shared.npz", categories=categories, presence_probabilities=presence.astype("f4"), type_logits=x.astype("f4"), archive_ids=np.arange(7).astype(str))
    assert sorted(map(repr, logits.from_arrays(spark, str(tmp_path / "other")).collect())) == sorted(map(repr, df.collect()))
    assert df.count() == 42 and logits.validated(df).count() == 42
    cli.main(["import-arrays", str(tmp_path), str(tmp_path / "l")])
    cli.main(["calibrate", str(tmp_path / "l"), str(tmp_path / "t.json")])
    assert 0.12 < json.loads((tmp_path / "t.json").read_text())["presence"] < 0.9
    cli.main(["compare", str(tmp_path / "l"), str(tmp_path / "t.json"), str(tmp_path / "o")])
    got = {r.category: r.cascade_output for r in spark.read.parquet(str(tmp_path / "o" / "archives")).collect()}
    assert got["HEDGES"] == "unknown_ecc" and got["LDPC"] == "LDPC" and got["NoECC-Random"] == "no_ecc"
    cli.main(["records", str(tmp_path / "l"), str(tmp_path / "t.json"), str(tmp_path / "r"), "--molecules", "2", "--reads", "3", "--read-sweep", "1", "3", "--molecule-sweep", "1"])
    wide = spark.read.parquet(str(tmp_path / "r")).collect()
    assert len(wide) == 7 * 4 and {(r.setting, r.M, r.q) for r in wide} == {("default", 2, 3), ("q_sweep", 2, 1), ("q_sweep", 2, 3), ("M_sweep", 1, 3)}
    assert all(r.predicted_final_label == got[r.category] for r in wide if r.setting == "default")
    one = next(r for r in wide if r.category == "LDPC" and r.setting == "M_sweep")
    assert one.max_logit == pytest.approx(x[2, :1].astype("f4").mean(axis=(0, 1)).max(), abs=1e-6) and one.code_type == "LDPC" and one.unknown_score == one.stage2_energy
    with pytest.raises(Exception, match="out of range"):
        logits.validated(df.withColumn("presence", F.lit(1.5))).collect()
    np.savez(tmp_path / "two.npz", categories=categories)
    with pytest.raises(Exception, match="lacks"):
        logits.from_arrays(spark, str(tmp_path)).collect()


def test_scores_are_made_once(spark, tmp_path):
    def model():
        return lambda s: ([len(x) / 10 for x in s], [[float(len(x)), 0, 0, 0] for x in s])

    df = spark.createDataFrame([("a", "ACG"), ("b", "AC")], "id string, s string")
    got = logits.score_once(df, model, "s", str(tmp_path / "scored")).orderBy("id").collect()
    assert [round(r.presence, 4) for r in got] == [0.3, 0.2] and got[0].logits == [3.0, 0.0, 0.0, 0.0]


def test_self_checks_pass(spark):
    from lamina.operators import checks

    assert all(r.passed for r in checks.run(spark).collect())


def test_streaming_vote_equals_batch(spark, tmp_path):
    from lamina.operators import votes

    rows = [(f"a{i % 3}", i % 4, float(i)) for i in range(40)]
    schema = "archive_id string, molecule_id int, v double"
    for k in range(2):
        spark.createDataFrame(rows[k::2], schema).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = streaming.to_table(streaming.molecule_sums(stream, {"v": F.col("v")}), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    sums = streaming.latest(spark.read.parquet(str(tmp_path / "out")), ["archive_id", "molecule_id"], ["v"])
    got = sorted(map(tuple, votes.merge(sums, ["v"]).collect()))
    want = sorted((r.archive_id, r.v) for r in votes.two_level(spark.createDataFrame(rows, schema), {"v": F.col("v")}).collect())
    assert [(a, round(b, 9)) for a, b in got] == [(a, round(b, 9)) for a, b in want]


def test_streaming_windows_drop_late_rows(spark, tmp_path):
    schema = "archive_id string, molecule_id int, v double, ts timestamp_ntz"
    times = [["2024-01-01 00:01:00", "2024-01-01 01:30:00"], ["2024-01-01 03:00:00"], ["2024-01-01 00:02:00", "2024-01-01 06:00:00"]]
    for k, part in enumerate(times):
        spark.createDataFrame([("a", 0, 1.0, t) for t in part], "archive_id string, molecule_id int, v double, t string").selectExpr("archive_id", "molecule_id", "v", "cast(t as timestamp_ntz) AS ts").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = streaming.windowed_sums(stream, {"v": F.col("v")}, "ts", "1 hour", "10 minutes").writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.n for r in spark.table("late").collect()} == {1}


def test_gzip_lines_are_read(spark, tmp_path):
    with gzip.open(tmp_path / "r.fasta.gz", "wt") as f:
        f.write(">a\nAC\nGT\n")
    assert fasta.read(spark, str(tmp_path / "r.fasta.gz")).first().sequence == "ACGT"


def test_encoder_seeds_tell_the_encoder(spark):
    df = spark.createDataFrame([(c, "test", a, m) for c in ("LDPC", "BCH", "no_ecc") for a, m in ((0, 1), (1, 0), (0, 2))], "c string, s string, a int, m int")
    got = [r[0] for r in df.select(simulate.encoder_seed(F.col("c"), F.col("s"), F.col("a"), F.col("m"))).collect()]
    assert got[0] == got[1] == Decimal(codes.stable_seed("ldpc-encoder", "test", 1, 64, 48)) and got[0] != got[2]
    assert got[3] == got[4] == Decimal(codes.stable_seed("fixed-bch-encoder-provenance", 1)) and len(set(got[6:])) == 3
