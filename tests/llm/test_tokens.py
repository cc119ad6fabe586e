import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import bpe, packing

tokenizers = pytest.importorskip("public_tokenizers")
RANKS, VOCABULARY = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "the", "word's", "'", "'ll", " ", "  ", "   ", "\n", " \n", "\t", "é", "日本", "12", "!", "<|endoftext|>", "\x1c", "\x85", "　", "😀", ".", "x" * 80, " "]


def texts(n=600, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 16))) for _ in range(n)] + ["", None, "plain words again and again " * 500, "nospace" * 3000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_both_files_hold_one_vocabulary():
    assert bpe.read_ranks(RANKS) == bpe.read_ranks(VOCABULARY)
    assert bpe.BYTE_LEVEL_PATTERN == tokenizers.PATTERN


def test_ids_equal_both_libraries(library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 700)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 60)
    ranks, whole, rows = bpe.ByteBpe(RANKS), bpe.ByteBpe(VOCABULARY, added=bpe.read_added(VOCABULARY)), texts()
    encoder = ranks
    for text, plain, ids in zip(rows, ranks.encode_batch(pa.array(rows)), whole.encode_batch(pa.array(rows)), strict=True):
        assert plain.tolist() == ranks.encoding.encode_ordinary(text or "")
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids
        assert ranks.decode(plain) == whole.decode(ids) == (text or "").encode()
    assert list(encoder.encode_batch(pa.array([], pa.string()))) == []


def test_raw_bytes_decode():
    encoder = bpe.ByteBpe(RANKS)
    ids = encoder.encoding.encode_ordinary("é日本😀")
    assert b"".join(encoder.decode(np.array([i], "u4")) for i in ids) == "é日本😀".encode()


def test_round_trip_on_tables(spark):
    rows = list(enumerate(texts(100)))
    rows += [(None, "null id"), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("token_ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    got = bpe.encode_decode(df, RANKS, tokenizers.PATTERN).collect()
    assert sorted(hashlib.sha256(r.decoded).hexdigest() for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert bpe.encode_decode(df.limit(0), RANKS).count() == 0


def test_first_fit_decreasing_equals_brute_force():
    rng = random.Random(2)
    for _ in range(100):
        sizes = [rng.randint(1, 10) for _ in range(rng.randint(0, 40))]
        free, bins = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((b for b, room in enumerate(free) if room >= sizes[i]), len(free))
            if at == len(free):
                free.append(10)
                bins.append([])
            free[at] -= sizes[i]
            bins[at].append(i)
        assert packing.first_fit_decreasing(sizes, 10) == bins


def test_packed_lengths_hold_every_token_without_padding():
    rng = random.Random(3)
    for _ in range(150):
        lengths = [rng.choice([1, 3, 512, 1024, rng.randint(1, 3000)]) for _ in range(rng.randint(0, 120))]
        found = packing.pack_lengths(lengths, 1024)
        at = {}
        for doc, start, n in sorted(p for s in found for p in s):
            assert at.get(doc, 0) == start and n > 0
            at[doc] = start + n
        assert [at.get(d, 0) for d in range(len(lengths))] == lengths
        assert all((t := sum(p[2] for p in s)) == 1024 or t & (t - 1) == 0 for s in found)


def test_packing_on_tables(spark, library):
    rows = list(enumerate(texts(60)))
    rows += [(None, "null id"), rows[7], rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("pack_group", F.lit(2))
    got = packing.pack(df, VOCABULARY, group_documents=16).collect()
    wanted = {}
    for doc_id, text in rows:
        wanted.setdefault(doc_id, []).append(library.encode(text or "", add_special_tokens=False).ids + [0])
    assert sum(r.length for r in got) == sum(len(x) for v in wanted.values() for x in v)
    for doc_id, docs in wanted.items():
        if len(docs) == 1:
            ids, own = docs[0], sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == doc_id)
            assert [p[0] for p in own] == [sum(p[1] for p in own[:i]) for i in range(len(own))] and own[0][3] == len(ids)
            assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for s, n, c, _ in own)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert packing.pack(df.limit(0), VOCABULARY).count() == 0


def test_registered_queries(spark, library, tmp_path):
    """op1 by the rank file, where the added token is text; op3 by the vocabulary as the library loads it."""
    rows = list(enumerate([*texts(40), "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  ", "  <|endoftext|>\n", "<|endoftext|", "long words " * 3000]))
    spark.createDataFrame([*rows, (None, "null id")], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    plain = bpe.ByteBpe(RANKS).encoding
    for r in bpe.op1_byte_bpe(spark, str(tmp_path)).where("doc_id is not null").collect():
        text = rows[r.doc_id][1] or ""
        ids = np.array(plain.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = packing.op3_packing(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in got if r.doc_id is not None} == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
    pieces = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == len(rows) - 1)
    ids = np.array([*library.encode(rows[-1][1], add_special_tokens=False).ids, 0], "<u4")
    assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n, _ in pieces] == [c for *_, c in pieces] and sum(n for _, n, _ in pieces) == len(ids)
    totals = {}
    for r in got:
        totals[r.sequence_id] = totals.get(r.sequence_id, 0) + r.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in totals.values())
