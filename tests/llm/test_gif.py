import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import gif


@pytest.mark.parametrize("minimum", [2, 3, 7, 8])
def test_lzw_round_trip(minimum):
    rng = random.Random(minimum)
    for size in (0, 1, 2, 3, 100, 5000, 60_000):
        for values in (1, 2, 1 << minimum):
            x = bytes(rng.randrange(min(values, 1 << minimum)) for _ in range(size))
            assert gif.lzw_decode(gif.lzw_encode(x, minimum), minimum, len(x)) == x


def test_known_stream_decodes():
    # 10 x 10 image of four colours, a published worked example of the format
    stream = bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01])
    rows = [[1] * 5 + [2] * 5] * 3 + [[1] * 3 + [0] * 4 + [2] * 3] * 2 + [[2] * 3 + [0] * 4 + [1] * 3] * 2 + [[2] * 5 + [1] * 5] * 3
    assert list(gif.lzw_decode(stream, 2, 100)) == [x for r in rows for x in r]


def test_files_give_their_samples_back():
    rng = np.random.default_rng(0)
    texts = [("words of a text that repeats itself, é 日本 😀\n" * 300).encode()[: 576 * k] for k in (1, 4, 5, 9, 17)]
    for samples in [*texts, rng.integers(0, 256, 576 * 9).astype("u1").tobytes(), bytes(range(256)) * 27, b"\xff" * 576, b"ab" * (576 * 6) + b"\xff" * 576 * 2]:
        found = gif.read_gif(gif.write_gif(samples))
        assert b"".join(gif.palette_samples(gif.own_pixels(f)).tobytes() for f in found.frames) == samples
        assert [f.start_ms for f in found.frames] == [40 * i for i in range(len(found.frames))] and len(found.frames) == -(-len(samples) // 2304)


def test_streams_transparency_and_disposal_are_used():
    samples = (b"abcdefgh" * 288 + b"xyz0123-" * 288) * 3  # every other frame shows what the one before the last did
    data = gif.write_gif(samples)
    controls = [data[i + 3] for i in range(len(data) - 8) if data[i : i + 3] == b"\x21\xf9\x04"]
    assert all(c & 1 for c in controls) and {c >> 2 for c in controls} == {1, 3}
    assert len(data) < len(samples) // 4
    found = gif.read_gif(data)
    assert b"".join(gif.palette_samples(gif.own_pixels(f)).tobytes() for f in found.frames) == samples


def image(frames, width=4, height=4, palette=b"\xff\0\0\0\xff\0\0\0\xff\xff\xff\xff"):
    """frames: (left, top, w, h, numbers, disposal, transparent, local palette, interlaced)"""
    out = [b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, 0, 0) + palette]
    for left, top, w, h, numbers, disposal, clear, local, interlaced in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), 7, clear or 0, 0))
        flags = (0x80 | 1 if local else 0) | (0x40 if interlaced else 0)
        out.append(struct.pack("<BHHHHB", 0x2C, left, top, w, h, flags) + (local or b""))
        stream = gif.lzw_encode(bytes(numbers), 2)
        out.append(bytes([2, len(stream)]) + stream + b"\0")
    return b"".join([*out, b"\x21\xfe\x02hi\0", b";"])


def test_disposal_transparency_and_palettes():
    full = (0, 0, 4, 4, [0] * 16, 1, None, None, False)
    spot = [1, 2, 2, 1]
    kept = gif.read_gif(image([full, (1, 1, 2, 2, spot, 1, 2, None, False), (0, 0, 1, 1, [3], 1, None, None, False)])).frames
    assert kept[1].pixels[1, 1].tolist() == [0, 255, 0, 255] and kept[1].pixels[1, 2].tolist() == [255, 0, 0, 255]
    assert kept[2].pixels[0, 0].tolist() == [255] * 4 and kept[2].pixels[1, 1].tolist() == [0, 255, 0, 255]
    assert [(f.start_ms, f.delay_ms) for f in kept] == [(0, 70), (70, 70), (140, 70)]
    cleared = gif.read_gif(image([full, (1, 1, 2, 2, spot, 2, None, None, False), (0, 0, 1, 1, [3], 1, None, None, False)])).frames
    assert cleared[2].pixels[1, 1].tolist() == [0, 0, 0, 0]
    restored = gif.read_gif(image([full, (1, 1, 2, 2, spot, 3, None, None, False), (0, 0, 1, 1, [3], 1, None, None, False)])).frames
    assert restored[1].pixels[1, 1].tolist() == [0, 255, 0, 255] and restored[2].pixels[1, 1].tolist() == [255, 0, 0, 255]
    local = gif.read_gif(image([(0, 0, 4, 4, [1] * 16, 1, None, b"\1\2\3\4\5\6\7\7\7\x08\x08\x08", False)])).frames
    assert local[0].pixels[0, 0].tolist() == [4, 5, 6, 255]
    rows = [y for y in (0, 4, 2, 6, 1, 3, 5, 7)]
    mixed = gif.read_gif(image([(0, 0, 1, 8, [y % 4 for y in rows], 1, None, None, True)], 1, 8)).frames
    assert gif.histogram(mixed[0].pixels).sum() == 8 and mixed[0].pixels[1, 0].tolist() == [0, 255, 0, 255] and mixed[0].pixels[2, 0].tolist() == [0, 0, 255, 255]


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"nothing", gif.write_gif(b"\0" * 576)[:-40], gif.write_gif(b"\0" * 576)[:790] + b"\x99"])
def test_damage_is_reported(data):
    with pytest.raises(ValueError):
        gif.read_gif(data)


def test_tables(spark):
    rows = [(1, "é" * 700), (2, None), (3, ""), (None, "x"), (5, "y" * 576), (5, "y" * 576)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("samples", F.lit(1))
    stored = gif.store_texts(df)
    got = gif.summaries(stored).collect()
    for r, (doc_id, text) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_bytes)), sorted(rows, key=lambda r: (r[0] or 0, len(r[1] or "")))):
        want, n = gif.payload(text)
        assert (r.doc_id, r.n_bytes, bytes(r.samples)) == (doc_id, n, want) and sum(r.histogram) == len(want) and r.error is None
    assert gif.payload(None) == (b"\xff" * 576, 0)
    shown = gif.frames(stored).where("doc_id = 1").orderBy("frame").collect()
    assert [f.start_ms for f in shown] == [0] and [sum(f.histogram) for f in shown] == [576 * 3]
    clash = stored.withColumn("error", F.lit("x")).withColumn("row", F.lit(1)).withColumn("__row", F.lit(2)).withColumn("samples", F.lit("y"))
    assert {(r.row, r["__row"], r.error) for r in gif.summaries(clash).collect()} == {(1, 2, None)}
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id long, media binary")
    assert [r.error for r in gif.summaries(broken).orderBy("doc_id").collect()] == ["no medium", "not a GIF"]
    assert gif.frames(broken).where("error is not null").count() == 2
    assert gif.summaries(stored.limit(0)).count() == 0


def test_query_digests(spark, tmp_path):
    rows = [(1, "abc"), (2, "abc"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in gif.op4_gif(spark, str(tmp_path)).collect()}
    want = gif.payload("abc")[0]
    assert got[1].payload_sha256 == hashlib.sha256(want).hexdigest() and got[1].tail_crc32 == zlib.crc32(want[-32:])
    assert got[1].media_sha256 == hashlib.sha256(gif.write_gif(want)).hexdigest() and got[1].feature == got[2].feature and got[3].n_bytes == 0
