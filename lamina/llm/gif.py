"""GIF media columns: LZW streams, palettes, disposal and transparency, timed frames, colour histograms.

Texts are stored 2304 bytes to a frame of 48 x 48, the last frame as high as it needs to be. Streams are LZW with a
table. A sample that equals what the canvas shows at its place is written as the transparent colour, where the
samples leave a number free (UTF-8 never has byte 254); a frame is kept or taken back (disposal 1 or 3), whichever
lets the next one show more of what is there. Reading undoes all of that: the samples are what the composed canvas shows in a frame's own box.

Defined cases: a null or empty text is stored as one frame of bytes 255; a null or damaged
medium gives null results and the reason in ``error``; repeated rows are handled each; an
empty table gives no rows; other columns of the input are not read by store_texts() and frames(), and kept by
summaries(), whose own columns replace those of the same names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import common

UNIT = 576  # bytes; what a text is filled up to
WIDTH = 48  # of a frame; a unit is 12 rows
HEIGHT = 48  # at most
BINS = 64  # two bits of each colour
DELAY_CS = 4


def sample_palette() -> np.ndarray:
    """256 different colours: three bits of red and green, two of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 36, (i >> 2 & 7) * 36, (i & 3) * 85], axis=1).astype("u1")


def palette_samples(rgb: np.ndarray) -> np.ndarray:
    """The numbers of colours of sample_palette()."""
    return ((rgb[..., 0] // 36) << 5 | (rgb[..., 1] // 36) << 2 | rgb[..., 2] // 85).astype("u1")


@cache
def code_places(minimum: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code, and the bits before each."""
    widths = np.clip(np.floor(np.log2((1 << minimum) + np.arange(1, count + 1))).astype("i8") + 1, minimum + 1, 12)
    return widths, np.cumsum(widths) - widths


def lzw_encode(samples: bytes, minimum: int = 8) -> bytes:
    """Code stream of one image; a clear code before the table could be full."""
    clear, end = 1 << minimum, (1 << minimum) + 1
    runs: list[list[int]] = []
    step = 4095 - end  # as many samples make no more entries than there is room for
    for start in range(0, max(1, len(samples)), step):
        codes: list[int] = []
        emit, table, fresh, rest = codes.append, {}, end, iter(samples[start : start + step])
        prefix = next(rest, None)
        for sample in rest:
            key = prefix << 8 | sample
            if key in table:
                prefix = table[key]
            else:
                emit(prefix)
                table[key] = fresh = fresh + 1
                prefix = sample
        if prefix is not None:
            emit(prefix)
        emit(clear if start + step < len(samples) else end)
        runs.append(codes)
    values, widths = [np.array([clear])], [np.array([minimum + 1])]
    for run in runs:
        values.append(np.array(run))
        widths.append(code_places(minimum, 1 << 13)[0][: len(run)])
    value, width = np.concatenate(values), np.concatenate(widths)
    ends = np.cumsum(width)
    at = ends - width
    value, byte = value << (at & 7), at >> 3
    parts = np.bincount(np.concatenate([byte, byte + 1, byte + 2]), np.concatenate([value & 255, value >> 8 & 255, value >> 16]))  # bits don't overlap, so sums are unions
    return parts[: (int(ends[-1]) + 7) // 8].astype("u1").tobytes()


def lzw_decode(data: bytes, minimum: int, pixels: int) -> bytes:
    """Samples of a code stream, up to ``pixels``; ValueError where a code can't be."""
    if not 1 <= minimum <= 11:
        raise ValueError("bad LZW code size")
    clear, end = 1 << minimum, (1 << minimum) + 1
    raw = np.frombuffer(data + b"\0\0\0", "u1").astype("i8")
    bits, at, out, stop = 8 * len(data), 0, bytearray(), False
    if len(data) > 1 and int.from_bytes(data[:2], "little") & ((2 << minimum) - 1) == clear:
        at = minimum + 1  # the clear code that streams begin with
    while not stop and len(out) < pixels:
        count = min(4096, (bits - at) // (minimum + 2) + 8)  # the codes up to the next clear code come out together
        while True:
            widths, places = code_places(minimum, count)
            fits = int(np.searchsorted(places + widths, bits - at, side="right"))
            where = at + places[:fits]
            byte = where >> 3
            codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (where & 7)) & ((1 << widths[:fits]) - 1)
            ends = np.flatnonzero((codes == clear) | (codes == end))
            if len(ends) or fits < count:
                break
            count *= 4
        if len(ends):
            n = int(ends[0])
            stop = bool(codes[n] == end)
            at += int(places[n] + widths[n])
            codes = codes[:n]
        else:
            stop = True
        out += expand(codes, clear)
    return bytes(out[:pixels])


def expand(codes: np.ndarray, clear: int) -> bytes:
    """The strings of codes that follow one clear code.

    An entry is the string of the code it was made at and the next one's first sample: a stretch of what is out
    already. So a code's length is its distance from a literal, and every sample is a copy of one further in front; both
    are found by following all links at once, twice as far in every round.
    """
    n = len(codes)
    if not n:
        return b""
    literal = codes < clear
    made_at = np.where(literal, n, codes - clear - 2)
    if not literal[0] or (~literal & ((made_at < 0) | (made_at >= np.arange(n)))).any():
        raise ValueError("LZW code before its entry")
    link, length = np.append(made_at, n), np.append((~literal).astype("i8"), 0)
    while (link != n).any():
        length, link = length + length[link], link[link]
    length = length[:n] + 1
    starts = np.cumsum(length) - length
    shift = np.where(literal, 0, starts - np.append(starts, 0)[made_at])
    source = np.arange(int(length.sum())) - np.repeat(shift, length)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    return np.repeat(codes, length).astype("u1")[source].tobytes()


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    pixels: np.ndarray  # height x width x 4, the canvas as shown: red, green, blue, alpha
    box: tuple[int, int, int, int]  # left, top, width and height of the frame's own image


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame]


def write_gif(samples: bytes, width: int = WIDTH, height: int = HEIGHT, palette: np.ndarray | None = None, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF whose frames hold the samples as palette numbers, losslessly; their number is a multiple of the width."""
    colours = sample_palette() if palette is None else palette
    values = np.frombuffer(samples, "u1")
    free = np.flatnonzero(np.bincount(values, minlength=256) == 0)
    clear = int(free[-1]) if len(free) else -1
    size = width * height
    images = [values[i : i + size] for i in range(0, len(values), size)]
    rows = min(height, len(values) // width)
    out = [b"GIF89a" + struct.pack("<HHBBB", width, max(rows, 1), 0xF7, 0, 0) + colours.astype("u1").tobytes()]
    shown = np.full(size, -1, "i2")  # numbers on the canvas; -1: nothing yet
    for number, image in enumerate(images):
        n, drawn, kept = len(image), image, shown.copy()
        kept[:n] = image
        if clear >= 0:
            drawn = np.where(shown[:n] == image, clear, image).astype("u1")
        following = images[number + 1] if number + 1 < len(images) else image[:0]
        restore = np.count_nonzero(shown[: len(following)] == following) > np.count_nonzero(kept[: len(following)] == following)
        stream = lzw_encode(drawn.tobytes())
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, (3 if restore else 1) << 2 | (clear >= 0), delay_cs, max(clear, 0), 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, n // width, 0, 8))
        out += [bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)]
        out.append(b"\0")
        shown = shown if restore else kept
    return b"".join([*out, b";"])


def read_gif(data: bytes) -> Gif:
    """All frames as shown: interlacing undone, palettes and transparency applied, disposal obeyed."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at = 13

    def colours(flags: int) -> np.ndarray:
        """Red, green, blue and full alpha, four bytes as one number."""
        nonlocal at
        n = 2 << (flags & 7)
        table = np.full((n, 4), 255, "u1")
        table[:, :3] = np.frombuffer(data, "u1", 3 * n, at).reshape(n, 3)
        at += 3 * n
        return table.view("u4").ravel()

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    try:
        common_table = colours(flags) if flags & 0x80 else None
        canvas = np.zeros((height, width), "u4")
        frames: list[Frame] = []
        clock = delay = disposal = 0
        clear_number = -1
        while (kind := data[at]) != 0x3B:
            at += 1
            if kind == 0x21:
                label = data[at]
                at += 1
                body = blocks()
                if label == 0xF9:
                    packed, hundredths, number = struct.unpack_from("<BHB", body)
                    delay, disposal, clear_number = 10 * hundredths, packed >> 2 & 7, number if packed & 1 else -1
                continue
            if kind != 0x2C:
                raise ValueError(f"unknown block {kind}")
            left, top, w, h, local = struct.unpack_from("<HHHHB", data, at)
            at += 9
            table = colours(local) if local & 0x80 else common_table
            if table is None:
                raise ValueError("image without a palette")
            minimum = data[at]
            at += 1
            numbers = np.frombuffer(lzw_decode(blocks(), minimum, w * h), "u1")
            if len(numbers) < w * h:
                raise ValueError("image data ends early")
            image = numbers.reshape(h, w)
            if local & 0x40:
                order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
                image = image[np.argsort(order)]
            if image.size and image.max() >= len(table):
                raise ValueError("colour outside the palette")
            before = canvas.copy() if disposal == 3 else None
            image = image[: max(0, height - top), : max(0, width - left)]
            region = canvas[top : top + h, left : left + w]
            if clear_number >= 0:
                np.copyto(region, table[image], where=image != clear_number)
            else:
                region[...] = table[image]
            frames.append(Frame(clock, delay, canvas.copy().view("u1").reshape(height, width, 4), (left, top, image.shape[1], image.shape[0])))
            clock += delay
            if disposal == 2:
                region[...] = 0
            elif before is not None:
                canvas = before
            delay = disposal = 0
            clear_number = -1
    except (IndexError, struct.error) as damage:
        raise ValueError("the file ends early") from damage
    return Gif(width, height, frames)


def own_pixels(frame: Frame) -> np.ndarray:
    """What the canvas shows in the frame's box, a row per pixel."""
    left, top, w, h = frame.box
    return frame.pixels[top : top + h, left : left + w].reshape(-1, 4)


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Visible pixels by two bits of red, green and blue."""
    seen = pixels.reshape(-1, 4)
    seen = (seen[seen[:, 3] > 0] >> 6).astype("i8")
    return np.bincount(seen[:, 0] << 4 | seen[:, 1] << 2 | seen[:, 2], minlength=BINS)


def payload(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    """UTF-8 of the text, filled up with bytes 255 to a positive multiple of ``unit``; and its own length."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // unit)) * unit - len(raw)), len(raw)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    samples, n = payload(text.as_py())
                    yield doc_id, n, write_gif(samples)

        yield from common.sliced(["doc_id", "n_bytes", "media"], [pa.int64(), pa.int64(), pa.binary()], rows())

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame: its number, start and delay, the canvas as RGBA bytes, and its colour histogram."""
    names = ["doc_id", "frame", "start_ms", "delay_ms", "width", "height", "rgba", "histogram", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    gif, error = read_or_error(data.as_py())
                    if gif is None:
                        yield doc_id, None, None, None, None, None, None, None, error
                        continue
                    for i, frame in enumerate(gif.frames):
                        yield doc_id, i, frame.start_ms, frame.delay_ms, gif.width, gif.height, frame.pixels.tobytes(), histogram(frame.pixels).tolist(), None

        yield from common.sliced(names, [pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.list_(pa.int64()), pa.string()], rows())

    source = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return source.mapInArrow(run, "doc_id long, frame int, start_ms int, delay_ms int, width int, height int, rgba binary, histogram array<long>, error string")


def read_or_error(data: bytes | None) -> tuple[Gif | None, str | None]:
    if data is None:
        return None, "no medium"
    try:
        return read_gif(data), None
    except ValueError as why:
        return None, str(why)


SUMMARY = ("n_frames", "duration_ms", "samples", "histogram", "error")


def summaries(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The other columns, and per medium: frames, duration, the samples that the colours of its frames' boxes stand for, their histogram, error.

    The bytes of the medium itself are dropped once read."""
    media = media.drop(*(c for c in SUMMARY if c != media_col))
    kept = [c for c in media.columns if c != media_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name in kept), "n_frames long, duration_ms long, samples binary, histogram array<long>, error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(c) for c in kept]

            def found():
                for i, data in enumerate(batch.column(media_col)):
                    gif, error = read_or_error(data.as_py())
                    if gif is None:
                        yield i, None, None, None, None, error
                        continue
                    pixels = np.concatenate([own_pixels(f) for f in gif.frames]) if gif.frames else np.empty((0, 4), "u1")
                    yield i, len(gif.frames), sum(f.delay_ms for f in gif.frames), palette_samples(pixels).tobytes(), histogram(pixels).tolist(), None

            for part in common.sliced(["__row", *SUMMARY], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.string()], found()):
                yield pa.RecordBatch.from_arrays([*(c.take(part.column(0)) for c in own), *part.columns[1:]], [*kept, *SUMMARY])

    return media.mapInArrow(run, schema)


def op4_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(common.documents(spark, sf_dir))
    stored = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return summaries(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -32, 32)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.array_join(F.col("histogram").cast("array<string>"), ",").alias("feature"),
        "n_frames",
        "duration_ms",
    )
