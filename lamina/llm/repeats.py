"""Removal of long passages that stand in an earlier document, by a compacted de Bruijn graph.

Windows of WINDOW words are edges of the graph (from their first twelve words to their last twelve). An edge's name is a
64-bit hash; its source coordinates are the document with the smallest id, and the place there, where it starts.
Words are found and hashed by whole arrays of bytes, for about half a megabyte of texts at once, and rows of a hash are put
together from sorted partitions, as most hashes are there once and aggregation in tables of objects costs more. The job:

1. Each different text posts the least GRAM-word hashes of its windows (one for about five words). Texts that
   share a window share the least hash in it, so only windows whose least hash stands in two texts can be repeated.
   A hash that OFTEN texts of a task's block have is posted once for the block, as one that stands in all chunks.
2. Those windows, combined within a chunk of texts, are grouped to edges: source coordinates, number of
   occurrences, the edge that follows if it is always the same, and the chunks that have it.
3. Repeated edges compact to paths: an edge and the next one of their source belong to one path where the first is
   always followed by the second and both occur equally often, so that nothing branches off. Each path is a row.
4. Paths are joined, by their first edge, with the chunks that have it. There they are found in the texts, words are
   removed where the source's id is smaller, and a digest of the words of every occurrence, the source's among them, is
   posted under the path. Digests that differ would show that hashes have collided; the job then runs
   again under other hashes. So no passage is removed that isn't word by word in an earlier document.

Equal texts are one text with the smallest of their ids; the others lose all their words if they have a window at all. A
group of copies is a row for each task that reads some of them, not a row each.

Defined cases: a null text has no words; one of fewer than WINDOW words has no window; a passage that is repeated only within
one document, or in documents of the same id, stays; a null id is larger than all others; repeated rows give repeated rows;
an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm import common

WINDOW = 13  # words
GRAM = 5  # words of the hashes that stand for windows
SEEDS = 5  # runs at most
BLOCK, OFTEN = 1 << 17, 64  # hashes posted at once, and how often one of them is there to be posted for all chunks
BYTES = 1 << 19  # of the texts that are taken apart at once
LONG = 64  # bytes of a word beyond which it is hashed by itself
CHUNK_BITS = 20
_NO_ID = (1 << 63) - 1
_ALL = -(1 << 63)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NOTHING = hashlib.sha256().hexdigest()
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], "u8")


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


class Words:
    """The words of some texts, all at once: where each starts and ends in the bytes, and in ``bounds`` the number of the first word of each text, and of all words."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" " + b" ".join(texts) + b" " * 9, "u1")
        self.gap = (self.data == 32) | (self.data - np.uint8(9) < 5)
        edges = np.flatnonzero(self.gap[1:] != self.gap[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        heads = np.cumsum([1, *(len(x) + 1 for x in texts)])
        self.bounds = np.searchsorted(self.starts, heads)

    def hashes(self, seed: int) -> np.ndarray:
        """Of each word, from eight bytes at a time."""
        eight = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        size = self.ends - self.starts
        salt = _mixed(np.array([seed + 1], "u8") * _BASE) | np.uint64(1)
        found = _mixed((eight[self.starts] & _LOW[np.minimum(size, 8)]) ^ (size.view("u8") * salt))
        more, at = np.flatnonzero(size > 8), 8
        while len(more) and at < LONG:
            found[more] = _mixed(found[more] * _BASE + (eight[self.starts[more] + at] & _LOW[np.minimum(size[more] - at, 8)]))
            at += 8
            more = more[size[more] > at]
        for i in more.tolist():
            found[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]], seed)
        return found

    def windows(self, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of GRAM words, those of WINDOW words, and which of the latter are inside of one text."""
        grams, windows = gram_hashes(self.hashes(seed))
        whole = np.ones(len(windows), bool)
        across = (self.bounds[1:, None] - np.arange(1, WINDOW)).ravel()
        whole[across[(across >= 0) & (across < len(whole))]] = False
        return grams, windows, whole

    def owners(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all words, each with one space behind it, and where words start there (and where the last space ends)."""
        after = np.append(True, self.gap[1:] & self.gap[:-1])
        return np.where(self.gap, np.uint8(32), self.data)[~after], np.append(0, np.cumsum(self.ends - self.starts + 1))


class Among:
    """Finds hashes among sorted ones; most of the others are told by their last bits."""

    def __init__(self, values: np.ndarray):
        self.values, bits = values, min(24, max(12, len(values).bit_length() + 4))
        self.mask, self.table = np.uint64((1 << bits) - 1), np.zeros(1 << bits, bool)
        self.table[(values & self.mask).view("i8")] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where there are such, and which they are."""
        if not len(self.values):
            return np.empty(0, "i8"), np.empty(0, "i8")
        at = np.flatnonzero(self.table[(hashes & self.mask).view("i8")])
        which = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        same = self.values[which] == hashes[at]
        return at[same], which[same]


def ordered(first: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """The order by ``first``, then the others. Only rows that are alike in ``first``, few here, are sorted by more than it."""
    order = np.argsort(first)
    same = first[order[1:]] == first[order[:-1]]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(first) else order
    if len(tied):
        rows = order[tied]
        order[tied] = rows[np.lexsort((*(x[rows] for x in reversed(others)), first[rows]))]
    return order


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows that are alike in all columns start."""
    if not len(columns[0]):
        return np.empty(0, "i8")
    return np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in columns])))


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns (longs) of rows that are sorted by the first of them, cut between two of its values."""
    left = None
    for batch in batches:
        columns = [np.asarray(x) for x in batch.columns]
        if not len(columns[0]):
            continue
        if left is not None:
            columns = [np.concatenate(x) for x in zip(left, columns)]
        cut = np.searchsorted(columns[0], columns[0][-1])
        left = [x[cut:] for x in columns]
        if cut:
            yield [x[:cut] for x in columns]
    if left is not None:
        yield left


def gram_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of GRAM (5) and of WINDOW (13 = 8 + 5) words, by doubling."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.empty(0, "u8"), np.empty(0, "u8")
    with np.errstate(over="ignore"):
        two = hashes[:-1] * _BASE + hashes[1:]
        second = _BASE * _BASE
        four = two[:-2] * second + two[2:]
        five = four[:-1] * _BASE + hashes[4:]
        fourth = second * second
        eight = four[:-4] * fourth + four[4:]
        return _mixed(five), _mixed(eight[:n] * (fourth * _BASE) + five[8:])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` in a row."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = np.minimum(values[:-step], values[step:])
        span += step
    return values


def _packed(texts: DataFrame, chunks: int) -> DataFrame:
    """chunk, digest, doc_id (the smallest that the task saw), times (how many rows had it) and the text, once for each task that saw it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = pa.Codec("zstd", 1), {}

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    raw = text.as_py()
                    digest = hashlib.md5(raw).digest()
                    if digest not in seen:
                        seen[digest] = [doc_id, 1]
                        yield _number(digest) % chunks, digest, None, 0, len(raw), codec.compress(raw, asbytes=True)
                    elif doc_id < seen[digest][0]:
                        seen[digest] = [doc_id, 1]
                    elif doc_id == seen[digest][0]:
                        seen[digest][1] += 1
            for digest, (doc_id, times) in seen.items():
                yield _number(digest) % chunks, digest, doc_id, times, None, None

        yield from common.sliced(["chunk", "digest", "doc_id", "times", "size", "packed"], [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], rows())

    return texts.mapInArrow(run, "chunk int, digest binary, doc_id long, times long, size long, packed binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def _with_verdicts(texts: DataFrame, verdicts: DataFrame, names: list[str], chunks: int) -> DataFrame:
    """Texts of a chunk behind the verdicts on it, in one partition. Columns: chunk, kind (0: verdict), the ``names`` (longs) of verdicts, and those of _packed()."""
    a = verdicts.select("chunk", F.lit(0).alias("kind"), *names, *[F.lit(None).cast(t).alias(n) for n, t in (("digest", "binary"), ("doc_id", "long"), ("times", "long"), ("size", "long"), ("packed", "binary"))])
    b = _packed(texts, chunks).select("chunk", F.lit(1).alias("kind"), *[F.lit(None).cast("long").alias(n) for n in names], "digest", "doc_id", "times", "size", "packed")
    return a.unionByName(b).repartitionById(chunks, F.col("chunk")).sortWithinPartitions("chunk", "kind", "digest", F.asc("doc_id"))


class _Chunks:
    """Walks the rows of _with_verdicts(): for each chunk the verdicts as arrays, then blocks of each different text, its digest, smallest id and how many rows have both."""

    def __init__(self, batches: Iterator[pa.RecordBatch], verdicts: int):
        self.batches, self.verdicts = batches, verdicts

    def __iter__(self):
        block, size = [], 0
        for what, chunk, value in self._each():
            if what == "text":
                block.append(value)
                size += len(value[0]) + 64
            if block and (what == "end" or size >= BYTES):
                yield "texts", chunk, block
                block, size = [], 0
            if what != "text":
                yield what, chunk, value

    def _each(self):
        codec = pa.Codec("zstd")
        at, arrays, text, digest, doc_id, times, begun = None, [], None, None, _NO_ID, 0, False
        for batch in self.batches:
            chunk, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for edge in np.split(np.arange(len(chunk)), np.flatnonzero((chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1):
                if not len(edge):
                    continue
                if chunk[edge[0]] != at:
                    if begun:
                        yield "text", at, (text, digest, doc_id, times)
                    if at is not None:
                        yield "end", at, None
                    at, arrays, begun = chunk[edge[0]], [], False
                part = batch.slice(edge[0], len(edge))
                if kind[edge[0]] == 0:
                    arrays.append([np.asarray(part.column(2 + i)).astype("i8") for i in range(self.verdicts)])
                    continue
                if arrays is not None:
                    yield "verdicts", at, [np.concatenate(x) for x in zip(*arrays)] if arrays else [np.empty(0, "i8")] * self.verdicts
                    arrays = None
                rest = [part.column(2 + self.verdicts + i) for i in range(5)]
                for d, i, n, size, packed in zip(rest[0].to_pylist(), rest[1].to_pylist(), rest[2].to_pylist(), rest[3].to_pylist(), rest[4]):
                    if begun and d != digest:
                        yield "text", at, (text, digest, doc_id, times)
                        begun = False
                    if not begun:
                        begun, digest, text, doc_id, times = True, d, None, None, 0
                    if size is not None:
                        if text is None:
                            text = codec.decompress(packed.as_buffer(), size, asbytes=True) if size else b""
                    elif doc_id is None or i < doc_id:
                        doc_id, times = i, n
                    elif i == doc_id:
                        times += n
        if begun:
            yield "text", at, (text, digest, doc_id, times)
        if at is not None:
            yield "end", at, None


def _number(digest: bytes) -> int:
    """Of a text, as a long."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _blocks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows with a text in front, by about BYTES of texts."""
    block, size = [], 0
    for row in rows:
        block.append(row)
        size += len(row[0]) + 64
        if size >= BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _posted(texts: DataFrame, chunks: int, seed: int) -> DataFrame:
    """chunk, least: the least hashes of a chunk's windows that two different texts have."""

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
        seen: set[bytes] = set()
        for batch in batches:
            for text in batch.column(0):
                raw = text.as_py()
                digest = hashlib.md5(raw).digest()
                if digest not in seen:
                    seen.add(digest)
                    yield raw, digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners, size = [], [], 0

        def posts():
            every, texts = np.concatenate(hashes), np.concatenate(owners)
            order = ordered(every, texts)
            every, texts = every[order], texts[order]
            one = _starts(every, texts)
            every, texts = every[one], texts[one]
            first = _starts(every)
            n = np.diff(np.append(first, len(every)))
            often = every[first[n >= OFTEN]]
            if len(often):
                few = np.repeat(n < OFTEN, n)
                every, texts = np.append(every[few], often), np.append(texts[few], np.full(len(often), _ALL))
            return pa.RecordBatch.from_arrays([pa.array(every.view("i8")), pa.array(texts)], ["least", "text"])

        for block in _blocks(different(batches)):
            words = Words([raw for raw, _ in block])
            grams, _, whole = words.windows(seed)
            places = np.flatnonzero(whole)
            if not len(places):
                continue
            low, texts = least(grams, WINDOW - GRAM + 1)[places], words.owners()[places]
            one = _starts(low, texts)
            hashes.append(low[one])
            owners.append(np.array([_number(digest) for _, digest in block])[texts[one]])
            size += len(one)
            if size >= BLOCK:
                yield posts()
                hashes, owners, size = [], [], 0
        if size:
            yield posts()
        common.give_back()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, texts in _whole_keys(batches):
            first = _starts(hashes)
            n = np.diff(np.append(first, len(hashes)))
            low = np.minimum.reduceat(texts, first)
            everywhere = low == _ALL
            several = np.repeat((low != np.maximum.reduceat(texts, first)) & ~everywhere, n)
            some, chunk = hashes[several], texts[several] % chunks
            order = ordered(some, chunk)
            some, chunk = some[order], chunk[order]
            one = _starts(some, chunk)
            yield pa.RecordBatch.from_arrays([pa.array(chunk[one].astype("i4")), pa.array(some[one])], ["chunk", "least"])
            often, step = hashes[first[everywhere]], max(1, (1 << 16) // chunks)
            for i in range(0, len(often), step):
                part = often[i : i + step]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(chunks, dtype="i4"), len(part))), pa.array(np.repeat(part, chunks))], ["chunk", "least"])
        common.give_back()

    posts = texts.select("text").mapInArrow(run, "least long, text long").repartition("least")  # narrow rows to the shuffle, most hashes are there once
    return posts.sortWithinPartitions("least").mapInArrow(shared, "chunk int, least long")


def _edges(texts: DataFrame, chunks: int, seed: int) -> DataFrame:
    """Edges of two documents or more: edge, doc, at (source coordinates), n (occurrences), following (31 bits of the next edge; 0: none, or several), chunks."""
    if chunks > 1 << CHUNK_BITS:
        raise ValueError(f"more than {1 << CHUNK_BITS} shuffle partitions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of four longs: the edge, its first document in the chunk, place there and what follows, and occurrences with the chunk's number."""
        wanted, parts = None, []
        for what, chunk, value in _Chunks(batches, 1):
            if what == "verdicts":
                wanted = Among(np.unique(value[0].view("u8")))
            elif what == "texts" and len(wanted.values):
                words = Words([raw for raw, *_ in value])
                grams, windows, whole = words.windows(seed)
                places = wanted(least(grams, WINDOW - GRAM + 1))[0] if len(windows) else np.empty(0, "i8")
                places = places[whole[places]]
                if len(places):
                    following = np.append(np.where(whole[1:], windows[1:] & np.uint64(0x7FFFFFFF), 0), np.uint64(0))
                    texts = words.owners()[places]
                    parts.append((windows[places].view("i8"), following[places].view("i8"), np.array([x[2] for x in value])[texts], places - words.bounds[texts]))
            elif what == "end" and parts:
                edge, following, doc, at = (np.concatenate(x) for x in zip(*parts))
                order = ordered(edge, doc, at)
                edge, following, doc, at = (x[order] for x in (edge, following, doc, at))
                first = np.flatnonzero(np.append(True, edge[1:] != edge[:-1]))
                n = np.diff(np.append(first, len(edge)))
                same = np.minimum.reduceat(following, first) == np.maximum.reduceat(following, first)
                several = doc[first] != doc[first + n - 1]
                columns = [edge[first], doc[first], at[first] << 31 | np.where(same, following[first], 0), (n * 2 + several) << CHUNK_BITS | chunk]
                order = np.lexsort((columns[2], columns[1]))  # by coordinates, as neighbours' columns are alike
                for i in range(0, len(first), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[order[i : i + (1 << 16)]]) for x in columns], ["edge", "doc", "place", "times"])
                parts = []
        common.give_back()

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_keys(batches):
            first = _starts(columns[0])
            n = np.diff(np.append(first, len(columns[0])))
            here = (columns[3] >> CHUNK_BITS & 1).astype(bool)
            apart = np.minimum.reduceat(columns[1], first) != np.maximum.reduceat(columns[1], first)
            stays = np.repeat(apart | np.logical_or.reduceat(here, first), n)
            edge, doc, place, times = (x[stays] for x in columns)
            if not len(edge):
                continue
            order = np.lexsort((place, doc, edge))
            edge, doc, place, times = (x[order] for x in (edge, doc, place, times))
            first, following = _starts(edge), place & 0x7FFFFFFF
            low = np.minimum.reduceat(following, first)
            following = np.where(low == np.maximum.reduceat(following, first), low, 0)
            total = np.add.reduceat(times >> (CHUNK_BITS + 1), first)
            # one row a chunk and edge: chunks are different already
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(edge)).astype("i4")), pa.array((times & ((1 << CHUNK_BITS) - 1)).astype("i4")))
            columns = [pa.array(x) for x in (edge[first], doc[first], place[first] >> 31, total, following)]
            yield pa.RecordBatch.from_arrays([*columns, lists], ["edge", "doc", "at", "n", "following", "chunks"])
        common.give_back()

    rows = _with_verdicts(texts, _posted(texts, chunks, seed), ["least"], chunks).mapInArrow(run, "edge long, doc long, place long, times long").repartition("edge")
    return rows.sortWithinPartitions("edge").mapInArrow(grouped, "edge long, doc long, at long, n long, following long, chunks array<int>")


def _paths(edges: DataFrame) -> DataFrame:
    """Non-branching paths: first (edge), doc, at (source coordinates), n (edges), chunks."""
    order = Window.partitionBy("doc").orderBy("at", "edge")  # no more than a document's windows
    low = F.expr("edge & 2147483647L")
    before = F.lag(F.struct("at", "n", "following")).over(order)
    linked = edges.select("*", low.alias("low"), before.alias("before"))
    goes_on = (F.col("before.at") == F.col("at") - 1) & (F.col("before.n") == F.col("n")) & (F.col("before.following") == F.col("low")) & (F.col("low") != 0)
    starts = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    numbered = linked.withColumn("path", F.sum(starts).over(order))
    head = F.min(F.struct("at", F.col("edge").alias("first"), "chunks")).alias("head")
    return numbered.groupBy("doc", "path").agg(head, F.count("*").alias("n")).select("head.first", "doc", "head.at", "n", "head.chunks")


def _cut(texts: DataFrame, chunks: int, seed: int) -> DataFrame:
    """Rows of documents (doc_id, n_words, n_removed, kept_sha256), one for each different text and its smallest id, and rows of occurrences (first, span: digest of the words of a path), where n_words is null."""
    paths = common.written(_paths(_edges(texts, chunks, seed)), "repeats-paths")
    verdicts = paths.select(F.explode("chunks").alias("chunk"), "first", "doc", "n")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, first long, span binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            paths, doc, n, spans = None, None, None, set()
            for what, _, value in _Chunks(batches, 3):
                if what == "verdicts":
                    order = np.argsort(value[0].view("u8"), kind="stable")
                    paths, doc, n = Among(value[0].view("u8")[order]), value[1][order], value[2][order]
                elif what == "end":
                    for edge, span in spans:
                        yield None, None, None, None, edge, span
                    spans = set()
                else:
                    words = Words([raw for raw, *_ in value])
                    _, windows, whole = words.windows(seed)
                    data, at = words.spaced()
                    bounds, ids = words.bounds, np.array([x[2] for x in value])
                    places, which = paths(windows)
                    places, which = places[whole[places]], which[whole[places]]
                    owners = words.owners()[places]
                    ends = np.minimum(places + n[which] + WINDOW - 1, bounds[owners + 1])
                    view = memoryview(data)
                    for edge, a, b in zip(paths.values[which].view("i8").tolist(), at[places].tolist(), (at[ends] - 1).tolist()):
                        spans.add((edge, xxhash.xxh3_128_digest(view[a:b])))
                    later = doc[which] < ids[owners]
                    removed = np.bincount(places[later], minlength=bounds[-1] + 1) - np.bincount(ends[later], minlength=bounds[-1] + 1)
                    stays = np.cumsum(removed[:-1]) == 0
                    gone = np.append(0, np.cumsum(~stays))
                    gone = gone[bounds[1:]] - gone[bounds[:-1]]
                    for i, (_, _, doc_id, times) in enumerate(value):
                        a, b = bounds[i], bounds[i + 1]
                        kept = data[at[a] : at[b]]
                        if gone[i]:
                            kept = kept[np.repeat(stays[a:b], np.diff(at[a : b + 1]))]
                        row = None if doc_id == _NO_ID else doc_id, int(b - a), int(gone[i]), hashlib.sha256(kept[:-1]).hexdigest(), None, None
                        for _ in range(times):
                            yield row

        yield from common.sliced(names, types, rows())

    return common.written(_with_verdicts(texts, verdicts, ["first", "doc", "n"], chunks).mapInArrow(run, schema), "repeats")


def _copies(texts: DataFrame) -> DataFrame:
    """Results of the documents whose text has a smaller id, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for block in _blocks((text.as_py(), doc_id) for batch in batches for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1))):
                for (raw, doc_id), n in zip(block, np.diff(Words([raw for raw, _ in block]).bounds).tolist()):
                    whole = n < WINDOW
                    yield hashlib.md5(raw).digest(), doc_id, n, 0 if whole else n, hashlib.sha256(b" ".join(raw.split())).hexdigest() if whole else _NOTHING

        yield from common.sliced(["digest", "doc_id", "n_words", "n_removed", "kept_sha256"], [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()], rows())

    rows = common.written(texts.mapInArrow(run, "digest binary, doc_id long, n_words long, n_removed long, kept_sha256 string"), "repeats-copies")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("__first"), F.count("*").alias("__rows")).where("__rows > 1")
    joined = common.join_hot(rows, first, "digest", "__rows", rows.count())
    return joined.where("doc_id > __first").select(F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    texts, chunks = _texts(docs), common.shuffle_partitions(docs.sparkSession)
    for seed in range(SEEDS):
        rows = _cut(texts, chunks, seed)
        spans = rows.where("span is not null").groupBy("first").agg(F.min("span").alias("a"), F.max("span").alias("b"))
        if spans.where("a <> b").isEmpty():
            own = rows.where("n_words is not null").select("doc_id", "n_words", "n_removed", "kept_sha256")
            return own.unionByName(_copies(texts))
    raise RuntimeError(f"hashes of windows collided under {SEEDS} seeds")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(common.documents(spark, sf_dir))


ORACLE = r"""WITH w AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT rid, doc_id, p, array_to_string(ws[p:p + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13)),
r AS (SELECT rid, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
c AS (SELECT DISTINCT rid, unnest(range(p, p + 13)) AS p FROM r),
k AS (SELECT w.rid, string_agg(w.x, ' ' ORDER BY w.p) AS kept, count(*) AS n FROM (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w) w ANTI JOIN c ON w.rid = c.rid AND w.p = c.p GROUP BY w.rid)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (rid)"""
