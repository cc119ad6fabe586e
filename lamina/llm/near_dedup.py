"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. Every document becomes the set of its word shingles and a signature of COORDINATES minima. Equal
   sets are one class from here on, so groups of exact copies cost one row.
2. A class is posted under coordinate-value pairs, those that are rare in a sample first, and only under
   as many as it needs: one of ``rare`` rare places or more agrees where two classes are as
   alike as the threshold, so frequent pairs (of passages that many documents share) are skipped where
   there are as many rare ones, and of those the first ``posted()`` do (prefix and skip).
3. Within a list, collisions of two classes are the places on which their signatures agree; classes with
   ``matches`` of them or more are tied together. A list gives a forest, not all its pairs. One class of
   the sample stands for each frequent pair, and the first class of a list for lists of more
   than LIST classes: what is like it is tied to it. What is neither like it nor rare enough is
   posted again, under bands of several coordinates at once, more of them the more such classes there are.
4. What is tied together, directly or not, is a cluster, and the sets of its classes are compared in full
   there, in blocks of bounded size that all hold the cluster's best-tied class. What isn't linked to that
   class is looked up in an inverted index of the block's rarest shingles (two sets as alike as the threshold
   share one), and meets other blocks of its cluster only where signatures agree on ``matches`` places.
   Links are components' edges, again as forests.

At either threshold (op9: 3 words, 85 %; the pipeline's stage: 5 words, 80 %) a link of two texts that are exactly as
alike as that is missed with a probability of about 1e-5; of texts that are more alike, with less. The sample
decides about order and work only, not about results.

Defined cases: a null or blank text has no shingles, is linked with nothing and stands for
itself; a text of fewer words than a shingle has one shingle, all its words; sets of
up to five shingles (80 %: three) link to equal sets only, as no other can be 85 % alike; rows that repeat get
the component of their set, once each; different texts under one doc_id are one document's, so they
may be linked through it; a set that only rows of null ids hold is linked with nothing, and its
component is null; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm import common
from lamina.llm.bpe import slices
from lamina.llm.components import components

WORDS = 3  # of a shingle, in op9
STAGE_WORDS = 5  # of a shingle, in the pipeline
COORDINATES = 128
DEVIATIONS = 4.5  # by which places that agree may fall short of the threshold's share
MISS = 1e-5  # of a link at the threshold, by what isn't posted
SAMPLE = 20_000  # classes among which frequent pairs are looked for
FREQUENT = 8  # of them, at least, share a frequent pair
LIST = 1000  # classes of a list that are compared with each other
BANDS = (4, 8, 16)  # coordinates at once, where single ones don't tell classes apart
BLOCK_CLASSES = 2048
BLOCK_SHINGLES = 4_000_000
_MULTIPLY = np.random.default_rng(20240229).integers(1, 2**31, COORDINATES, dtype="u4") * np.uint32(2) + np.uint32(1)


@dataclass(frozen=True)
class Threshold:
    """The share in common from which two sets are linked."""

    numerator: int
    denominator: int

    @property
    def share(self) -> float:
        return self.numerator / self.denominator

    @property
    def matches(self) -> int:
        """Places of two signatures that agree, at least."""
        return math.floor(COORDINATES * self.share - DEVIATIONS * math.sqrt(COORDINATES * self.share * (1 - self.share)))

    @property
    def like(self) -> tuple[int, int]:
        """Places that agree with the class that stands for a list: tied to it; and settled by it, as whatever has ``matches`` with that is tied to it too."""
        settled = (self.matches + COORDINATES) // 2 - 8
        return self.matches + settled - COORDINATES, settled

    @property
    def rare(self) -> int:
        """Rare places that make frequent ones needless: even if all differences of the sets are in them, one agrees."""
        return next(r for r in range(1, COORDINATES + 1) if r > COORDINATES * (1 - self.share) and (COORDINATES * (1 - self.share) / r) ** r <= MISS)

    def posted(self, rare: np.ndarray) -> np.ndarray:
        """How many of so many rare places are posted; a few more than needed, as two classes needn't have the same ones."""
        agree = 1 - np.minimum(0.99, COORDINATES * (1 - self.share) / np.maximum(rare, 1))
        return np.where(rare >= self.rare, np.ceil(math.log(MISS) / np.log(1 - agree)) + 4, COORDINATES).astype("i8")

    def bands(self, width: int) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - self.share**width))


OP9 = Threshold(85, 100)
STAGE = Threshold(80, 100)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Per text the sorted hashes of its different shingles. Words end at ASCII white space; only A-Z are lower-cased."""
    start = 0
    for stop in slices(texts):
        split = pc.ascii_split_whitespace(pc.fill_null(texts.slice(start, stop - start).cast(pa.large_string()), ""))
        start = stop
        coded = split.flatten().dictionary_encode()
        hashes = np.array([xxhash.xxh3_64_intdigest(w.lower()) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()] or [0], "u8")  # bytes: A-Z alone become lower case
        filled = np.asarray(pc.greater(pc.binary_length(coded.dictionary), 0))
        codes = np.asarray(coded.indices)
        bounds = np.asarray(split.offsets) - split.offsets[0].as_py()
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = codes[first:last]
            own = own[filled[own]]
            h = hashes[own]
            n = min(words, len(h))
            if not n:
                yield h
                continue
            joined = np.full(len(h) - n + 1, n, "u8")
            for i in range(n):
                joined = mixed(joined * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
            yield np.unique(joined)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash."""
    least = np.full(COORDINATES, np.iinfo("u4").max, "u4")
    x = (shingles ^ (shingles >> np.uint64(32))).astype("u4")
    for start in range(0, len(x), 4096):
        h = _MULTIPLY[:, None] * x[None, start : start + 4096]
        h ^= h >> np.uint32(15)
        np.minimum(least, h.min(axis=1), out=least)
    return least


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null where empty), and the minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words)):
                    if not len(s):
                        yield doc_id, 0, None, None
                        continue
                    yield doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s).tobytes()

        yield from common.sliced(["doc_id", "n_shingles", "digest", "minima"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()], rows())

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, digest binary, minima binary")


def fixed_width(column: pa.Array, dtype: str) -> np.ndarray:
    """A matrix of binary values of one width."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def pairs(minima: np.ndarray) -> np.ndarray:
    """A number for each coordinate-value pair."""
    return mixed(minima.astype("u8") << np.uint64(8) | np.arange(COORDINATES, dtype="u8"))


def places(minima: np.ndarray) -> np.ndarray:
    """One byte of each minimum, enough to count collisions."""
    return minima.astype("u1")


def _binaries(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


class Frequent:
    """Pairs that are frequent in the sample, each with the class that stands for it."""

    def __init__(self, rows: list):
        value = np.array([r["value"] for r in rows], "i8").view("u8")
        order = np.argsort(value)
        hubs = {r["node"]: r["minima"] for r in rows}
        row = {node: i for i, node in enumerate(hubs)}
        self.value, self.hub = value[order], np.array([r["node"] for r in rows], "i8")[order]
        self.row = np.array([row[r["node"]] for r in rows], "i8")[order]
        self.places = places(np.array([np.frombuffer(m, "u4") for m in hubs.values()], "u4").reshape(-1, COORDINATES))

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, -1 for values that aren't frequent."""
        if not len(self.value):
            return np.full(values.shape, -1)
        at = np.minimum(np.searchsorted(self.value, values), len(self.value) - 1)
        return np.where(self.value[at] == values, at, -1)


def frequent_pairs(classes: DataFrame) -> Frequent:
    """Of a bounded sample; at most SAMPLE * COORDINATES / FREQUENT pairs can be frequent in it."""
    n = classes.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = classes.where((F.xxhash64("node", F.lit(9)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) < share).limit(2 * SAMPLE).select("node", "minima")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pairs(fixed_width(batch.column(1), "u4")).view("i8")
            yield pa.RecordBatch.from_arrays([pa.array(values.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), COORDINATES))], ["value", "node"])

    found = sample.mapInArrow(explode, "value long, node long").groupBy("value").agg(F.count("*").alias("n"), F.min("node").alias("node")).where(F.col("n") >= FREQUENT)
    hubs = found.select("node").distinct().join(sample, "node")
    minima = {r["node"]: bytes(r["minima"]) for r in hubs.collect()}
    return Frequent([{"value": r["value"], "node": r["node"], "minima": minima[r["node"]]} for r in found.collect()])


_POSTING = pa.schema([("value", pa.int64()), ("node", pa.int64()), ("places", pa.binary()), ("hub", pa.int64())])
_POSTED = "value long, node long, places binary, hub long"


def _rows(values, nodes, shown=None, hubs=None) -> pa.RecordBatch:
    n = len(nodes)
    none = lambda kind: pa.nulls(n, kind)
    return pa.RecordBatch.from_arrays([none(pa.int64()) if values is None else pa.array(values), pa.array(nodes), none(pa.binary()) if shown is None else shown, none(pa.int64()) if hubs is None else pa.array(hubs)], schema=_POSTING)


def postings(classes: DataFrame, frequent: Frequent, threshold: Threshold = OP9) -> DataFrame:
    """Lists' rows (value, node, places, null); ties to a frequent pair's class (null, node, null, hub); and (null, node, null, null) for what is to be posted under bands."""
    like, settled = threshold.like

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                nodes, minima = np.asarray(part.column(0)), fixed_width(part.column(1), "u4")
                values, shown = pairs(minima), places(minima)
                at = frequent.find(values)
                rare = (at < 0).sum(axis=1)
                post = (at < 0) & (np.cumsum(at < 0, axis=1) <= threshold.posted(rare)[:, None])
                row, column = np.nonzero(at >= 0)
                if len(row):
                    which, back = np.unique(row * len(frequent.places) + frequent.row[at[row, column]], return_inverse=True)
                    node, hub = np.divmod(which, len(frequent.places))
                    same = np.concatenate([(shown[node[i : i + 8192]] == frequent.places[hub[i : i + 8192]]).sum(axis=1) for i in range(0, len(which), 8192)])
                    tied = np.unique(np.stack([nodes[row], frequent.hub[at[row, column]]], axis=1)[same[back] >= like], axis=0)
                    tied = tied[tied[:, 0] != tied[:, 1]]
                    yield _rows(None, tied[:, 0], hubs=tied[:, 1])
                    by_hub = np.bincount(row[same[back] >= settled], minlength=len(nodes))  # pairs whose class settles it are as good as posted
                    yield _rows(None, nodes[rare + by_hub < np.minimum(threshold.rare, COORDINATES)])
                row, column = np.nonzero(post)
                yield _rows(values[row, column].view("i8"), nodes[row], _binaries(shown).take(pa.array(row)))

    return classes.select("node", "minima").mapInArrow(run, _POSTED)


def banded(classes: DataFrame, level: int, threshold: Threshold) -> DataFrame:
    """Lists' rows under bands of BANDS[level] coordinates."""
    width = BANDS[level]
    rng = np.random.default_rng(level)
    bands = np.stack([rng.permutation(COORDINATES)[:width] for _ in range(threshold.bands(width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                minima = fixed_width(part.column(1), "u4")
                value = np.broadcast_to(np.arange(len(bands), dtype="u8") + np.uint64(level << 32), (len(minima), len(bands)))
                for i in range(width):
                    value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + minima[:, bands[:, i]])
                row = np.repeat(np.arange(len(minima)), len(bands))
                yield _rows(value.ravel().view("i8"), np.asarray(part.column(0))[row], _binaries(places(minima)).take(pa.array(row)))

    return classes.select("node", "minima").mapInArrow(run, _POSTED)


def forest(nodes: np.ndarray, shown: np.ndarray, matches: int) -> list[tuple[int, int]]:
    """Edges that tie together what agrees on enough places, directly or not."""
    edges, left = [], np.arange(len(nodes))
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            node = reached.pop()
            alike = (shown[left] == shown[node]).sum(axis=1) >= matches
            new = left[alike]
            left = left[~alike]
            edges += [(int(nodes[node]), int(nodes[x])) for x in new]
            reached += new.tolist()
    return edges


class _List:
    """One list, read in parts. Beyond LIST classes the first one stands for it, and what that one settles isn't held; if more than LIST stay, all that stay are left open."""

    def __init__(self, threshold: Threshold, last: bool):
        self.threshold, self.last = threshold, last
        self.hub, self.held, self.rows, self.found, self.open, self.spilt = None, [], 0, [], [], False

    def add(self, part: pa.RecordBatch) -> None:
        if self.hub is not None:
            return self._reduce(part)
        self.held.append(part)
        self.rows += part.num_rows
        if self.rows > LIST:
            self.hub = self.held[0].column(1)[0].as_py(), fixed_width(self.held[0].column(2).slice(0, 1), "u1")
            parts, self.held, self.rows = self.held, [], 0
            for p in parts:
                self._reduce(p)

    def _reduce(self, part: pa.RecordBatch) -> None:
        like, settled = self.threshold.like
        nodes, same = np.asarray(part.column(1)), (fixed_width(part.column(2), "u1") == self.hub[1]).sum(axis=1)
        self.found += [(self.hub[0], x) for x in np.unique(nodes[same >= like]).tolist()]
        self.held.append(part.filter(pa.array(same < settled)))
        self.rows += self.held[-1].num_rows
        if self.rows > LIST and not self.last:
            self._spill()

    def _spill(self) -> None:
        self.open += [x for p in self.held for x in p.column(1).to_pylist()]
        self.held, self.rows, self.spilt = [], 0, True

    def close(self) -> pa.RecordBatch:
        if self.spilt:
            self._spill()
        for p in [pa.Table.from_batches(self.held)] if self.held else []:
            self.found += forest(np.asarray(p.column("node")), fixed_width(p.column("places"), "u1"), self.threshold.matches)
        return edges(self.found, self.open)


def edges(found: list, open_: list) -> pa.RecordBatch:
    unique, open_ = np.unique(np.array(found, "i8").reshape(-1, 2), axis=0), np.unique(np.array(open_, "i8"))
    return pa.RecordBatch.from_arrays([pa.array(np.append(unique[:, 0], open_)), pa.concat_arrays([pa.array(unique[:, 1]), pa.nulls(len(open_), pa.int64())])], ["a", "b"])


def ties(lists: DataFrame, threshold: Threshold = OP9, last: bool = False) -> DataFrame:
    """Columns a, b: the forests of all lists; b is null for what is to be posted under more coordinates. Lists are read as sorted runs of rows; one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, value = None, None  # the list that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.asarray(batch.column(0))
            starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            if current is not None and value == values[0]:
                end = int(starts[1]) if len(starts) > 1 else len(values)
                current.add(batch.slice(0, end))
                batch, starts = batch.slice(end), starts[1:] - end
                if not len(starts):
                    continue
            if current is not None:
                yield current.close()
            yield whole(batch.slice(0, int(starts[-1])), starts[:-1])
            current, value = _List(threshold, last), values[-1]
            current.add(batch.slice(int(starts[-1])))
        if current is not None:
            yield current.close()

    def whole(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        """Lists that begin and end in the batch."""
        nodes, column = np.asarray(rows.column(1)), rows.column(2)
        lengths = np.diff(np.append(starts, rows.num_rows))
        found, open_ = [], []
        two = starts[lengths == 2]
        for i in range(0, len(two), 8192):
            at = two[i : i + 8192]
            same = (fixed_width(column.take(pa.array(at)), "u1") == fixed_width(column.take(pa.array(at + 1)), "u1")).sum(axis=1) >= threshold.matches
            found += zip(nodes[at[same]].tolist(), nodes[at[same] + 1].tolist())
        for start, n in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist()):
            if n > LIST:
                one = _List(threshold, last)
                one.add(rows.slice(start, n))
                one.close()
                found, open_ = found + one.found, open_ + one.open
            else:
                found += forest(nodes[start : start + n], fixed_width(column.slice(start, n), "u1"), threshold.matches)
        return edges(found, open_)

    return lists.repartition("value").sortWithinPartitions("value").select("value", "node", "places").mapInArrow(run, "a long, b long")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def all_ties(classes: DataFrame, threshold: Threshold = OP9) -> DataFrame:
    """Columns a, b: what collides often enough, tied together."""
    rows = common.written(postings(classes, frequent_pairs(classes), threshold), "postings")
    found = [rows.where("hub is not null").select(F.col("node").alias("a"), F.col("hub").alias("b"))]
    made = common.written(ties(rows.where("value is not null"), threshold), "ties")
    used = [rows, made]
    open_ = rows.where("value is null and hub is null").select("node")
    for level in range(len(BANDS)):
        found.append(made.where("b is not null"))
        open_ = common.written(open_.union(made.where("b is null").select("a")).distinct(), "open")
        used.append(open_)
        if open_.isEmpty():
            break
        made = common.written(ties(banded(classes.join(open_, "node"), level, threshold), threshold, level == len(BANDS) - 1), "ties")
        used.append(made)
        open_ = made.where("b is null").select(F.col("a").alias("node"))
    else:
        found.append(made)
    tied = common.written(_union(found).where("a <> b").distinct(), "tied")
    for table in used:
        common.discard(table)
    return tied


def prefixes(flat: np.ndarray, sizes: np.ndarray, threshold: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the shingles that are rarest in the block, as many that two sets as alike as the threshold share one; and where each set's end."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((flat, np.bincount(flat)[flat], owner))
    bounds = np.append(0, np.cumsum(sizes))
    length = sizes + sizes * threshold.numerator // -threshold.denominator + 1
    kept = np.arange(len(flat)) - bounds[owner] < length[owner]
    return flat[order[kept]], np.cumsum(length)


def block_links(nodes: np.ndarray, sets: list[np.ndarray], hub: int | None, asked: np.ndarray | None = None, threshold: Threshold = OP9) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links within a block, and which classes aren't linked to its hub.

    All are compared with the hub, the rest with what shares one of the rarest shingles. With ``asked``, those are compared with all and nothing else is done.
    """
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.append(0, np.cumsum(sizes))
    mark = np.zeros(int(flat.max()) + 1, "i4")

    def linked(i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are linked with the one at ``i``."""
        others = others[(threshold.denominator * sizes[others] >= threshold.numerator * sizes[i]) & (threshold.denominator * sizes[i] >= threshold.numerator * sizes[others])]
        if not len(others):
            return others
        mark[flat[bounds[i] : bounds[i + 1]]] = 1
        starts = np.append(0, np.cumsum(sizes[others])[:-1])
        at = np.repeat(bounds[others] - starts, sizes[others]) + np.arange(sizes[others].sum())
        common_to = np.add.reduceat(mark[flat[at]], starts)
        mark[flat[bounds[i] : bounds[i + 1]]] = 0
        return others[threshold.denominator * common_to >= threshold.numerator * (sizes[others] + sizes[i] - common_to)]

    edges = []
    if asked is None:
        middle = int(np.flatnonzero(nodes == hub)[0]) if hub is not None and (nodes == hub).any() else int(np.argmax(np.add.reduceat(np.bincount(flat)[flat], bounds[:-1]) / sizes))
        near = linked(middle, np.arange(len(nodes)))
        edges += [(int(nodes[middle]), int(nodes[i])) for i in near if i != middle]
        rest = np.setdiff1d(np.arange(len(nodes)), near)
    else:
        rest = np.flatnonzero(asked)
    if not len(rest):
        return edges, nodes[rest]
    root = np.arange(len(nodes))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    rare, ends = prefixes(flat, sizes, threshold)
    by_shingle = np.argsort(rare, kind="stable")
    holder = np.searchsorted(ends, by_shingle, side="right")  # the set of each entry
    first = np.append(0, np.cumsum(np.bincount(rare, minlength=len(mark))))
    for i in rest.tolist():
        own = rare[ends[i - 1] if i else 0 : ends[i]]
        counts = first[own + 1] - first[own]
        at = np.repeat(first[own] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
        others = np.unique(holder[at])
        for j in linked(i, others[others != i]).tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((int(nodes[i]), int(nodes[j])))
    return edges, nodes[rest]


def _block(table: pa.Table, asked: bool, threshold: Threshold = OP9) -> pa.Table:
    names = table.column("node").to_pylist()
    raw = table.column("shingles").to_pylist()
    firsts = list({x: i for i, x in reversed(list(enumerate(zip(names, raw))))}.values())  # a node can have several sets
    nodes = np.array([names[i] for i in firsts], "i8")
    sets = [np.frombuffer(raw[i], "u8") for i in firsts]
    flags = np.array(table.column("asked").to_pylist())[firsts] if asked else None
    edges, rest = block_links(nodes, sets, table.column("hub")[0].as_py(), flags, threshold)
    return pa.table({"a": pa.array([a for a, _ in edges] + ([] if asked else rest.tolist()), pa.int64()), "b": pa.array([b for _, b in edges] + ([] if asked else [None] * len(rest)), pa.int64())})


def _near(table: pa.Table, threshold: Threshold) -> pa.Table:
    """The rows of a group that agree on enough places with one that is asked about, those included."""
    shown = places(fixed_width(table.column("minima"), "u4"))
    asked, sizes = np.array(table.column("asked").to_pylist(), bool), np.asarray(table.column("n_shingles"))
    kept, others = np.zeros(len(asked), bool), np.flatnonzero(~asked)
    for i in np.flatnonzero(asked).tolist():
        near = others[(shown[others] == shown[i]).sum(axis=1) >= threshold.matches]
        near = near[(threshold.denominator * sizes[near] >= threshold.numerator * sizes[i]) & (threshold.denominator * sizes[i] >= threshold.numerator * sizes[near])]
        kept[near] = True
        kept[i] = len(near) > 0
    return table.filter(pa.array(kept)).select(["cluster", "block", "chunk", "node", "asked"])


def links(docs: DataFrame, clusters: DataFrame, words: int = WORDS, threshold: Threshold = OP9) -> DataFrame:
    """Columns a, b: links confirmed on full sets, as forests. clusters: node, digest, n_shingles, minima, cluster, hub, and the cluster's number of blocks."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                others = [batch.column(i).to_pylist() for i in range(5)]
                for node, digest, cluster, hub, blocks, s in zip(*others, shingle_sets(batch.column(5), words)):
                    if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest:
                        yield cluster, node, hub, blocks, s.tobytes()

        yield from common.sliced(["cluster", "node", "hub", "blocks", "shingles"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], rows())

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    members = clusters.select("node", "digest", "cluster", "hub", "blocks").join(texts, "node").select("node", "digest", "cluster", "hub", "blocks", "text")
    members = common.written(members.mapInArrow(sets, "cluster long, node long, hub long, blocks long, shingles binary"), "sets")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    own = members.where("node <> hub or blocks = 1").withColumn("block", F.when(F.col("blocks") == 1, F.lit(0)).otherwise(block))
    hubs = members.where("node = hub and blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    found = common.written(own.unionByName(hubs).groupBy("cluster", "block").applyInArrow(lambda t: _block(t, False, threshold), "a long, b long"), "links")
    inside = found.where("b is not null")
    split = common.written(clusters.where("blocks > 1").select("cluster", "node", "n_shingles", "minima", "blocks"), "split")
    apart = split.join(found.where("b is null").select(F.col("a").alias("node")).distinct(), "node")
    counts = common.written(apart.groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_CLASSES)).alias("chunks")).join(split.groupBy("cluster").agg(F.count("*").alias("members")), "cluster"), "counts")
    total = counts.agg(F.sum("members")).first()[0]
    if not total:
        return inside
    chunk = F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    base = common.join_hot(split, counts, "cluster", "members", total).withColumn("block", block).withColumn("chunk", every(F.col("chunks"))).withColumn("asked", F.lit(False))
    queries = common.join_hot(apart.select(*split.columns), counts, "cluster", "members", total).withColumn("block", every(F.col("blocks"))).withColumn("chunk", chunk).withColumn("asked", F.lit(True))
    columns = ["cluster", "block", "chunk", "node", "n_shingles", "minima", "asked"]
    groups = queries.select(columns).unionByName(base.select(columns)).groupBy("cluster", "block", "chunk")
    near = groups.applyInArrow(lambda t: _near(t, threshold), "cluster long, block long, chunk long, node long, asked boolean")
    both = near.join(members.select("node", "hub", "shingles"), "node")
    across = both.groupBy("cluster", "block", "chunk").applyInArrow(lambda t: _block(t.sort_by([("asked", "descending")]), True, threshold), "a long, b long")
    return inside.unionByName(across)


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: Threshold = OP9) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    signed = common.written(signatures(docs, words), "signatures")
    classes = signed.where("digest is not null").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("node"), F.min("minima").alias("minima"), F.count("*").alias("copies"))
    classes = common.written(classes, "classes")
    least = next(n for n in range(1, 10_000) if threshold.denominator * n >= threshold.numerator * (n + 1))
    tied = all_ties(classes.where((F.col("n_shingles") >= least) & F.col("node").isNotNull()), threshold)
    cluster = components(tied).withColumnRenamed("component", "cluster")
    degree = tied.select(F.col("a").alias("node")).union(tied.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
    member = common.written(cluster.join(classes.select("node", "digest", "n_shingles", "minima"), "node").join(degree, "node"), "members")
    whole = member.groupBy("cluster").agg(F.max_by("node", F.struct("degree", "node")).alias("hub"), F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"), F.count("*").alias("members"))
    found = links(docs, common.join_hot(member, whole, "cluster", "members", member.count()), words, threshold)
    component = components(found).withColumnRenamed("component", "component_id")
    named = classes.select("digest", "node", "copies").join(component, "node", "left").select("digest", F.coalesce("component_id", "node").alias("component_id"), "copies")
    rows = signed.select("doc_id", "n_shingles", "digest")
    out = common.join_hot(rows.where("digest is not null"), named, "digest", "copies", rows.count()).unionByName(rows.where("digest is null").withColumn("component_id", F.lit(None).cast("long")))
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


def near_dedup_stage(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, the one of the least id (one row of it, where rows repeat; of null ids, one row of each text).

    Different texts of one id are documents of their own here, numbered by a hash of both.
    """
    text, columns = F.xxhash64("text"), docs.columns
    several = docs.where("doc_id is not null").groupBy("doc_id").agg((F.min(text) != F.max(text)).alias("__several")).where("__several")
    if several.isEmpty():
        docs = docs.withColumn("__node", F.col("doc_id").cast("long"))
    else:
        docs = docs.join(several, "doc_id", "left").withColumn("__node", F.when(F.col("__several"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long")))
    found = near_duplicates(docs.select(F.col("__node").alias("doc_id"), "text"), STAGE_WORDS, STAGE).where("kept").select("doc_id").distinct()
    order = Window.partitionBy("__node", F.when(F.col("__node").isNull(), text)).orderBy(text)
    one = docs.join(found.withColumnRenamed("doc_id", "__kept"), F.col("__node").eqNullSafe(F.col("__kept")), "left_semi")
    return one.withColumn("__row", F.row_number().over(order)).where("__row = 1").select(*[F.col(f"`{c}`") for c in columns])
