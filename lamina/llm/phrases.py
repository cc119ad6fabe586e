"""Collocated phrases from vertical lists of positions.

Texts are dealt into segments, and the lists of a segment's frequent phrases, each the positions of one phrase in order, stay
in its row of a written table. The lengths of a phrase's lists add up to its exact frequency. Level by level:

1. Words are counted by segment; those of LEAST occurrences or more in their language get an id (a hash that is checked to be
   unique), and every segment learns the ids of its own and lists their positions.
2. Lists of phrases of k words are merge-joined with those of the phrases that start a word later. Of the phrases of
   k + 1 words that come out, only the names and the lengths of the lists leave the segment, packed by buckets of names.
3. A bucket adds up the lengths and tells the segments which of their phrases are frequent; those are kept as the next level's lists. Both
   parts of a frequent phrase are frequent, so nothing else is looked at again, and texts aren't read any more.

A task has a segment or a bucket. A phrase sends one number for each segment that has it, however often it is there. Phrases
are scored by joins of the tables of frequent phrases: each knows the frequencies of all its beginnings and endings.

Defined cases: a null or empty text has no words; a null language is ``und``; a language without candidates has no rows;
repeated rows count as often as they are there; a phrase that overlaps itself counts at every position; equal scores are
ordered by frequency, then by the phrase's bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm import common

LEAST, LONGEST, TOP = 100, 5, 2000
SEEDS = 5
BREAK = b"\xff"  # between pieces; no byte of UTF-8
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")


def tokens(raw: bytes) -> list[bytes]:
    """Words, and BREAK between pieces."""
    return raw.translate(_FOLD).replace(b"\n", b" \xff ").split()


def _segments(docs: DataFrame, segments: int) -> DataFrame:
    """segment, place (orders the texts of a segment), lang, size and the packed text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"), F.xxhash64("doc_id", "text", "lang").alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)

        def rows():
            for batch in batches:
                for lang, text, place in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    raw = text.as_py()
                    yield place % segments, place, lang, len(raw), codec.compress(raw, asbytes=True)

        yield from common.sliced(["segment", "place", "lang", "size", "packed"], [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary()], rows())

    return rows.mapInArrow(run, "segment int, place long, lang string, size long, packed binary")


def _unpacked(codec: pa.Codec, size: int, packed: pa.Scalar) -> bytes:
    return codec.decompress(packed.as_buffer(), size, asbytes=True) if size else b""


def word_id(lang: bytes, word: bytes, seed: int) -> int:
    """A signed 64-bit hash of a word of a language."""
    return int.from_bytes(xxhash.xxh3_64_digest(lang + BREAK + word, seed), "little", signed=True)


def _words(texts: DataFrame, segments: int, seed: int) -> DataFrame:
    """segment, lang, id, n: of a segment's words by id, lang null; and of all its words of a language, id null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")

        def rows():
            at, counts = None, {}
            for batch in batches:
                for segment, lang, size, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                    if segment != at:
                        yield from counted(at, counts)
                        at, counts = segment, {}
                    counts.setdefault(lang, Counter()).update(tokens(_unpacked(codec, size, packed)))
            yield from counted(at, counts)

        def counted(segment, counts):
            for lang, found in counts.items():
                found.pop(BREAK, None)
                if found:
                    yield segment, lang, None, sum(found.values())
                name = lang.encode()
                for word, n in found.items():
                    yield segment, None, word_id(name, word, seed), n

        yield from common.sliced(["segment", "lang", "id", "n"], [pa.int32(), pa.string(), pa.int64(), pa.int64()], rows())

    dealt = texts.repartitionById(segments, F.col("segment")).sortWithinPartitions("segment")
    return dealt.select("segment", "lang", "size", "packed").mapInArrow(run, "segment int, lang string, id long, n long")


_STATE = "segment int, n long, ids binary, places binary, numbers binary, langs array<string>, words array<string>"


def _state(codec: pa.Codec, segment: int, ids: np.ndarray, places: np.ndarray, numbers: np.ndarray, names: list[tuple[str, str]] | None = None) -> pa.RecordBatch:
    """A segment's lists: at each place, in order, the number of its phrase among the ids. Words come with their names."""
    packed = [codec.compress(x.tobytes(), asbytes=True) for x in (np.diff(places, prepend=0).astype("<i4"), numbers.astype("<i4"))]
    return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([len(places)], pa.int64()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), *[pa.array([x], pa.binary()) for x in packed], *[pa.array([names and [x[i] for x in names]], pa.list_(pa.string())) for i in (0, 1)]], ["segment", "n", "ids", "places", "numbers", "langs", "words"])


def _lists(codec: pa.Codec, n: int, ids: pa.Scalar, places: pa.Scalar, numbers: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _state() packed: ids, places, numbers."""
    steps, found = (np.frombuffer(_unpacked(codec, 4 * n, x), "<i4") for x in (places, numbers))
    return np.frombuffer(ids.as_py(), "<i8"), np.cumsum(steps, dtype="i8"), found.astype("i8")


def _first_lists(texts: DataFrame, words: DataFrame, segments: int, seed: int) -> DataFrame:
    """The lists of frequent words."""
    none = lambda **kinds: [F.lit(None).cast(t).alias(n) for n, t in kinds.items()]
    a = words.where("id is not null").select("segment", F.lit(0).alias("kind"), *none(place="long", lang="string", packed="binary"), "id")
    b = texts.select("segment", F.lit(1).alias("kind"), "place", "lang", "packed", F.col("size").alias("id"))
    dealt = a.unionByName(b).repartitionById(segments, F.col("segment")).sortWithinPartitions("segment", "kind", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)

        class Numbers(dict):
            """Of a language's words, from 1; 0 for those that aren't frequent, and for breaks. A word is hashed when it is first seen."""

            def __init__(self, lang: str):
                super().__init__({BREAK: 0})
                self.lang, self.name = lang, lang.encode()

            def __missing__(self, word: bytes) -> int:
                number = 0
                if (found := word_id(self.name, word, seed)) in wanted:
                    ids.append(found)
                    names.append((self.lang, word.decode()))
                    number = len(ids)
                self[word] = number
                return number

        at, wanted, known, ids, names, parts = None, set(), {}, [], [], []

        def listed():
            if parts:
                number = np.concatenate(parts)
                places = np.flatnonzero(number)
                yield _state(codec, at, np.array(ids, "i8"), places, number[places] - 1, names)

        for batch in batches:
            for segment, kind, lang, packed, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist()):
                if segment != at:
                    yield from listed()
                    at, wanted, known, ids, names, parts = segment, set(), {}, [], [], []
                if kind == 0:
                    wanted.add(n)
                elif wanted:
                    if lang not in known:
                        known[lang] = Numbers(lang)
                    found = tokens(_unpacked(codec, n, packed))
                    parts.append(np.fromiter(map(known[lang].__getitem__, found), "i4", len(found)))
                    parts.append(np.zeros(1, "i4"))
        yield from listed()
        common.give_back()

    return dealt.select("segment", "kind", "lang", "packed", "id").mapInArrow(run, _STATE)


def _mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A hash of two ids, as an unsigned 64-bit number."""
    with np.errstate(over="ignore"):
        x = a.view("u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + b.view("u8")
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _arrays(offsets: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v)) for v in values]


def _neighbours(places: np.ndarray, numbers: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge-join of the lists with those one place further: the pairs' names, and where they begin. A place has one phrase of a length."""
    both = np.flatnonzero(places[1:] == places[:-1] + 1)
    return numbers[both] * width + numbers[both + 1], places[both]


def _lengths(lists: DataFrame, buckets: int) -> DataFrame:
    """Names (a, b: ids of the two parts) and lengths n of the lists that are one word longer: arrays, a row for each bucket and segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for segment, n, *packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:]):
                ids, places, numbers = _lists(codec, n, *packed)
                key, count = np.unique(_neighbours(places, numbers, len(ids))[0], return_counts=True)
                a, b = ids[key // max(1, len(ids))], ids[key % max(1, len(ids))]
                bucket = (_mixed(a, b, 0) % np.uint64(buckets)).astype("i4")
                order = np.argsort(bucket, kind="stable")
                a, b, count, bucket = a[order], b[order], count[order], bucket[order]
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, "i8")
                ends = np.append(first, len(bucket))
                for i in range(0, len(first), 256):
                    some = ends[i : i + 257]
                    part = slice(some[0], some[-1])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[some[:-1]]), pa.array(np.full(len(some) - 1, segment, "i4")), *_arrays(some - some[0], a[part], b[part], count[part].astype("i4"))], ["bucket", "segment", "a", "b", "n"])
        common.give_back()

    return lists.select("segment", "n", "ids", "places", "numbers").mapInArrow(run, "bucket int, segment int, a array<long>, b array<long>, n array<int>")


def _frequent_pairs(lengths: DataFrame, buckets: int, least: int, salt: int) -> DataFrame:
    """segment and arrays a, b, id, f of its frequent phrases; the rows of segment -1 have each phrase once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            parts.append([np.repeat(batch.column(0).to_numpy(), sizes), *[batch.column(i).flatten().to_numpy() for i in (1, 2, 3)]])
        if not parts:
            return
        segment, a, b, n = (np.concatenate(x) for x in zip(*parts))
        n = n.astype("i8")
        order = np.lexsort((segment, b, a))
        segment, a, b, n = (x[order] for x in (segment, a, b, n))
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, "i8")
        total = np.add.reduceat(n, first) if len(a) else n
        size = np.diff(np.append(first, len(a)))
        kept = np.flatnonzero(total >= least)
        rows = np.flatnonzero(np.repeat(total >= least, size))
        f = np.repeat(total, size)
        segment = np.append(segment[rows], np.full(len(kept), -1, "i4"))
        a, b, f = np.append(a[rows], a[first[kept]]), np.append(b[rows], b[first[kept]]), np.append(f[rows], total[kept])
        order = np.argsort(segment, kind="stable")
        segment, a, b, f = (x[order] for x in (segment, a, b, f))
        starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(segment) else np.empty(0, "i8")
        ends, ids = np.append(starts, len(segment)), _mixed(a, b, salt).view("i8")
        for i in range(0, len(starts), 256):
            some = ends[i : i + 257]
            part = slice(some[0], some[-1])
            yield pa.RecordBatch.from_arrays([pa.array(segment[some[:-1]].astype("i4")), *_arrays(some - some[0], a[part], b[part], ids[part], f[part])], ["segment", "a", "b", "id", "f"])
        common.give_back()

    dealt = lengths.repartitionById(buckets, F.col("bucket")).select("segment", "a", "b", "n")
    return dealt.mapInArrow(run, "segment int, a array<long>, b array<long>, id array<long>, f array<long>")


def _longer(lists: DataFrame, frequent: DataFrame, segments: int) -> DataFrame:
    """The lists of frequent phrases that are one word longer."""
    arrays = [F.lit(None).cast("array<long>").alias(n) for n in ("a", "b", "id")]
    binaries = [F.lit(None).cast("binary").alias(n) for n in ("ids", "places", "numbers")]
    verdicts = frequent.where("segment >= 0").select("segment", F.lit(0).alias("kind"), "a", "b", "id", F.lit(0).cast("long").alias("n"), *binaries)
    own = lists.select("segment", F.lit(1).alias("kind"), *arrays, "n", "ids", "places", "numbers")  # names aren't needed any more
    dealt = verdicts.unionByName(own).repartitionById(segments, F.col("segment")).sortWithinPartitions("segment", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, at, parts = pa.Codec("zstd", 1), None, []
        for batch in batches:
            for i, (segment, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if segment != at:
                    at, parts = segment, []
                if kind == 0:
                    parts.append([batch.column(2 + j)[i].values.to_numpy() for j in range(3)])
                    continue
                if not parts:
                    continue
                a, b, new = (np.concatenate(x) for x in zip(*parts))
                ids, places, numbers = _lists(codec, batch.column(5)[i].as_py(), *[batch.column(6 + j)[i] for j in range(3)])
                order = np.argsort(ids, kind="stable")
                left, right = (order[np.searchsorted(ids[order], x)] for x in (a, b))
                name = left * len(ids) + right
                by_name = np.argsort(name)
                name, new = name[by_name], new[by_name]
                pairs, begin = _neighbours(places, numbers, len(ids))
                found = np.minimum(np.searchsorted(name, pairs), len(name) - 1)
                hit = name[found] == pairs
                yield _state(codec, segment, new, begin[hit], found[hit])
        common.give_back()

    return dealt.mapInArrow(run, _STATE)


def _levels(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """lang and n (all words); and per length its frequent words (id, lang, word, f) or phrases (a, b: ids of all words but the last, or the first; id, f)."""
    segments = common.shuffle_partitions(docs.sparkSession)
    texts = _segments(docs, segments)
    of_word = Window.partitionBy("lang", "id")
    for seed in range(SEEDS):
        counted = _words(texts, segments, seed).withColumn("f", F.sum("n").over(of_word))
        words = common.written(counted.where((F.col("f") >= least) | F.col("lang").isNotNull()), "phrases-words")
        lists = common.written(_first_lists(texts, words, segments, seed), "phrases-lists")
        named = lists.select(F.explode(F.arrays_zip("langs", "words")).alias("x")).groupBy("x.langs", "x.words").count().select(F.col("langs").alias("lang"), F.col("words").alias("word"))
        named = named.withColumn("id", F.arrow_udf(_ids(seed), "long")("lang", "word"))
        found = [common.written(words.where("id is not null").groupBy("id").agg(F.max("f").alias("f")).join(named, "id"), "phrases-named")]
        total = common.written(words.where("id is null").groupBy("lang").agg(F.max("f").alias("n")), "phrases-total")
        common.discard(words)
        for level in range(2, longest + 1):
            frequent = common.written(_frequent_pairs(_lengths(lists, segments), segments, least, seed * 16 + level), "phrases-frequent")
            found.append(frequent.where("segment = -1").select(F.explode(F.arrays_zip("a", "b", "id", "f")).alias("x")).select("x.*"))
            before = lists
            if level < longest:
                lists = common.written(_longer(lists, frequent, segments), "phrases-lists")
            common.discard(before)
        if all(t.groupBy("id").count().where("count > 1").isEmpty() for t in found):
            return total, found
    raise RuntimeError(f"ids collided under {SEEDS} seeds")


def _ids(seed: int):
    def ids(langs: pa.Array, words: pa.Array) -> pa.Array:
        return pa.array([word_id(lang.encode(), word.encode(), seed) for lang, word in zip(langs.to_pylist(), words.to_pylist())], pa.int64())

    ids.__annotations__ = {"langs": pa.Array, "words": pa.Array, "return": pa.Array}
    return ids


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    n, (words, *longer) = _levels(docs, least, longest)
    before = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails"))
    candidates, tables = None, []
    for table in longer:
        ahead = before.select(F.col("id").alias("a"), "lang", "phrase", "heads")
        behind = before.select(F.col("id").alias("b"), "last", "tails")
        whole = table.join(ahead, "a").join(behind, "b")
        before = common.written(whole.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails")), "phrases-named")
        tables.append(before)
    for table, next_ in zip(tables, [*longer[1:], None]):
        rows = table.withColumn("a", F.element_at("heads", -1))
        if next_ is not None:
            inside = next_.select(F.explode(F.array("a", "b")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            rows = rows.join(inside, "id", "left").where("longer is null or 100 * longer < 100 * a")
        rows = rows.select("lang", "phrase", "a", "heads", "tails")
        candidates = rows if candidates is None else candidates.unionByName(rows)
    cut = """array_min(transform(sequence(1, size(heads) - 1), k -> named_struct(
        'score', (cast(1000 * a as decimal(20, 0)) * cast(n as decimal(17, 0))) div (cast(heads[k - 1] as decimal(18, 0)) * cast(tails[size(tails) - k - 1] as decimal(18, 0))),
        'k', k, 'l', heads[k - 1], 'r', tails[size(tails) - k - 1])))"""
    scored = candidates.join(n, "lang").withColumn("cut", F.expr(cut)).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # what ranks below ``top`` in a task goes before the shuffle
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.documents(spark, sf_dir))


def oracle(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) AS phrase FROM w WHERE len(ws) >= {k}" for k in range(1, longest + 1))
    return rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM ({runs}) GROUP BY ALL HAVING count(*) >= {least}),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.k, c.f AS a, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:], ' ') AS y FROM c, unnest(range(1, c.k)) AS u(j)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.k, a, j, fl.f AS l, fr.f AS r, n, CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(fl.f AS HUGEINT) * fr.f) AS BIGINT) AS score
  FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = x JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = y JOIN t ON t.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.f >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT * FROM (SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score FROM kept) WHERE rank <= {top}"""
