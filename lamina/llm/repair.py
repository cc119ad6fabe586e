"""Repair of damaged conversations at the least cost, by dynamic programming over a grammar of turns.

Four states say what has been kept so far: nothing, a system turn, a user turn, an assistant turn. Each row is a layer:
deleting it stays in a state, keeping or re-roling it moves to another, and a layer is closed by at most two insertions
(no state is further from any other). A state carries the least (cost, audit string); as the cost is a function of the
audit string, no audit is a prefix of another of the same cost, so the least strings of prefixes make the least whole.

A row is one of nine symbols (to be deleted, or one of four kinds of role, truncated or not), so the paths through a
stretch of at most CHUNK rows are a function of a short string, which a task remembers. Stretches are
chained by links instead of copied strings: a conversation of n rows costs O(n).

Conversations are dealt out by their ids. One that holds more rows than a partition's share (at most as many as there are
partitions, so their ids are broadcast) goes another way: equal rows are counted once, each text's first turn is found by an
aggregation, rows are dealt by ranges of (conversation, turn) and packed into chunks in the shared folder, and what is
brought together per conversation are the chunks' symbols and the audit, one character a row, as the result itself has
them. Its digest is taken over the chunks' repaired bytes in order; SHA-256 has no other way.

Defined cases: null roles and texts are one space, a null turn comes first and in no gap, and is one space in the text that
chooses the damage, as is a null conversation, which is one of its own; rows of one turn are in the order of role and text;
empty and blank texts are faults; repeated rows are duplicates; a conversation of which nothing is left has zeros, an
empty audit and the digest of the empty text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import common

CHUNK = 256  # rows whose paths are looked up at once
CHUNK_BYTES = 4 << 20
KEEP_TRUNCATED, REROLE, DELETE, INSERT = 3, 3, 4, 3
SPACE = " \t\n\x0b\x0c\r"
_MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}  # states: nothing, system, user, assistant
_NEXT = {0: (2, "user"), 1: (2, "user"), 3: (2, "user"), 2: (3, "assistant")}
_LEGAL = {"su", "ua", "au"}
_GOAL = (0, 3)


def _put(into: dict, state: int | None, cost: int, audit: str) -> None:
    if state is not None and (state not in into or (cost, audit) < into[state]):
        into[state] = cost, audit


def _closed(layer: dict) -> dict:
    for _ in range(2):
        for state, (cost, audit) in list(layer.items()):
            _put(layer, _NEXT[state][0], cost + INSERT, audit + "I")
    return layer


@functools.lru_cache(maxsize=1 << 15)
def paths(symbols: str, start: int) -> tuple[tuple[int, int, str], ...]:
    """(state, cost, audit) for each state that is reached from ``start`` (-1: the beginning, with its own insertions)."""
    layer = _closed({0: (0, "")}) if start < 0 else {start: (0, "")}
    for symbol in symbols:
        out: dict = {}
        own, more = symbol.lower(), KEEP_TRUNCATED if symbol.isupper() else 0
        for state, (cost, audit) in layer.items():
            _put(out, state, cost + DELETE, audit + "D")
            if symbol != "X":
                _put(out, _MOVES.get((state, own)), cost + more, audit + "K")
                for other in "ua":
                    if other != own:
                        _put(out, _MOVES.get((state, other)), cost + REROLE + more, audit + "R")
        layer = _closed(out)
    return tuple((state, cost, audit) for state, (cost, audit) in layer.items())


def _less(a: tuple, b: tuple) -> bool:
    """Whether the audit of one chain of (chain before, piece, state before) is less than that of another of as many links."""
    left, right = [], []
    while a is not b:
        left.append(a[1])
        right.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def chained(chunks: Iterable[str]) -> tuple[int, list[tuple[str, int]]]:
    """The least cost, and each chunk's part of the audit with the state before it."""
    front: dict[int, tuple[int, tuple | None]] = {-1: (0, None)}
    for symbols in chunks:
        after: dict[int, tuple[int, tuple]] = {}
        for start, (before, chain) in front.items():
            for state, cost, piece in paths(symbols, start):
                link = before + cost, (chain, piece, max(0, start))
                if state not in after or link[0] < after[state][0] or link[0] == after[state][0] and _less(link[1], after[state][1]):
                    after[state] = link
        front = after
    ends = [front[s] for s in _GOAL if s in front]
    if not ends:  # no rows at all
        return 0, []
    best = ends[0]
    for end in ends[1:]:
        if end[0] < best[0] or end[0] == best[0] and _less(end[1], best[1]):
            best = end
    cost, chain = best
    found = []
    while chain is not None:
        found.append((chain[1], chain[2]))
        chain = chain[0]
    return cost, found[::-1]


def pieces(symbols: str) -> list[str]:
    return [symbols[i : i + CHUNK] for i in range(0, len(symbols), CHUNK)]


def edited(symbols: str, rows: Iterable[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """Roles and texts after the audit's edits. ``rows`` has those of the symbols that aren't X."""
    symbol, row = iter(symbols), iter(rows)
    for edit in audit:
        role, text, kind = "", "", ""
        if edit != "I":
            kind = next(symbol)
            if kind != "X":
                role, text = next(row)
        if edit == "K":
            state = _MOVES[state, kind.lower()]
        elif edit in "RI":
            state, role = _NEXT[state]
        if edit != "D":
            yield role, text


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage, n (how often the row is there: 0, 1 or 2), kind (s, u, a or o: other) and fault (b: blank, t: truncated, or -)."""
    chosen = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), chosen.alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1).cast("long").alias("n"))
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    initial = F.substring("role", 1, 1)
    return rows.select("*", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("kind"), F.when(last == "", "b").when(last.isin(".", "!", "?"), "-").otherwise("t").alias("fault"))


_ORDER = ["turn", "role", "text"]  # ascending, nulls first
_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [x.split()[0] for x in _COUNTS.split(", ")]
_KINDS = [*[pa.int64()] * 6, pa.string(), pa.string()]


def _id_kind(df: DataFrame) -> tuple[str, pa.DataType]:
    name = dict(df.dtypes)["conv_id"]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    if name not in kinds:
        raise TypeError(f"conv_id is {name}; an integer or a string is asked for")
    return name, kinds[name]


def _whole(rows: DataFrame) -> DataFrame:
    """The repair of conversations each of which fits a task, a row each."""
    kind, arrow = _id_kind(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(conv_id, rows: list[tuple]) -> tuple:
            seen, symbols, kept, kinds, turns = set(), [], [], [], set()
            blank = duplicate = truncated = 0
            for turn, role, text, n, who, fault in rows:
                if n and turn is not None:
                    turns.add(turn)
                for _ in range(n):
                    kinds.append(who)
                    if fault == "b":
                        blank += 1
                        symbols.append("X")
                    elif (role, text) in seen:
                        duplicate += 1
                        symbols.append("X")
                    else:
                        seen.add((role, text))
                        truncated += fault == "t"
                        symbols.append(who.upper() if fault == "t" else who)
                        kept.append((role, text))
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            illegal = sum(a + b not in _LEGAL for a, b in zip(kinds, kinds[1:]))
            symbols = "".join(symbols)
            cost, parts = chained(pieces(symbols))
            audit = "".join(p for p, _ in parts)
            repaired = "\n".join(f"{role}:{text}" for role, text in edited(symbols, kept, audit, 0))
            return conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest()

        def found():
            begun, at, rows = False, None, []
            for batch in batches:
                for conv_id, *row in zip(*[c.to_pylist() for c in batch.columns]):
                    if begun and conv_id != at:
                        yield one(at, rows)
                        rows = []
                    begun, at = True, conv_id
                    rows.append(row)
            if begun:
                yield one(at, rows)

        yield from common.sliced(["conv_id", *_NAMES], [arrow, *_KINDS], found())

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)
    return dealt.select("conv_id", "turn", "role", "text", "n", "kind", "fault").mapInArrow(run, f"conv_id {kind}, {_COUNTS}")


def _chunks(rows: DataFrame) -> DataFrame:
    """Rows of large conversations in order, packed: id (ascending within a conversation), symbols, what faults and turns they have, and the roles and texts that aren't deleted for sure."""
    spark = rows.sparkSession
    kind, arrow = _id_kind(rows)
    once = common.written(rows.groupBy("conv_id", "turn", "role", "text", "kind", "fault").agg(F.sum("n").alias("n")).where("n > 0"), "repair-rows")
    key = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.when(F.col("conv_id").isNull(), "-").otherwise(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.lit(":"), F.col("text")).cast("binary"))
    keyed = once.withColumn("__key", key)
    turn = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = keyed.groupBy("__key").agg(F.min(turn).alias("__first"), F.count("*").alias("__rows"))
    total = once.count()
    flagged = common.join_hot(keyed, first, "__key", "__rows", total).withColumn("again", turn != F.col("__first"))
    ordered = flagged.repartitionByRange(common.shuffle_partitions(spark), F.col("conv_id"), *_ORDER).sortWithinPartitions("conv_id", *_ORDER)
    numbers = "blank long, duplicate long, truncated long, illegal long, low long, high long, turns long"
    schema = f"conv_id {kind}, id long, symbols string, first string, last string, {numbers}, roles array<string>, texts array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(conv_id, number, rows):
            symbols, roles, texts, turns, kinds = [], [], [], set(), []
            blank = duplicate = truncated = illegal = 0
            for turn, role, text, n, who, fault, again, _ in rows:
                if turn is not None:
                    turns.add(turn)
                if kinds and kinds[-1] + who not in _LEGAL:
                    illegal += 1
                kinds.append(who)
                illegal += n - 1  # a role after itself
                if fault == "b":
                    blank += n
                    symbols.append("X" * n)
                    continue
                duplicate += n - (not again)
                if again:
                    symbols.append("X" * n)
                    continue
                truncated += fault == "t"
                symbols.append((who.upper() if fault == "t" else who) + "X" * (n - 1))
                roles.append(role)
                texts.append(text)
            low, high = (min(turns), max(turns)) if turns else (None, None)
            return conv_id, rows[0][-1] << 32 | number, "".join(symbols), kinds[0], kinds[-1], blank, duplicate, truncated, illegal, low, high, len(turns), roles, texts

        def found():
            at, rows, size, number = None, [], 0, 0
            for batch in batches:
                for conv_id, *row in zip(*[c.to_pylist() for c in batch.columns]):
                    if rows and (conv_id != at or len(rows) == CHUNK or size > CHUNK_BYTES):
                        yield closed(at, number, rows)
                        rows, size, number = [], 0, number + 1
                    at = conv_id
                    rows.append(row)
                    size += len(row[2])
            if rows:
                yield closed(at, number, rows)

        names = [x.split()[0] for x in schema.split(", ")]
        types = [arrow, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 7, pa.list_(pa.string()), pa.list_(pa.string())]
        for row in found():  # a batch each: a chunk has up to 4 MB of texts
            yield from common.sliced(names, types, [row])

    packed = ordered.select("conv_id", "turn", "role", "text", "n", "kind", "fault", "again", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, schema)
    return common.written(packed, "repair-chunks")


def _large(rows: DataFrame) -> DataFrame:
    """The repair of conversations that are too large for a task."""
    kind, arrow = _id_kind(rows)
    chunks = _chunks(rows)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per chunk its part of the audit; the last one's row has the counts of the whole, too."""

        def one(conv_id, rows: list[tuple]):
            ids, symbols, first, last, blank, duplicate, truncated, illegal, low, high, turns = zip(*rows)
            some = [(a, b) for a, b in zip(low, high) if a is not None]
            gaps = some[-1][1] - some[0][0] + 1 - sum(turns) + sum(a[1] == b[0] for a, b in zip(some, some[1:])) if some else 0
            outside = sum(a + b not in _LEGAL for a, b in zip(last, first[1:]))
            at, owner = [], []
            for i, s in enumerate(symbols):
                parts = pieces(s)
                at += parts
                owner += [i] * len(parts)
            cost, found = chained(at)
            audits, states = [""] * len(ids), [None] * len(ids)
            gathered: list[list[str]] = [[] for _ in ids]
            for i, (audit, state) in zip(owner, found):
                gathered[i].append(audit)
                if states[i] is None:
                    states[i] = state
            for i, g in enumerate(gathered):
                audits[i] = "".join(g)
            for i in range(len(ids)):
                whole = (gaps, sum(blank), sum(duplicate), sum(truncated), sum(illegal) + outside, cost, "".join(audits)) if i + 1 == len(ids) else (None,) * 7
                yield conv_id, ids[i], audits[i], states[i] or 0, *whole

        def found():
            begun, at, rows = False, None, []
            for batch in batches:
                for conv_id, *row in zip(*[c.to_pylist() for c in batch.columns]):
                    if begun and conv_id != at:
                        yield from one(at, rows)
                        rows = []
                    begun, at = True, conv_id
                    rows.append(row)
            if begun:
                yield from one(at, rows)

        yield from common.sliced(["conv_id", "id", "part", "state", *_NAMES[:-1]], [arrow, pa.int64(), pa.string(), pa.int64(), *_KINDS[:-1]], found())

    symbols = chunks.select("conv_id", "id", "symbols", "first", "last", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns")
    counts = _COUNTS.rpartition(", ")[0]
    audits = common.written(symbols.repartition("conv_id").sortWithinPartitions("conv_id", "id").mapInArrow(fold, f"conv_id {kind}, id long, part string, state long, {counts}"), "repair-audits")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv_id, number, symbols, roles, texts, audit, state in zip(*[c.to_pylist() for c in batch.columns]):
                rows = [f"{role}:{text}" for role, text in edited(symbols, zip(roles, texts), audit, state)]
                if rows:
                    yield from common.sliced(["conv_id", "id", "repaired"], [arrow, pa.int64(), pa.binary()], [(conv_id, number, "\n".join(rows).encode())])

    joined = chunks.select("conv_id", "id", "symbols", "roles", "texts").join(audits.select("id", "part", "state"), "id")
    bytes_ = joined.select("conv_id", "id", "symbols", "roles", "texts", "part", "state").mapInArrow(apply, f"conv_id {kind}, id long, repaired binary")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            begun, at, sha = False, None, None
            for batch in batches:
                for conv_id, repaired in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if begun and conv_id != at:
                        yield at, sha.hexdigest()
                        begun = False
                    if begun:
                        sha.update(b"\n")
                    else:
                        begun, at, sha = True, conv_id, hashlib.sha256()
                    sha.update(repaired.as_py())
            if begun:
                yield at, sha.hexdigest()

        yield from common.sliced(["same", "sha"], [arrow, pa.string()], found())

    digests = bytes_.repartition("conv_id").sortWithinPartitions("conv_id", "id").select("conv_id", "repaired").mapInArrow(digest, f"same {kind}, sha string")
    wholes = audits.where("gaps is not null").drop("id", "part", "state")
    joined = wholes.join(digests, F.col("conv_id").eqNullSafe(F.col("same")), "left")
    return joined.select("conv_id", *_NAMES[:-1], F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias(_NAMES[-1]))


def repair(conversations: DataFrame, hot_rows: int = common.HOT_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation. ``hot_rows``: a conversation of fewer is never too large for a task."""
    spark = conversations.sparkSession
    sizes = conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    total = conversations.count()
    share = max(hot_rows, total // max(1, common.shuffle_partitions(spark)))
    hot = [r["conv_id"] for r in sizes.where(F.col("n") > share).collect()]  # no more than there are partitions
    rows = damaged(conversations)
    if not hot:
        return _whole(rows)
    kind, _ = _id_kind(conversations)
    named = F.broadcast(spark.createDataFrame([(x,) for x in hot], f"__hot {kind}"))
    same = F.col("conv_id").eqNullSafe(F.col("__hot"))
    large = rows.join(named, same, "left_semi")
    emptied = large.groupBy("conv_id").agg(F.sum("n").alias("n")).where("n = 0").select("conv_id")
    none = emptied.select("conv_id", *[F.lit(0).cast("long").alias(n) for n in _NAMES[:6]], F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias(_NAMES[-1]))
    return _whole(rows.join(named, same, "left_anti")).unionByName(_large(large)).unionByName(none)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
