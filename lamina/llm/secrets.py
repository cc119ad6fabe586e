"""Secret scans in column expressions: patterns, and entropy of sliding windows.

Candidates are runs of 20 or more characters of the base-64 alphabets; placeholders, an inner '=' and a
separator beside a hexadecimal run cut them. Over every candidate a window slides. It keeps a count of each
character, one byte per character of the alphabet; a step changes the counts of the character that enters
and the one that leaves, and with them the sum of c * log2(c), which gives the window's Shannon
entropy. A candidate is of class hex or base64, each with its own threshold; what its windows above
the threshold cover becomes a span, whether or not a pattern has found it too, unless the allow list knows the candidate.

The cost grows with the text and the number of matches, not their product: positions are sums over
blocks of matches, and texts are put together from blocks too.

Defined cases: a null text counts as empty; an empty text has no spans, and the digest of the
empty string; spans of one start are in the order of KINDS; repeated rows are scanned each; a
null doc_id is carried; other columns of the input are not read by scan() and kept by find(), which takes
over the names __base and __spans, and those that begin with __m_, __s_, __v_ or __c_.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import common

#: Kinds of spans, in their order.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 8
#: Runs are matched whole, so a least length in the pattern keeps and drops the same matches as one asked for afterwards.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Bits a character: random digits of base 16 and characters of base 64 are above in windows of 20, words and counters below.
HEX_BITS, BASE64_BITS = 2.9, 3.7
#: What cuts a candidate, the candidates without a secret (numbers, UUIDs, identifiers made of words), and letters that aren't words for the change of their cases.
PLACEHOLDER = r"(?i:example|sample|placeholder|dummy|changeme|your[_-]?(?:key|token|secret)|abcdefghij|0123456789)|([A-Za-z0-9+/_=-])\1{5,}"
PLAIN = r"^[0-9+/_=-]+$|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
WORDS = r"^[A-Za-z+/_=-]+$|^[A-Za-z]{2,}[0-9]{0,4}(?:[/_=+-]+(?:[A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,8}))*[/_=+-]*$"
JUMBLED = r"[A-Z][a-z](?=[A-Z]).*[A-Z][a-z](?=[A-Z])"
_ASSIGNED = r"=(?=[A-Za-z0-9+/_-])"
_BEFORE_HEX, _AFTER_HEX = r"[/_+-](?=[0-9a-fA-F]{20,}(?![A-Za-z0-9]))", r"(?<![A-Za-z0-9])([0-9a-fA-F]{20,}+)[/_+-]"
_SPAN = "struct<start:int,kind:int,end:int>"
_NONE = f"cast(array() as array<{_SPAN}>)"
BLOCK = 256  # elements of an array, or characters of a text, that are worked on at once
_ALPHABET = 128  # characters that can be counted: all of ASCII


def let(value: Column, f) -> Column:
    """f of a value that is evaluated once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _blocks(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / BLOCK), F.lit(0)).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def running(values: Column, combine, start: Column, levels: int = 3) -> Column:
    """For each element of an array the combination of all before it. An array grows only within its block, so the cost is that of one block per element."""

    def inside(block: Column) -> Column:
        none = F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(block, none, lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def blockwise(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, start, combine))
        before = running(whole, combine, start, levels - 1)
        return let(before, lambda s: F.flatten(F.zip_with(blocks, s, lambda block, x: F.transform(inside(block), lambda y: combine(x, y)))))

    if levels == 1:
        return inside(values)
    return let(values, lambda v: F.when(F.size(v) <= BLOCK, inside(v)).otherwise(let(_blocks(v), blockwise)))


def _total(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _matches(df: DataFrame, kept: list[Column], text: str, patterns: dict[str, str], value: str | None = None) -> DataFrame:
    """Adds __m_<kind>, the matches of each pattern as (start, end, text), code points counted by the pieces and matches before; and with ``value`` the second group of that kind's matches as v."""
    found = {k: F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for k, p in patterns.items()}
    df = df.select(*kept, *([F.col(text)] if text.startswith("__") else []), *[c.alias(f"__m_{k}") for k, c in found.items()], *([F.regexp_extract_all(F.col(text), F.lit(patterns[value]), F.lit(2)).alias("__v")] if value else []))
    gaps = {k: F.zip_with(F.slice(F.split(F.col(text), p, -1), F.lit(1), F.size(f"__m_{k}")), F.col(f"__m_{k}"), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), m.alias("t"))) for k, p in patterns.items()}
    df = df.select(*kept, *(["__v"] if value else []), *[F.when(F.size(f"__m_{k}") > 0, g).otherwise(F.expr("cast(array() as array<struct<gap:int,n:int,t:string>>)")).alias(f"__m_{k}") for k, g in gaps.items()])
    df = df.select("*", *[running(F.transform(f"__m_{k}", lambda x: x["gap"] + x["n"]), _total, F.lit(0)).alias(f"__s_{k}") for k in patterns])
    place = lambda x, s: F.struct((s + x["gap"]).alias("start"), (s + x["gap"] + x["n"]).alias("end"), x["t"].alias("t"))
    df = df.select(*kept, *(["__v"] if value else []), *[F.zip_with(f"__m_{k}", f"__s_{k}", place).alias(f"__m_{k}") for k in patterns])
    return df.withColumn(f"__m_{value}", F.zip_with(f"__m_{value}", "__v", lambda m, v: m.withField("v", v))).drop("__v") if value else df


def hot_range(candidate: Column, bits: Column, window: int = WINDOW) -> Column:
    """Start and end in an ASCII candidate (struct of ints, end exclusive) of what windows of at least ``bits`` cover; null where there are none.

    The counts are a string, in which the character at a place says how often the one of that number is in the window.
    """
    zero = 33  # stands for no occurrence
    sums = [c * math.log2(c) if c else 0.0 for c in range(window + 2)]
    more = F.array(*[F.lit(b - a) for a, b in zip(sums, sums[1:])])  # what one more of c adds to the sum of c * log2(c)

    def count(counts: Column, place: Column) -> Column:
        return F.ascii(F.substring(counts, place, F.lit(1))) - zero

    def enter(acc: Column, place: Column, counts: Column, s: Column) -> Column:
        def entered(x: Column) -> Column:
            total, i = x["s"] + F.get(more, x["n"]), acc["i"]
            hot = (i >= window - 1) & (F.log2(F.lit(float(window))) - total / window >= bits - 1e-9)
            first, last = F.when(hot & (acc["first"] < 0), i - window + 1).otherwise(acc["first"]), F.when(hot, i + 1).otherwise(acc["last"])
            return F.struct(F.overlay(x["counts"], F.char(x["n"] + 1 + zero), place).alias("counts"), total.alias("s"), (i + 1).alias("i"), first.alias("first"), last.alias("last"))

        return let(let(counts, lambda c: F.struct(c.alias("counts"), s.alias("s"), count(c, place).alias("n"))), entered)

    def step(acc: Column, x: Column) -> Column:
        slide = let(count(acc["counts"], x["leaving"]) - 1, lambda n: enter(acc, x["entering"], F.overlay(acc["counts"], F.char(n + zero), x["leaving"]), acc["s"] - F.get(more, n)))
        return F.when(x["leaving"] > 0, slide).otherwise(enter(acc, x["entering"], acc["counts"], acc["s"]))

    # What a step changes is all that it carries: an array in it would be copied at every step.
    places = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) + 1)
    moves = let(places, lambda p: F.zip_with(p, F.concat(F.array_repeat(F.lit(0), window), F.slice(p, F.lit(1), F.greatest(F.size(p) - window, F.lit(0)))), lambda e, x: F.struct(e.alias("entering"), F.coalesce(x, F.lit(0)).alias("leaving"))))
    none = F.struct(F.lit(chr(zero) * _ALPHABET).alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(moves, none, step, lambda acc: F.when(acc["first"] >= 0, F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))


def without(text: Column, pattern: str) -> Column:
    """The text with spaces in place of all matches."""
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.length(m)))
    return F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), matches, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base and spans: arrays of (start, kind number, end) in order; base holds the patterns' spans, spans those and the windows'."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return find(df, "text").select("doc_id", "text", F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def _judged(c: Column) -> Column:
    hexadecimal = c["t"].rlike("^[0-9a-fA-F]+$")
    hot = hot_range(c["t"], F.when(hexadecimal, HEX_BITS).otherwise(BASE64_BITS))
    kind = F.when(hexadecimal, KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_base64"))
    return F.transform(F.array(hot), lambda h: F.when(h.isNotNull(), F.struct(F.struct((c["start"] + h["first"]).alias("start"), kind.alias("kind"), (c["start"] + h["last"]).alias("end")).alias("s"), c["t"].alias("t"))))[0]


def _of_kind(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def find(df: DataFrame, text: str) -> DataFrame:
    """The columns of ``df``, and __base and __spans. ``text`` holds no null."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    named = _matches(df, kept, text, {"assign": ASSIGN, "access": ACCESS, "hex": HEX}, "assign")
    long_enough = F.filter("__m_assign", lambda m: F.length(m["v"]) >= ASSIGN_LENGTH)
    base = [_of_kind(c, i) for i, c in enumerate((long_enough, F.col("__m_access"), F.col("__m_hex")))]
    df = named.select(*kept, F.array_sort(F.concat(*base)).alias("__base"))
    df = df.select(*kept, "__base", F.when(F.col(text).rlike(CANDIDATE), F.regexp_replace(text, _ASSIGNED, " ")).otherwise("").alias("__c_open"))
    cut = F.regexp_replace(F.regexp_replace("__c_open", _BEFORE_HEX, " "), _AFTER_HEX, "$1 ")
    df = df.select(*kept, "__base", cut.alias("__c_open"))
    df = df.select(*kept, "__base", F.when(F.col("__c_open").rlike(CANDIDATE), F.when(F.col("__c_open").rlike(PLACEHOLDER), without(F.col("__c_open"), PLACEHOLDER)).otherwise(F.col("__c_open"))).otherwise("").alias("__c_open"))
    df = _matches(df, [*kept, F.col("__base")], "__c_open", {"run": CANDIDATE})
    hot = F.filter(F.transform("__m_run", _judged), lambda x: x.isNotNull())
    df = df.select(*kept, "__base", F.when(F.size("__m_run") > 0, hot).otherwise(F.expr(f"cast(array() as array<struct<s:{_SPAN},t:string>>)")).alias("__c_hot"))
    allowed = lambda t: t.rlike(PLAIN) | (t.rlike(WORDS) & ~t.rlike(JUMBLED))
    windows = F.transform(F.filter("__c_hot", lambda h: ~allowed(h["t"])), lambda h: h["s"])
    return df.select(*kept, "__base", F.array_sort(F.concat("__base", windows)).alias("__spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with a mark in place of all spans; overlapping ones get one."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def between(chunks: Column, start: Column, end: Column | None) -> Column:
        """From start to end, put together from chunks."""
        first, offset = F.floor(start / BLOCK).cast("int"), start % BLOCK
        if end is None:
            return F.concat(F.substring(F.coalesce(F.get(chunks, first), F.lit("")), offset + 1, F.lit(BLOCK)), F.array_join(F.slice(chunks, first + 2, F.size(chunks)), ""))
        last = F.floor(end / BLOCK).cast("int")
        apart = F.concat(F.substring(F.get(chunks, first), offset + 1, F.lit(BLOCK)), F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(chunks, last), F.lit("")), F.lit(1), end % BLOCK))
        return F.when(first == last, F.substring(F.get(chunks, first), offset + 1, end - start)).otherwise(apart)

    def marked(chunks: Column, done: Column) -> Column:
        piece = lambda s, at: F.when(s["start"] >= at, F.concat(between(chunks, at, s["start"]), F.lit(mark))).otherwise("")
        tail = between(chunks, F.greatest(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0)), None)
        return F.concat(F.array_join(F.zip_with(spans, done, piece), ""), tail)

    done = running(F.transform(spans, lambda s: s["end"]), _larger, F.lit(0))
    return F.when(F.size(spans) > 0, let(chunks, lambda c: let(done, lambda d: marked(c, d)))).otherwise(text)


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.documents(spark, sf_dir).select("doc_id", "text"))
    counts = [_count(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def secret_stage(docs: DataFrame) -> DataFrame:
    """The documents with their secrets taken out of the text, and n_chars brought in line; a null text stays null."""
    found = find(docs.withColumn("__text", F.coalesce(F.col("text"), F.lit(""))), "__text")
    clean = F.when(F.col("text").isNotNull(), redacted(F.col("__text"), F.col("__spans")))
    columns = [clean.alias(c) if c == "text" else F.when(F.size("__spans") > 0, F.length(clean)).otherwise(F.col(c)).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return found.select(*columns)
