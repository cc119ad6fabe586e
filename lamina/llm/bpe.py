"""Byte-level BPE encoding and decoding with a local rank file.

Texts are cut at safe boundaries before the regular expression runs: before every space
whose neighbour on either side is not white space. A match of the pre-splitting pattern
holds a space only as its first character or inside a run of white space, and leaves the
last space of a run to the word behind it, so no match crosses such a place. The pieces
are deduplicated per slice of rows, the distinct ones encoded once (and kept in a bounded
cache), and the ids of whole texts gathered from them. They equal the ids of the whole text.

Defined cases: a null or empty text has no ids; repeated rows are encoded each on its
own; a null doc_id is carried; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import common

CACHE_ENTRIES = 200_000  # pieces kept per Python worker, about 10 MB
CACHED_LENGTH = 64  # longer pieces hardly repeat
SLICE_BYTES = 2 << 20  # text handled at once; one longer text is a slice of its own
#: Fixed value: the pre-splitting pattern of byte-level BPE vocabularies of this kind.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space inside which a cut before a space would be wrong; texts that hold it are cut piece by piece.
_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = rf"{_SPACE} (?:{_SPACE}|\z)"
_CUT = re.compile(r"(?<=\S)(?= )")


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a rank file or from a byte-level BPE vocabulary in JSON."""
    if not path.endswith(".json"):
        with open(path, "rb") as lines:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    if whole["model"]["type"] != "BPE" or whole.get("normalizer") or (whole.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or whole["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"{path} is not a byte-level BPE vocabulary without normalisation")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands_for = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {x["content"] for x in whole.get("added_tokens", ())}
    ranks = {bytes(stands_for[c] for c in token): rank for token, rank in whole["model"]["vocab"].items() if token not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
    merged = [whole["model"]["vocab"][a + b] for a, b in pairs]
    if merged != sorted(merged):
        raise ValueError(f"{path}: ids do not follow the order of merges")
    return ranks


def read_added(path: str) -> dict[str, int]:
    """Added tokens of a vocabulary in JSON and their ids."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens", ())
    if any(x.get("single_word") or x.get("lstrip") or x.get("rstrip") for x in found):
        raise ValueError(f"{path}: added tokens that take their surroundings into account")
    return {x["content"]: x["id"] for x in found}


class ByteBpe:
    """Encoder and raw-byte decoder over one vocabulary. Added tokens are ordinary text, unless ``added`` gives their ids."""

    def __init__(self, rank_file: str, pattern: str = BYTE_LEVEL_PATTERN, added: dict[str, int] | None = None):
        import tiktoken

        ranks = read_ranks(rank_file)
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = added or {}
        self.at_added = "(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")"
        self.tokens: list[bytes] = [b""] * (max([*ranks.values(), *self.added.values()], default=-1) + 1)
        for token, rank in self.added.items():
            self.tokens[rank] = token.encode()
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.widths = np.array([len(t) for t in self.tokens], "i8")
        self._forget()

    def _plain(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        """Of a text with long runs of white space."""
        return b"".join(map(self._plain, _CUT.split(text)))

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each piece, one behind the other, and how many each has.

        All pieces that start with a character other than white space are encoded as one text.
        """
        odd = np.asarray(pc.if_else(pc.greater(pc.binary_length(new), 0), pc.match_substring_regex(new, rf"\A{_SPACE}"), True))
        plain = new.filter(pa.array(~odd))
        text = " ".join(plain.to_pylist())
        ids = self.encoding.encode_to_numpy(" " + text, disallowed_special=()).astype("<u4") if len(plain) else np.empty(0, "<u4")
        ends = np.cumsum(np.asarray(pc.binary_length(plain)).astype("i8") + 1)
        stops = np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1
        if not odd.any():
            return ids, np.diff(stops, prepend=0)
        others = [np.frombuffer(self._plain(" " + p.as_py()), "<u4") for p in new.filter(pa.array(odd))]
        counts = np.empty(len(new), "i8")
        counts[~odd], counts[odd] = np.diff(stops, prepend=0), [len(x) for x in others]
        parts, rest = np.split(ids, stops[:-1]), iter(others)
        regular = iter(parts)
        return np.concatenate([next(rest) if o else next(regular) for o in odd.tolist()]), counts

    def _remember(self, new: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Short new pieces join the cache, which starts anew when it is full."""
        if len(self.keys) + len(new) > CACHE_ENTRIES:
            self._forget()
        if len(new) > CACHE_ENTRIES:
            return
        short = np.asarray(pc.binary_length(new)) <= CACHED_LENGTH
        kept = np.repeat(short, counts)
        self.keys = pa.concat_arrays([self.keys, new.filter(pa.array(short))])
        self.pool = np.concatenate([self.pool, ids[kept]])
        self.counts = np.concatenate([self.counts, counts[short]])

    def _forget(self) -> None:
        self.keys, self.pool, self.counts = pa.array([], pa.large_string()), np.empty(0, "<u4"), np.empty(0, "i8")

    def encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one behind the other, and where each text's ids end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        unsafe = pc.match_substring_regex(texts, _UNSAFE)
        split = pc.split_pattern(pc.if_else(unsafe, pa.scalar("", pa.large_string()), texts), " ")
        starts = np.asarray(split.offsets)[:-1]
        flat = split.flatten()
        opening = flat.take(pa.array(starts)).to_pylist()  # the first piece of a text has no space before it
        for i in np.flatnonzero(np.asarray(unsafe)).tolist():
            opening[i] = None
        coded = flat.dictionary_encode()
        codes = np.asarray(coded.indices).astype("i8")
        place = pc.index_in(coded.dictionary, value_set=self.keys)
        unknown = np.asarray(pc.is_null(place))
        place = np.asarray(pc.fill_null(place, 0)).astype("i8")
        new = coded.dictionary.filter(pa.array(unknown))
        ids, counts = self._learn(new)
        firsts = [np.frombuffer(self._whole(texts[i].as_py()) if p is None else self._plain(p), "<u4") for i, p in enumerate(opening)]
        sizes = np.concatenate([self.counts, counts, np.fromiter(map(len, firsts), "i8", len(firsts))])
        pool = np.concatenate([self.pool, ids, *firsts])
        place[unknown] = len(self.keys) + np.arange(len(new))
        which = place[codes]
        which[starts] = len(self.keys) + len(new) + np.arange(len(starts))
        self._remember(new, ids, counts)
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        take = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - lengths), lengths) + np.arange(ends[-1])
        return pool[take], ends[np.append(starts[1:], len(codes)) - 1]

    def encode_batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        start = 0
        for stop in slices(texts):
            part = texts.slice(start, stop - start)
            start = stop
            if any(pc.any(pc.match_substring(part, token)).as_py() for token in self.added):
                yield from self._around_added(part)
            else:
                yield from self._ids(part)

    def _ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        ids, ends = self.encode_slice(texts)
        at = 0
        for end in ends.tolist():
            yield ids[at:end]
            at = end

    def _around_added(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Texts are cut at added tokens, and what is between them encoded on its own."""
        cut = [re.split(self.at_added, t or "") for t in texts.to_pylist()]
        ids = self._ids(pa.array([p for pieces in cut for p in pieces[::2]], pa.large_string()))
        for pieces in cut:
            whole = [next(ids)]
            for token in pieces[1::2]:
                whole += [np.array([self.added[token]], "<u4"), next(ids)]
            yield np.concatenate(whole)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes, not text: ids may end inside a character."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[int]:
    """Where slices of about ``limit`` bytes end."""
    total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        total += n
        if total >= limit:
            yield i + 1
            total = 0
    if len(texts) and (total or n == 0):
        yield len(texts)


def encode_decode(docs: DataFrame, rank_file: str, pattern: str = BYTE_LEVEL_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, token_ids (little-endian unsigned 32-bit), decoded (bytes); one row per input row, no shuffle.

    ``rank_file`` is opened by the Python workers, so it must exist at that path on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(rank_file, pattern)

        def rows():
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), bpe.encode_batch(batch.column(1))):
                    yield doc_id, ids.tobytes(), bpe.decode(ids)

        yield from common.sliced(["doc_id", "token_ids", "decoded"], [pa.int64(), pa.binary(), pa.binary()], rows())

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, token_ids binary, decoded binary")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = encode_decode(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
