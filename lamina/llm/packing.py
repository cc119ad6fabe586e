"""Packing of token sequences: first-fit decreasing over a tournament tree of bin capacities.

Whole sequences are cut from the front of every document where it is read. What is left, less than a
sequence, is written to the shared checkpoint folder and dealt into randomised groups; every group is
packed on its own by first-fit decreasing, so nothing is ever gathered beyond one group, and a group holds
no more tokens than its documents have room for, however long texts are. Then the emptiest bins are taken apart,
last first, and their tokens fill the gaps of the others; what stays of the last bin is cut into
powers of two, which need no padding.

Ids are those of the tokenizers library for the vocabulary as it is loaded: the file's added tokens are found in texts.

Defined cases: a null or empty text is the one id that ends every document; documents of
equal length are placed in the order of (doc_id, row order), null ids first; repeated rows are
packed each; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import common
from lamina.llm.bpe import ByteBpe, read_added

GROUP_DOCUMENTS = 1024  # expected documents of a group; each brings less than a sequence
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Tournament tree over bins: every node holds the largest free capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """The first bin with room for ``size``; its capacity is reduced."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        found = node - self.leaves
        free[node] -= size
        node //= 2
        while node:
            free[node] = max(free[2 * node], free[2 * node + 1])
            node //= 2
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions in ``sizes``; every size is at most ``capacity``."""
    tree = CapacityTree(len(sizes), capacity)
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        place = tree.first_fit(sizes[item])
        if place == len(bins):
            bins.append([])
        bins[place].append(item)
    return bins


def pack_lengths(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every token of every document once."""
    sequences: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        whole = n - n % capacity
        sequences += [[(doc, at, capacity)] for at in range(0, whole, capacity)]
        if n > whole:
            rest.append((doc, whole, n - whole))
    bins = [[rest[i] for i in members] for members in first_fit_decreasing([r[2] for r in rest], capacity)]
    filled = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (-filled[i], i))
    gaps = [i for i in order if filled[i] < capacity]
    done = len(order) - len(gaps)
    sequences += [bins[i] for i in order[:done]]
    first, last = 0, len(gaps) - 1
    while first < last:  # the emptiest bin, at the end, fills the gap of the fullest
        donor, taker = bins[gaps[last]], bins[gaps[first]]
        need = capacity - sum(p[2] for p in taker)
        while need and donor:
            doc, start, n = donor.pop()
            take = min(n, need)
            taker.append((doc, start, take))
            need -= take
            if take < n:
                donor.append((doc, start + take, n - take))
        if need == 0:
            sequences.append(taker)
            first += 1
        if not donor:
            last -= 1
    if first == last:
        sequences += powers_of_two(bins[gaps[last]])
    return sequences


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The tokens of one sequence as sequences whose lengths are the powers of two in their number."""
    total, out, left = sum(p[2] for p in pieces), [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        need = total & 1 << bit
        part: list[tuple[int, int, int]] = []
        while need:
            doc, start, n = left.pop()
            take = min(n, need)
            part.append((doc, start, take))
            need -= take
            if take < n:
                left.append((doc, start + take, n - take))
        if part:
            out.append(part)
    return out


CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, ids binary, dealt long"


def cut(docs: DataFrame, vocabulary_file: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents: whole sequences, which have a (negative) sequence_id; and the rest of each document with its ids, little-endian, 16 bits where the vocabulary allows.

    Sequences are numbered, and rests dealt, by partition and place there; so the rows must be written before they are used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(vocabulary_file, added=read_added(vocabulary_file))
        width = 2 if len(bpe.tokens) <= 1 << 16 else 4
        partition = TaskContext.get().partitionId()

        def rows():
            number = sequence = 0
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), bpe.encode_batch(batch.column(1))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    whole = len(ids) - len(ids) % capacity
                    for start in range(0, whole, capacity):
                        sequence += 1
                        yield doc_id, start, capacity, zlib.crc32(ids[start : start + capacity]), len(ids), -(partition << 32 | sequence), None, None
                    if whole < len(ids):
                        number += 1
                        yield doc_id, whole, len(ids) - whole, None, len(ids), None, ids[whole:].astype(f"<u{width}").tobytes(), zlib.crc32(f"{partition}:{number}".encode())

        names = [c.split()[0] for c in CUT.split(", ")]
        yield from common.sliced(names, [*[pa.int64()] * 6, pa.binary(), pa.int64()], rows())

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, CUT)


def pack(docs: DataFrame, vocabulary_file: str, capacity: int = 1024, end_id: int = 0, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """One row per piece: its document, place there, length, checksum, and its place in a sequence."""
    pieces = common.written(cut(docs, vocabulary_file, capacity, end_id), "pieces")
    rest = pieces.where("ids is not null")
    groups = max(1, -(-rest.count() // group_documents))

    def run(table: pa.Table) -> pa.Table:
        group = table.column("pack_group")[0].as_py()
        names = ("doc_id", "ids", "start", "length", "doc_tokens")
        docs_ids = sorted(zip(*[table.column(c).to_pylist() for c in names]), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        ids = [np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4") for _, raw, _, n, _ in docs_ids]
        rows = []
        for number, sequence in enumerate(pack_lengths([len(x) for x in ids], capacity)):
            offset = 0
            for doc, start, length in sequence:
                doc_id, _, before, _, tokens = docs_ids[doc]
                rows.append((doc_id, before + start, length, zlib.crc32(ids[doc][start : start + length]), tokens, group << 32 | number, offset))
                offset += length
        del ids, docs_ids
        common.give_back()
        return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), zip(*rows))})

    dealt = rest.select("doc_id", "ids", "start", "length", "doc_tokens", (F.col("dealt") % groups).cast("int").alias("pack_group"))
    whole = pieces.where("ids is null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(dealt.groupBy("pack_group").applyInArrow(run, PIECES))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
