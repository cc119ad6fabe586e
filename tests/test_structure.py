import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lamina.functions.sequences import LAGS
from lamina.operators import structure


def plain(s):
    """One letter after the other."""
    s = s or ""
    runs = [m[0] for m in re.finditer("A+|C+|G+|T+", s)]
    pairs = [s[i : i + 2] for i in range(len(s) - 1)]
    return [len(s), *[s.count(b) for b in "ACGT"], *[pairs.count(p) for p in structure.PAIRS], *[sum(s[i] == s[i - k] for i in range(k, len(s))) for k in LAGS], max(map(len, runs), default=0), sum(len(r) for r in runs if len(r) >= 3)]


def made(seed, n=60):
    r = random.Random(seed)
    letters = lambda: "".join(r.choice("ACGT") * r.choice([1, 1, 1, 2, 3, 9]) for _ in range(r.randint(0, 40)))
    return [letters() for _ in range(n)] + ["", "A", "A" * 50, "AC", "NNNN", "ANNA" * 5, "AAANAAA", "GATTACA" * 30]


def test_summaries_equal_the_plain_counts():
    rows = made(1)
    got = [s.values() for s in structure.summaries(pa.array([*rows, None]))]
    assert got == [plain(s) for s in [*rows, None]]
    sliced = pa.array(["TTT", *rows, "GG"]).slice(1, len(rows))
    assert [s.values() for s in structure.summaries(sliced)] == got[:-1]


@pytest.mark.parametrize("cut", [1, 2, 5, 13])
def test_merging_stretches_in_any_grouping_is_the_whole(cut):
    for s in made(cut, 30):
        parts = structure.summaries(pa.array([s[i : i + cut] for i in range(0, len(s), cut)], pa.string()))
        left = structure.Summary(np.zeros(28, "i8"))
        for p in parts:
            left = structure.merged(left, p)
        while len(parts) > 1:  # neighbours first
            parts = [structure.merged(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        assert left.values() == plain(s) and (not parts or parts[0].values() == plain(s))


def test_long_sequences_are_spread_and_equal_the_plain_version(spark):
    r = random.Random(2)
    long = "".join(r.choice("ACGT") * r.choice([1, 1, 2, 5]) for _ in range(150_000))
    rows = [(1, "a", long), (2, None, "A" * 70_000), (3, "c", "ACGT"), (3, "c", long[:20_001]), (None, "d", None)]
    df = spark.createDataFrame(rows, "id long, g string, s string")
    counted = structure.counted(df, "s", ["id", "g"], 10_000)
    got = sorted((tuple(x) for x in counted.collect()), key=repr)
    assert got == sorted(((i, g, *plain(s)) for i, g, s in rows), key=repr)


def test_letters_are_read_by_a_table_and_slice_by_slice(monkeypatch):
    table = structure.read_as({"a": "A", "c": "C", "G": "G", "t": "T"})
    rows = ["a c-t é aa", "", None, "GGGccc ttt", "zzz", "aG" * 40]
    want = [plain("".join({"a": "A", "c": "C", "G": "G", "t": "T"}.get(x, "") for x in s or "")) for s in rows]
    assert [s.values() for s in structure.summaries(pa.array(rows), table)] == want
    monkeypatch.setattr(structure, "SLICE", 16)
    assert [s.values() for s in structure.summaries(pa.array(["no", *rows]).slice(1), table)] == want


def test_memory_of_a_batch_stays_small():
    """A batch of 48 MB took more than 20 times its size."""
    import tracemalloc

    batch = pa.array(["ACGTTTGA" * 2000] * 3000)
    tracemalloc.start()
    structure.summaries(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
