import hashlib
import heapq
import os
import random
import re
import zlib

import pytest

from lamina.llm import repair

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def least(rows):
    """Cheapest edits of (role, text, fault) rows by a search over (rows used, roles so far mod the grammar), independent of the layers under test."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, used, tail = heapq.heappop(heap)  # tail: the last role kept
        if (used, tail) in done:
            continue
        done.add((used, tail))
        if used == len(rows) and tail in ("", "a"):
            return cost, audit
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[tail]
        for who in follows:
            if who != "s":
                heapq.heappush(heap, (cost + 3, audit + "I", used, who))
        if used < len(rows):
            role, _, fault = rows[used]
            heapq.heappush(heap, (cost + 4, audit + "D", used + 1, tail))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if role[:1] in follows and role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + extra, audit + "K", used + 1, role[:1]))
                for who in follows:
                    if who != "s" and who != role[:1]:
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", used + 1, who))


def plain(table):
    """The contract, row by row."""
    found = {}
    groups = {}
    for conv, turn, role, text in table:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, rows in groups.items():
        after = []
        for turn, role, text in rows:
            d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            role = "user" if d == 4 else role
            after += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in after:
            shown = re.findall("[^\x20\x09-\x0d]", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in after if t is not None}
        cost, audit = least([(r, t, f) for (_, r, t), f in zip(after, faults)])
        kept, left, tail = [], list(after), ""
        for edit in audit:
            if edit == "I":
                kept.append(("assistant" if tail == "u" else "user", ""))
            else:
                _, role, text = left.pop(0)
                if edit == "D":
                    continue
                kept.append((role if edit == "K" else "assistant" if tail == "u" else "user", text))
            tail = kept[-1][0][:1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(after, after[1:])]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        found[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)
    return found


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def made(seed, conversations=60, most=9):
    r = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(r.randint(0, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = r.choice(["Hello there.", "So it is", "Is it? ", " \t\n", "", None, f"Turn {r.randint(0, 3)}!", "ß… ü.", "End?\r\n"])
            rows += [(r.choice([conv, conv, conv, None]) if conv % 9 == 0 else conv, None if r.random() < 0.1 else turn + r.choice([0, 0, 0, 1, 3]), role, text)] * r.choice([1, 1, 1, 2])
    r.shuffle(rows)
    return rows


def test_registered_query_equals_the_plain_version(spark, tmp_path):
    rows = made(1)
    spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n long, kind string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(repair.op13_conversation_repair(spark, str(tmp_path))) == plain(rows)


def test_large_conversations_go_by_chunks_and_give_the_same(spark):
    rows = made(2, 40, 30)
    r = random.Random(3)
    rows += [(1000, t // 3, r.choice(["user", "assistant"]), r.choice(["Yes.", "No", f"Word {t}.", "   "])) for t in range(900)]
    rows += [(1001, 5, "user", "The same.")] * 700  # one turn, over and over
    rows += [(None, None, "user", f"{t}.") for t in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows)
    assert got(repair.repair(df, 100)) == want
    assert got(repair.repair(df, 10**9)) == want


def test_nothing_left_and_no_rows(spark):
    dropped, turns = next((c, found) for c in range(4000) if len(found := [t for t in range(60) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]) > 1)
    rows = [(dropped, turns[0], "user", "a."), (dropped, turns[1], "assistant", "b.")]
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(repair.repair(spark.createDataFrame(rows, SCHEMA))) == {dropped: empty} == plain(rows)
    assert got(repair.repair(spark.createDataFrame(rows, SCHEMA), 1)) == {dropped: empty}
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_audits_are_chained(spark):
    """Thousands of rows: chunks of any size give the same cost and the least audit."""
    r = random.Random(5)
    symbols = "".join(r.choice("XsSuUaAoO") for _ in range(700))
    whole = min((c, a) for s, c, a in repair.paths(symbols, -1) if s in (0, 3))
    for size in (1, 7, 64):
        cost, parts = repair.chained([symbols[i : i + size] for i in range(0, len(symbols), size)])
        assert (cost, "".join(p for p, _ in parts)) == whole


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(repair.op13_conversation_repair(spark, FOLDER)) == plain(rows)
