import random
from collections import defaultdict

import pandas as pd
import pytest

from lamina.streaming import closing

SCHEMA = "k string, m long, v double, ts timestamp"
HOUR = 3600


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, m long, v double, t long").selectExpr("k", "m", "v", "timestamp_seconds(t) AS ts")


def plain(rows):
    """archive and window -> (molecules, reads, vote)"""
    sums = defaultdict(lambda: defaultdict(list))
    for k, m, v, t in rows:
        sums[k, t // HOUR * HOUR][m].append(v)
    found = {}
    for key, molecules in sums.items():
        means = [sum(x for x in vs if x is not None) / n for vs in molecules.values() if (n := sum(x is not None for x in vs))]
        found[key] = (len(means), sum(map(len, molecules.values())), round(sum(means) / len(means), 9) if means else None)
    return found


def votes_of(spark, path):
    rows = spark.read.schema("archive string, start timestamp, molecules long, reads long, vote double").parquet(path).selectExpr("archive", "unix_seconds(start) AS t", "molecules", "reads", "vote").collect()
    found = {(r.archive, r.t): (r.molecules, r.reads, None if r.vote is None else round(r.vote, 9)) for r in rows}
    assert len(found) == len(rows)  # none is closed twice
    return found


def stream(spark, tmp_path):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return closing.closed_votes(source, "k", "m", "v", "ts", "1 hour", "2 hours")


def made(seed):
    r = random.Random(seed)
    return [(r.choice(["a", "b", None]), r.choice([1, 2, None]), r.choice([r.random(), r.random(), None]), r.randrange(8 * HOUR)) for _ in range(300)]


def test_late_rows_of_open_windows_count_and_others_are_counted(spark, tmp_path):
    rows = made(1)
    batches = [[x for x in rows if x[3] < 4 * HOUR], [x for x in rows if x[3] >= 4 * HOUR], [("a", 1, 5.0, 6 * HOUR + 1), ("a", 1, 7.0, 2 * HOUR), ("b", 2, 7.0, 3)], [("end", 1, 1.0, 1000 * HOUR)]]
    late = 0
    for part in batches:  # a query of its own each: all but the first start again from the checkpoint
        table(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        late += closing.late_rows(closing.run_available(stream(spark, tmp_path), f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert late == 2  # their windows ended at three hours and at one, and at six the watermark had passed them
    assert votes_of(spark, f"{tmp_path}/out") == plain([*rows, batches[2][0]])


def test_a_batch_that_failed_is_taken_again_and_counts_once(spark, tmp_path):
    rows = made(2)
    for part in ([x for x in rows if x[3] < 4 * HOUR], [x for x in rows if x[3] >= 4 * HOUR], [("end", 1, 1.0, 1000 * HOUR)]):
        table(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    failed = []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        if number == 2 and not failed:  # after its rows were written
            failed.append(number)
            raise RuntimeError("the driver is lost")

    with closing.state_in_rocks(spark), pytest.raises(Exception, match="the driver is lost"):
        stream(spark, tmp_path).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    assert failed == [2]
    closing.run_available(stream(spark, tmp_path), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert votes_of(spark, f"{tmp_path}/out") == plain(rows)


class Calls:
    """A state and a handle that count what they are asked."""

    def __init__(self):
        self.rows, self.n = [], 0

    def getListState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.n += 1

    def appendList(self, rows):
        self.n += 1
        self.rows += rows

    def get(self):
        self.n += 1
        return iter(self.rows)

    def clear(self):
        self.n += 1
        self.rows = []


def test_calls_to_the_state_do_not_grow_with_molecules():
    state, votes = Calls(), closing._Molecules()
    votes.init(state)
    for batch in range(3):
        frames = (pd.DataFrame({"molecule": [str(m) for m in range(1000)], "value": [float(m + batch)] * 1000}) for m in (1, 2))
        assert list(votes.handleInputRows(("a", 7), frames, None)) == []
    assert len(state.rows) == 3000 and state.n == 6  # a sum for each molecule and batch; an addition and a timer for each batch
    got = next(votes.handleExpiredTimer(("a", 7), None, None)).to_dict("records")
    assert got == [{"archive": "a", "closes": 7, "molecules": 1000, "reads": 6000, "vote": 2.5}] and state.n == 8 and state.rows == []
