import os

import pytest
from pyspark.sql import functions as F

from lamina.plans import seeds
from lamina.plans.graph import Graph, RunFailed, Stage

FOLDER = "/root/testdata/sf0.001"


def numbers(spark, path, rows=range(20)):
    spark.createDataFrame([(i, i % 3) for i in rows], "id long, g long").repartition(3).write.mode("overwrite").parquet(path)


def stages(calls, limit=5, broken=False):
    def noted(name, f):
        def make(*inputs, **parameters):
            calls.append(name)
            return f(*inputs, **parameters)

        return make

    def failing(df):
        if not broken:
            return df.groupBy().agg(F.sum("id").alias("s"))
        return df.select(F.raise_error(F.lit("an executor's task fails")).alias("s"))

    return [
        Stage("total", noted("total", lambda a, b: a.crossJoin(b)), ("kept", "sum")),
        Stage("kept", noted("kept", lambda df, limit: df.where(F.col("id") >= limit)), ("numbers",), {"limit": limit}),
        Stage("sum", noted("sum", failing), ("numbers",)),
        Stage("alone", noted("alone", lambda df: df.limit(0)), ("numbers",)),
    ]


def test_stages_are_made_once_and_anew_where_something_changed(spark, tmp_path):
    source, calls = f"{tmp_path}/numbers.parquet", []
    numbers(spark, source)
    run = lambda limit=5: Graph(spark, f"{tmp_path}/run", {"numbers": source}, stages(calls, limit))
    g = run()
    out = g.run()
    assert out["total"].count() == 15 and out["total"].first()["s"] == 190 and out["alone"].count() == 0
    assert sorted(calls) == ["alone", "kept", "sum", "total"] and g.made == set(calls)
    again = run()
    again.run()
    assert len(calls) == 4 and not again.made and again.changed() == []
    assert {r.stage: r.digest for r in g.manifest().collect()} == {r.stage: r.digest for r in again.manifest().collect()}
    other = run(10)
    assert other.run()["total"].count() == 10 and other.made == {"kept", "total"}  # a threshold
    numbers(spark, source, range(30))
    new = run(10)
    assert new.run(("kept",))["kept"].count() == 20 and new.made == {"kept"}  # a source, and one target only
    assert new.run()["sum"].first()["s"] == 435 and new.made == {"total", "sum", "alone"}
    gone = new.prune()
    assert len(gone) == 6 and new.run()["total"].count() == 20 and not new.made


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path):
    source, calls = f"{tmp_path}/numbers.parquet", []
    numbers(spark, source)
    with pytest.raises(RunFailed) as error:
        Graph(spark, f"{tmp_path}/run", {"numbers": source}, stages(calls, broken=True)).run()
    assert set(error.value.failures) == {"sum"} and sorted(calls) == ["alone", "kept", "sum"]  # what doesn't wait for it is made
    g = Graph(spark, f"{tmp_path}/run", {"numbers": source}, stages(calls))
    assert g.run()["total"].count() == 15 and g.made == {"sum", "total"}
    path = g._path("kept")  # written, but killed before its record was
    (tmp_path / "run" / "kept" / os.path.basename(path) / "record" / "_SUCCESS").unlink()
    spark.range(3).write.mode("overwrite").parquet(f"{path}/data")
    g = Graph(spark, f"{tmp_path}/run", {"numbers": source}, stages(calls))
    assert g.run()["kept"].count() == 15 and g.made == {"kept"}
    spark.range(3).write.mode("overwrite").parquet(f"{path}/data")  # another hand
    assert g.changed() == ["kept"]


def test_wrong_graphs_are_refused(spark):
    one = lambda *names: [Stage(n, lambda *d: d[0], inputs) for n, inputs in names]
    for wrong in (one(("a", ("b",)), ("b", ("a",))), one(("a", ("c",))), one(("a", ()), ("a", ())), one(("s", ()))):
        with pytest.raises(ValueError):
            Graph(spark, "/nowhere", {"s": "/nowhere"}, wrong)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_seed_runs_keep_scores_where_a_threshold_changes(spark, tmp_path):
    first = seeds.graph(spark, FOLDER, str(tmp_path), repetitions=20)
    out = first.run()
    assert out["summary"].columns == ["method", "metric", "mean", "std_population", "best_seed", "best_value", "worst_seed", "worst_value"]
    assert out["intervals"].where("lower95 <= mean and mean <= upper95").count() >= 6
    second = seeds.graph(spark, FOLDER, str(tmp_path), energy=-6.0, repetitions=20)
    second.run()
    assert not {n for n in second.made if n.startswith("scores")} and {"summary", "intervals", "decisions-0"} <= second.made
    assert out["matrices"].where("seed is null").agg(F.sum("n")).first()[0] == out["counts"].agg(F.sum("archives")).first()[0]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_command_line_keeps_what_is_there(spark, tmp_path):
    from lamina import cli

    cli.main(["seed-runs", FOLDER, f"{tmp_path}/o", "--repetitions", "20"])
    first = {r.stage: r for r in spark.read.json(f"{tmp_path}/o/manifest").collect()}
    assert {r.status for r in first.values()} == {"made"} and len(first) == 20
    cli.main(["inventory", f"{tmp_path}/o/stages", f"{tmp_path}/inventory"])
    cli.main(["seed-runs", FOLDER, f"{tmp_path}/o", "--repetitions", "20", "--proxy", "0.7", "--prune"])
    second = {r.stage: r for r in spark.read.json(f"{tmp_path}/o/manifest").collect()}
    assert {n for n, r in second.items() if r.status == "kept"} == {f"scores-{i}" for i in range(5)}
    assert all(second[n].digest == first[n].digest for n in first if n.startswith("scores"))
    cli.main(["verify", f"{tmp_path}/o/stages", f"{tmp_path}/inventory", f"{tmp_path}/differences"])
    states = {r.state for r in spark.read.json(f"{tmp_path}/differences").collect()}
    assert states == {"missing", "unexpected"}  # outputs of the old threshold are gone, others are new
