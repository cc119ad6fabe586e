from lamina.operators import filters
from lamina.plans import pipelines


def test_passing_is_exact_and_lets_few_through(spark):
    rows = spark.range(20000).selectExpr("id", "if(id % 50 = 0, null, id % 3000) AS k", "'x' AS h")
    keys = spark.range(0, 3000, 7).selectExpr("id AS k").union(spark.range(5).selectExpr("cast(null AS long) AS k")).union(spark.range(0, 70, 7).toDF("k"))
    want = rows.join(keys, "k", "left_semi")
    assert sorted(map(tuple, filters.passing(rows, keys, "k").collect())) == sorted(map(tuple, want.collect()))
    words = filters.bits_of(keys, "k")
    near = rows.where("k is not null").where(filters.might_hold(rows.k, words, spark))
    assert want.count() <= near.count() <= want.count() + 0.02 * 20000
    few = filters.bits_of(keys, "k", 1 << 8)  # a bound that is far too small
    assert len(few) == 4 and sorted(map(tuple, filters.passing(rows, keys, "k", 1 << 8).collect())) == sorted(map(tuple, want.collect()))
    assert filters.passing(rows, keys.limit(0), "k").count() == 0


def test_the_model_is_called_for_reads_that_pass_only(spark, tmp_path):
    """Calls are counted by an accumulator; a hundred archives, of which ten pass."""
    reads = spark.range(1000).selectExpr("id % 100 AS archive_id", "id % 5 AS molecule_id", "if(id % 100 < 10, 0.9, 0.1) AS p", "double(id) AS x")
    calls = spark.sparkContext.accumulator(0)
    model = lambda d: pipelines.called(d, lambda x: x[:, 0] * 2, ["x"], ["y"], calls)
    out = pipelines.two_phase(reads, lambda d: d.withColumnRenamed("p", "presence"), model, 0.5, str(tmp_path / "gate")).collect()
    assert len(out) == 100 == calls.value and all(r.y == 2 * r.x and r.archive_id < 10 for r in out)
