"""Selection: pairs, advantages, histograms, splits, resume; independence of partitioning."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import select as L


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([("g", 1, 2.0, "a"), ("g", 2, 5.0, "b"), ("g", 3, 5.0, "c"), ("g", 4, 2.0, "d"), ("h", 5, 1.0, "e"), ("i", 6, None, "f")], "g string, id int, s double, t string")


@pytest.mark.parametrize("n", [1, 8])
def test_pairs_take_the_first_of_ties(rows, n):
    got = L.best_and_worst(rows.repartition(n), "g", "s", "id", ["t"]).collect()
    assert [(r.g, r.t_chosen, r.t_rejected, r.score_chosen >= r.score_rejected) for r in got] == [("g", "b", "a", True)]


def test_best_of_n_needs_a_pass(rows):
    none = rows.withColumn("s", F.lit(0.0))
    assert L.best_of_n(none, "g", "s", "id", ["t"]).count() == 0
    assert {r.g: r.t_all for r in L.best_of_n(rows, "g", "s", "id", ["t"], "none").collect()}["g"] == ["a", "b", "c", "d"]


def test_advantages(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", float("nan")), ("c", None)], "g string, r double")
    got = sorted((r.g, round(r.advantage, 3)) for r in L.advantages(df, "g", {"r": 1.0}).collect())
    assert got == [("a", -0.707), ("a", 0.707), ("b", 0.0), ("c", 0.0), ("c", 0.0)]


def test_histogram(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.99,), (10.0,), (None,)], "v double")
    assert {r.bin: r.n for r in L.histogram(df, "v", 10).collect()} == {1: 1, 2: 1, 10: 2}
    flat = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert {r.bin: r.n for r in L.histogram(flat, "v", 10).collect()} == {1: 2}
    assert L.histogram(df.limit(0), "v", 3).count() == 0


def test_split_is_disjoint_complete_and_near_its_share(spark):
    df = spark.range(5000).select("id", L.hash_split(F.col("id"), 0.1, "x").alias("s"))
    n = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    assert sum(n.values()) == 5000 and abs(n["test"] - 500) < 90


def test_sample_is_stable(spark):
    a = [r.id for r in L.sample_rows(spark.range(1000).repartition(7), "id", 20).collect()]
    assert a == [r.id for r in L.sample_rows(spark.range(1000).repartition(2), "id", 20).collect()] and len(set(a)) == 20


def test_resume(spark):
    new = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    done = spark.createDataFrame([(2,), (None,), (2,)], "id int")
    assert [r.id for r in L.remaining(new, done, "id").collect()] == [1]
    assert L.remaining(new, done.limit(0), "id").count() == 3
    assert L.resume_key(new, done) == "id"
    assert sorted(r.id for r in L.skip_done(spark.range(100).repartition(5), 40, "id").collect()) == list(range(40, 100))


def test_join_last(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "q string")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "p string, n int, t string")
    assert [(r.q, r.u) for r in L.join_last(left, right, {"q": "p"}, "n", {"t": "u"}).collect()] == [("a", "y")]


def test_criteria(spark):
    df = spark.createDataFrame([("s", {"a": 1.0, "b": None}), ("s", {"a": 3.0}), ("t", {}), ("t", None)], "g string, m map<string,double>")
    assert [(r.g, r.criterion, r.n, r["mean"], round(r.deviation, 4)) for r in L.criterion_stats(df, "g", "m").collect()] == [("s", "a", 2, 2.0, 1.4142)]


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3], ["a", "b"])], "x array<int>, y array<string>")
    r = df.select(F.size(L.zip_short(F.col("x"), F.col("y"))).alias("n"), L.list_chunks(F.col("y"), 1).alias("c"), L.natural_key(F.lit("step-012")).alias("k")).first()
    assert (r.n, r.c, r.k) == (2, [["a"], ["b"]], 12)
