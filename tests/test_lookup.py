"""Joins with hot and null keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.lookup import lookup


def test_lookup_is_a_left_join(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 1, k, "x") for k in range(200)] + [(None, 900, "x"), (None, 900, None), (77, 901, None)], "k long, id long, note string")
    table = spark.createDataFrame([(k, f"n{k}", k * 2) for k in range(5)] + [(50, None, 1)], "k long, name string, n long")
    want = sorted(map(str, rows.join(table, "k", "left").select("k", "id", "note", "name", "n").collect()))
    for most in (1, 3, 256):
        assert sorted(map(str, lookup(rows, table, "k", most).collect())) == want
    assert lookup(rows.limit(0), table, "k").count() == 0
    assert lookup(rows, table.limit(0), "k").filter(F.col("name").isNotNull()).count() == 0 and lookup(rows, table.limit(0), "k").count() == 203


def test_hot_and_null_keys_are_not_shuffled(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit("hub")).when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), "id")
    table = spark.range(1000).select(F.when(F.col("id") == 0, "hub").otherwise(F.col("id").cast("string")).alias("k"), F.lit(1).alias("v"))
    got = lookup(rows, table, "k", 1)
    assert got.count() == 1000 and got.filter("v = 1").count() == 334 + 333
