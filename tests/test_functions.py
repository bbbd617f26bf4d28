"""Joins, ranks, text rules and table difference on small data."""

import pytest
from pyspark.sql import functions as F

from platematch.functions import contains_like, diff_tables, grid_join, left_lookup, newest_first_rank


def test_grid_join_equals_plain_join_on_a_hot_key(spark):
    left = spark.range(300).selectExpr("id AS l", "if(id % 3 = 0, 7, id) AS k")
    right = spark.range(90).selectExpr("id AS r", "if(id % 2 = 0, 7, id) AS k")
    plain = left.join(right, "k").where("r > 4").select("k", "l", "r")
    cut = grid_join(left, right, ["k"], ["l"], ["r"], F.col("r") > 4, cell_rows=10).select("k", "l", "r")
    assert diff_tables(plain, cut).isEmpty() and plain.count() > 4000


def test_left_lookup_keeps_rows_without_key(spark):
    left = spark.range(1000).selectExpr("id", "if(id % 3 = 0, CAST(id AS INT), NULL) AS k")
    right = spark.range(100).selectExpr("CAST(id AS INT) AS k2", "id * 2 AS v")
    got = left_lookup(left, right, {"k": "k2"}, "id")
    assert got.columns == ["id", "k", "v"] and got.count() == 1000
    assert got.where("v IS NOT NULL").count() == 34 and got.where("v <> 2 * k").isEmpty()


def test_rank_over_several_buckets(spark):
    ids = spark.range(5).selectExpr("id * 50000 AS id")
    assert [r["rank"] for r in newest_first_rank(ids, "id").orderBy("id").collect()] == [5, 4, 3, 2, 1]
    up = newest_first_rank(ids, "id", descending=False).orderBy("id").collect()
    assert [r["rank"] for r in up] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("search, hits", [("a_c", 1), ("50%", 2), ("[xy]z", 1), ("[^x]z", 1), ("b.c", 1), ("(", 1)])
def test_like(spark, search, hits):
    rows = spark.createDataFrame([("abc xz",), ("50 of (",), ("50% b.c yq wz",)], "s string")
    assert rows.where(contains_like(F.col("s"), search)).count() == hits


def test_diff(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (3, "y")], "k int, v string")
    assert {tuple(r) for r in diff_tables(a, b).collect()} == {("a", 1, None, 1), ("a", 2, "x", 1), ("b", 3, "y", 1)}
    assert {tuple(r)[:2] for r in diff_tables(a, b, as_sets=True).collect()} == {("a", 2), ("b", 3)}
