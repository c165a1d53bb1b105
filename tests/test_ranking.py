from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from clientele.operators import ranking


def bucket(rank: int, n: int, buckets: int) -> int:
    return 1 if n == 1 else max(1, math.ceil(buckets * (rank - 1) / (n - 1)))


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 6, 23, 200])
def test_buckets_follow_the_first_rank_with_ties(spark, n):
    rng = random.Random(n)
    rows = [(f"c{i:04d}", rng.choice([1, 1, 1, 2, 3, 9]), rng.random()) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, tied int, free double").repartition(5)
    keys = {"a": F.col("tied"), "b": -F.col("free")}
    got = {r["id"]: (r["a"], r["b"]) for r in ranking.quantile_buckets(df, "id", keys, 5).collect()}
    by_tied = sorted(rows, key=lambda r: (r[1], r[0]))
    by_free = sorted(rows, key=lambda r: (-r[2], r[0]))
    want_a = {r[0]: bucket(i + 1, n, 5) for i, r in enumerate(by_tied)}
    want_b = {r[0]: bucket(i + 1, n, 5) for i, r in enumerate(by_free)}
    assert got == {i: (want_a[i], want_b[i]) for i in want_a}


def test_bucket_sizes_when_one_value_holds_most_rows(spark):
    df = spark.range(1000).withColumn("key", F.when(F.col("id") < 900, 7).otherwise(F.col("id")))
    sizes = ranking.quantile_buckets(df, "id", {"b": F.col("key")}, 10).groupBy("b").count().collect()
    assert sorted(r["count"] for r in sizes) == [99, 100, 100, 100, 100, 100, 100, 100, 100, 101] or (
        max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 2
    )
    assert sum(r["count"] for r in sizes) == 1000


def test_global_rank_and_running_totals(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, key int, amount bigint").repartition(7)
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    ranks = {r["id"]: r["rank"] for r in ranking.global_rank(df, ["key", "id"]).collect()}
    assert ranks == {r[0]: i + 1 for i, r in enumerate(ordered)}
    totals = {r["id"]: r["t"] for r in ranking.running_totals(df, ["key", "id"], {"t": "amount"}).collect()}
    running, want = 0, {}
    for r in ordered:
        running += r[2]
        want[r[0]] = running
    assert totals == want


def test_first_ranks_of_several_keys(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("b", 1, 1.0), ("c", 1, 0.5)], "id string, x int, y double")
    got = {r["id"]: (r["x_rank"], r["y_rank"]) for r in ranking.first_ranks(
        df, "id", {"x_rank": F.col("x"), "y_rank": F.col("y")}).collect()}
    assert got == {"a": (3, 2), "b": (1, 3), "c": (2, 1)}


@pytest.mark.parametrize("count", [1, 10, 99, 100, 250])
def test_first_rows_of_any_number(spark, count):
    got = [r["id"] for r in ranking.first_rows(spark.range(100).repartition(6), "id", count).collect()]
    assert sorted(got) == list(range(min(count, 100)))


def test_first_rows_by_a_falling_key(spark):
    df = spark.range(100).withColumn("score", (F.col("id") % 4).cast("double")).repartition(6)
    got = sorted(r["id"] for r in ranking.first_rows(df, "id", 30, -F.col("score")).collect())
    assert got == sorted(sorted(range(100), key=lambda i: (-(i % 4), i))[:30])
