"""Sums of amounts change nothing: sub-cent, negative, large and odd values."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from clientele.functions.columns import exact_sum
from clientele.operators import audience, cltv
from clientele.operators.ranking import first_rows


@pytest.mark.parametrize(
    "values, want",
    [([0.004] * 1000, 4.0), ([0.1] * 10, 1.0), ([-2.5, 2.495], -0.005), ([1e13, 0.25, -1e13], 0.25), ([None, None], None), ([None, 1.0], 1.0)],
)
def test_sums(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    assert df.agg(exact_sum(F.col("v")).alias("s")).first()["s"] == want


def test_odd_numbers_stay_visible(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    assert math.isnan(df.agg(exact_sum(F.col("v")).alias("s")).first()["s"])
    df = spark.createDataFrame([(1.0,), (float("inf"),)], "v double")
    assert df.agg(exact_sum(F.col("v")).alias("s")).first()["s"] == math.inf


def test_means_of_large_values(spark):
    df = spark.range(2000).select(F.lit(1).alias("cltv_decile"), F.lit(1e13).alias("predicted_cltv"))
    assert cltv.mean_by_decile(df).first()["mean_predicted_cltv"] == 1e13


def test_first_rows_with_null_keys(spark):
    rows = [(i, None if i % 5 == 0 else float(i % 3)) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, k double").repartition(4)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    for count in (0, 1, 3, 4, 6, 19, 20, 30):
        assert sorted(r["id"] for r in first_rows(df, "id", count, F.col("k")).collect()) == sorted(r[0] for r in order[:count])


def test_audiences_are_whole_unless_a_limit_is_asked_for(spark):
    features = spark.range(6000).select(
        F.format_string("U%05d", "id").alias("unified_customer_id"), F.lit("A").alias("rfm_segment"), F.lit(1.0).alias("predicted_cltv"),
        F.lit(3).alias("frequency"), F.lit(1).alias("recency_days"), F.lit(0.1).alias("churn_risk"),
    )
    assert audience.select_audience(features, {"min_frequency": 2}).count() == 6000
    assert audience.select_audience(features, {"min_frequency": 2}, 5500).count() == 5500
