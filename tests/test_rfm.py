from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clientele.operators import rfm

TX = "order_id string, unified_customer_id string, order_timestamp timestamp, revenue double, gross_margin double"


@pytest.fixture()
def orders(spark):
    return spark.createDataFrame(
        [
            ("o1", "a", datetime(2024, 1, 1, 12), 10.10, 4.0),
            ("o1", "a", datetime(2024, 1, 2, 11), 0.20, 0.0),
            ("o2", "a", datetime(2024, 1, 1, 23), 5.0, 1.0),
            ("o3", "b", datetime(2024, 1, 9, 23, 59), 7.0, 2.5),
            ("o4", None, datetime(2024, 1, 10), 99.0, 9.0),
        ],
        TX,
    )


def test_history_counts_whole_days_distinct_orders_and_exact_money(spark, orders):
    profiles = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "unified_customer_id string")
    got = {r["unified_customer_id"]: r for r in rfm.customer_base(orders, profiles).collect()}
    # The reference date is one day after the last order, 11 January at midnight.
    assert got["a"]["recency_days"] == 8 and got["a"]["frequency"] == 2
    assert got["a"]["monetary"] == 15.3 and got["b"]["recency_days"] == 1
    assert (got["c"]["recency_days"], got["c"]["frequency"], got["c"]["monetary"]) == (999, 0, 0.0)


def test_a_given_reference_date_is_used(spark, orders):
    got = rfm.purchase_history(orders, datetime(2024, 2, 1)).where("unified_customer_id = 'b'").first()
    assert got["recency_days"] == 22


def test_segment_rules_in_order(spark):
    rows = [
        ((5, 5, 5, 0), "Prospect (Zero Purchases)"), ((4, 4, 4, 1), "Champions"), ((1, 4, 3, 1), "Loyal Customers"),
        ((5, 4, 3, 1), "Loyal Customers"), ((4, 2, 5, 1), "New / Promising Customers"), ((3, 3, 1, 1), "Potential Loyalists"),
        ((4, 4, 2, 1), "Potential Loyalists"), ((2, 3, 3, 1), "At-Risk High Value"), ((2, 4, 2, 1), "Needs Attention"),
        ((1, 2, 5, 1), "Needs Attention"), ((2, 1, 1, 1), "Hibernating"), ((3, 2, 2, 1), "About to Sleep"),
    ]
    df = spark.createDataFrame([(*k, v) for k, v in rows], "r_score int, f_score int, m_score int, frequency int, want string")
    assert df.where(rfm.segment() != F.col("want")).count() == 0


def test_buckets_differ_by_at_most_one_customer(spark):
    orders = spark.range(103).select(
        F.concat(F.lit("o"), "id").alias("order_id"), F.col("id").cast("string").alias("unified_customer_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("id") % 7).cast("int"))).alias("order_timestamp"),
        (F.col("id") % 5).cast("double").alias("revenue"), F.lit(1.0).alias("gross_margin"),
    )
    table = rfm.rfm_features(orders, orders)
    for score in ("r_score", "f_score", "m_score"):
        sizes = [r["count"] for r in table.groupBy(score).count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    overview = rfm.segment_overview(table).collect()
    assert sum(r["customer_count"] for r in overview) == 103
