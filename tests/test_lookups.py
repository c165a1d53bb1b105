"""Looking up one customer reads few rows of a stored table."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clientele.sources.warehouse import Warehouse

CUSTOMERS = 40_000


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Tables of several files: a partition is asked to be small."""
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    made = Warehouse(spark, str(tmp_path_factory.mktemp("warehouse")))
    who = F.concat(F.lit("UCID_"), F.lpad((F.col("id") % CUSTOMERS).cast("string"), 6, "0")).alias("unified_customer_id")
    made.replace("customer_profile", spark.range(CUSTOMERS).select(who, F.lit("x").alias("city"), F.sha2(F.col("id").cast("string"), 256).alias("primary_email")))
    day = F.lit(datetime(2024, 1, 1)) + F.make_interval(days=(F.col("id") % 20).cast("int"))
    # A customer buys on two days of twenty only.
    made.replace("transaction_fact", spark.range(2 * CUSTOMERS).select(
        who, F.col("id").cast("string").alias("order_id"), day.alias("order_timestamp"), F.lit(1.0).alias("revenue")))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    return made


def scanned(frame):
    """The result and the rows that the scan handed on."""
    rows = frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return rows, leaf.metrics().get("numOutputRows").get().value()


@pytest.mark.parametrize("table,total,found", [("customer_profile", CUSTOMERS, 1), ("transaction_fact", 2 * CUSTOMERS, 2)])
def test_few_rows_are_scanned(spark, store, table, total, found):
    rows, read = scanned(store.of_customer(table, "UCID_000777"))
    assert len(rows) == found and {r["unified_customer_id"] for r in rows} == {"UCID_000777"}
    assert read < total / 3
    nobody, read = scanned(store.of_customer(table, "UCID_000777x"))
    assert nobody == [] and read < total / 3


def test_all_rows_are_there(store):
    assert store.read("customer_profile").distinct().count() == CUSTOMERS
    assert store.read("transaction_fact").select("order_id").distinct().count() == 2 * CUSTOMERS
