from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clientele.operators import attribution, cltv, experiment, leads, ledger
from clientele.plans.checks_sources import FEED_VIEWS
from clientele.plans.refresh import refresh
from clientele.plans.views import Views
from clientele.sources import scratch
from clientele.sources.warehouse import Warehouse, query, query_params

TABLES = ["customer_profile", "identity_map", "transaction_fact", "event_fact", "campaign_touchpoint", "consent_preference", "customer_features"]


@pytest.fixture(scope="module")
def refreshed(spark, tmp_path_factory):
    """A full refresh of the smallest folder, with few boosting rounds."""
    feeds, root = tmp_path_factory.mktemp("feeds"), str(tmp_path_factory.mktemp("warehouse"))
    views = Views(spark, "/root/testdata/sf0.001")
    for name, view in FEED_VIEWS.items():
        views[view].write.parquet(f"{feeds}/{name}")
    summary = refresh(spark, str(feeds), root, label_days=7, cltv_iterations=3, lead_iterations=3)
    return summary, Warehouse(spark, root)


def test_refresh_fills_every_table_with_unique_keys(spark, refreshed):
    summary, warehouse = refreshed
    customers = warehouse.read("customer_profile")
    assert summary["unified_customers"] == customers.count() == summary["features"]
    for table, key in zip(TABLES, ["unified_customer_id", "id", "order_id", "event_id", "touchpoint_id", "unified_customer_id", "unified_customer_id"]):
        df = warehouse.read(table)
        assert df.count() == df.select(key).distinct().count() > 0, table
    risk = warehouse.read("customer_features").agg(F.min("churn_risk"), F.max("churn_risk")).first()
    assert 0.0 <= risk[0] <= risk[1] <= 1.0


def test_attribution_reconciles_on_the_refreshed_touches(refreshed):
    touches = refreshed[1].read("campaign_touchpoint").where("unified_customer_id is not null")
    assert attribution.reconcile(touches, attribution.rule_based(touches)).first()["match"]


def test_a_table_may_be_replaced_from_itself_and_queried(spark, refreshed):
    warehouse = refreshed[1]
    before = warehouse.read("consent_preference").count()
    warehouse.replace("consent_preference", warehouse.read("consent_preference").where("marketing_opt_in"))
    after = warehouse.read("consent_preference").count()
    assert 0 < after < before
    warehouse.append("consent_preference", warehouse.read("consent_preference").limit(1))
    warehouse.register_all(["consent_preference"])
    assert query(spark, "select count(*) from consent_preference").first()[0] == after + 1
    hostile = "x' or 'a' = 'a"
    assert query_params(spark, "select * from consent_preference where unified_customer_id = :id", {"id": hostile}).count() == 0


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch.checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")
    table = scratch.materialise(spark.range(3).withColumn("t", F.lit(datetime(2024, 1, 1))), "probe")
    assert table.count() == 3 and "range" not in table._jdf.queryExecution().optimizedPlan().toString().lower()


def test_scans_skip_dates_outside_the_bounds(refreshed):
    warehouse = refreshed[1]
    events, touches, orders = (warehouse.read(t) for t in ("event_fact", "campaign_touchpoint", "transaction_fact"))
    moment = datetime(2024, 1, 10)
    members = warehouse.read("customer_profile").select("unified_customer_id", F.lit("control").alias("arm"))
    bounded = {
        "window": attribution.in_window(touches, "2024-01-08", "2024-01-20"),
        "observed": leads.observed_events(events, F.lit(moment)),
        "engaged": cltv.engagement_features(events, orders, 150),
        "capped": ledger.capped_customers(touches, moment),
        "outcomes": experiment.arm_outcomes(members, orders, moment),
    }
    for name, frame in bounded.items():
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert any("date_part" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]), name


def test_a_failing_replacement_leaves_the_table(spark, refreshed):
    warehouse = refreshed[1]
    before = warehouse.read("customer_profile").count()
    broken = warehouse.read("customer_profile").withColumn("city", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        warehouse.replace("customer_profile", broken)
    assert warehouse.read("customer_profile").count() == before
