"""The batch refresh: feeds to tables to the customer feature table."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.operators import cltv, features, identity, leads, rfm, scoring
from clientele.sources.feeds import read_feeds
from clientele.sources.models import ModelStore
from clientele.sources.scratch import materialise
from clientele.sources.warehouse import Warehouse, load_feeds


def refresh_features(
    transactions: DataFrame,
    profiles: DataFrame,
    events: DataFrame,
    models: ModelStore,
    now: datetime,
    cltv_window_days: int = 150,
    label_days: int = 30,
    cltv_iterations: int = 100,
    lead_iterations: int = 150,
    fit: bool = True,
) -> tuple[DataFrame, dict[str, object]]:
    """Segments, value, propensity and churn risk, with the metrics of both models.

    The models are fitted and kept, or with ``fit`` off the kept ones are applied.
    """
    segments = rfm.rfm_features(transactions, profiles)
    inputs = materialise(cltv.extract_features(transactions, profiles, events, cltv_window_days), "cltv")
    lead_inputs = materialise(leads.extract_features(profiles, events, transactions, label_days), "leads")
    if fit:
        value = scoring.fit_value(models, inputs, now, cltv_iterations)
        propensity = scoring.fit_leads(models, lead_inputs, now, lead_iterations)
    else:
        value, propensity = models.load(scoring.VALUE), models.load(scoring.LEADS)
    table = features.consolidate(
        segments, scoring.score_value(value, inputs), scoring.score_leads(propensity, lead_inputs)
    )
    return table, {"cltv": value.metrics, "leads": propensity.metrics}


def _store_features(warehouse: Warehouse, now: datetime, **parameters) -> dict[str, object]:
    table, metrics = refresh_features(
        warehouse.read("transaction_fact"), warehouse.read("customer_profile"), warehouse.read("event_fact"),
        ModelStore(warehouse.spark, f"{warehouse.root}/models"), now, **parameters,
    )
    stored = warehouse.replace("customer_features", table.withColumn("computed_at", F.lit(now)))
    return {"features": stored.count(), **metrics}


def rescore(spark: SparkSession, warehouse_root: str, cltv_window_days: int = 150, label_days: int = 30) -> dict[str, object]:
    """Compute and store the features of the present tables with the models kept by the last refresh."""
    now = datetime.now(timezone.utc)
    warehouse = Warehouse(spark, warehouse_root)
    return _store_features(warehouse, now, cltv_window_days=cltv_window_days, label_days=label_days, fit=False)


def refresh(
    spark: SparkSession,
    feed_root: str,
    warehouse_root: str,
    threshold: float = 0.75,
    cltv_window_days: int = 150,
    label_days: int = 30,
    cltv_iterations: int = 100,
    lead_iterations: int = 150,
) -> dict[str, object]:
    """Read the feeds, resolve identities, load all tables, compute and store the features."""
    now = datetime.now(timezone.utc)
    feeds = read_feeds(spark, feed_root)
    warehouse = Warehouse(spark, warehouse_root)
    resolved = identity.resolve(feeds["identities"], threshold, feeds["entities"])
    resolved = materialise(resolved, "resolved")
    load_feeds(warehouse, feeds, resolved, now)
    done = _store_features(
        warehouse, now, cltv_window_days=cltv_window_days, label_days=label_days,
        cltv_iterations=cltv_iterations, lead_iterations=lead_iterations,
    )
    return {**identity.resolution_summary(resolved).first().asDict(), **done}
