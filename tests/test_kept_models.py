"""Models that are kept: versions, constants, columns, and a refresh followed by scoring without a fit."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clientele.operators import cltv, leads, scoring
from clientele.plans.checks_sources import FEED_VIEWS
from clientele.plans.refresh import refresh, rescore
from clientele.plans.views import Views
from clientele.sources.models import ModelStore
from clientele.sources.warehouse import Warehouse

NOW = datetime(2026, 1, 1)


def value_table(spark, n=200):
    """Customers whose future revenue follows their past."""
    columns = [(F.col("id") % 10 * 10.0).alias("hist_revenue"), (F.col("id") % 10 * 50.0).alias("future_revenue")]
    others = [F.lit(0).alias(c) for c in cltv.FEATURES if c != "hist_revenue"]
    return spark.range(n).select(F.col("id").alias("unified_customer_id"), *columns, *others)


def test_versions_and_equal_scores(spark, tmp_path):
    store, table = ModelStore(spark, str(tmp_path)), value_table(spark)
    with pytest.raises(LookupError, match="value"):
        store.load(scoring.VALUE)
    first = scoring.fit_value(store, table, NOW, 10)
    fitted = {tuple(r) for r in cltv.train_and_evaluate(table, 10)[0].collect()}
    assert {tuple(r) for r in scoring.score_value(first, table).collect()} == fitted
    assert first.metrics["r2"] > 0 and first.columns == list(cltv.FEATURES)
    second = scoring.fit_value(store, table.withColumn("future_revenue", F.lit(1.0)), NOW, 2)
    assert (first.version, second.version, store.versions(scoring.VALUE)) == (0, 1, [0, 1])
    assert store.load(scoring.VALUE).version == 1
    again = store.load(scoring.VALUE, 0)
    assert again.metrics == first.metrics
    assert {tuple(r) for r in scoring.score_value(again, table).collect()} == fitted
    with pytest.raises(LookupError, match="version 7"):
        store.load(scoring.VALUE, 7)


def test_a_version_without_details_does_not_count(spark, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    scoring.fit_value(store, value_table(spark), NOW, 1)
    (tmp_path / "value" / "v1" / "model").mkdir(parents=True)  # what a failed save leaves
    assert store.load(scoring.VALUE).version == 0
    assert scoring.fit_value(store, value_table(spark), NOW, 1).version == 1


def test_missing_columns_are_named(spark, tmp_path):
    stored = scoring.fit_value(ModelStore(spark, str(tmp_path)), value_table(spark), NOW, 1)
    with pytest.raises(ValueError, match="hist_revenue"):
        scoring.score_value(stored, value_table(spark).drop("hist_revenue"))


def test_a_label_without_signal_keeps_its_constant(spark, tmp_path):
    table = spark.range(50).select(
        F.col("id").alias("unified_customer_id"), *[F.lit(1).alias(c) for c in leads.FEATURES], (F.col("id") < 5).cast("int").alias("converted_flag")
    )
    stored = scoring.fit_leads(ModelStore(spark, str(tmp_path)), table, NOW, 2)
    assert stored.kind == "constant" and stored.metrics["status"] == "DEGENERATE_LABEL"
    assert {tuple(r)[1:] for r in scoring.score_leads(stored, table).collect()} == {(0.1, "Insufficient-Signal")}


def test_a_refresh_and_scores_without_a_fit(spark, tmp_path, monkeypatch):
    views = Views(spark, "/root/testdata/sf0.001")
    for name, view in FEED_VIEWS.items():
        views[view].write.parquet(f"{tmp_path}/feeds/{name}")
    root = f"{tmp_path}/warehouse"
    refresh(spark, f"{tmp_path}/feeds", root, label_days=7, cltv_iterations=2, lead_iterations=2)
    wanted = ["unified_customer_id", "predicted_cltv", "cltv_decile", "lead_score", "rfm_segment"]
    before = {tuple(r) for r in Warehouse(spark, root).read("customer_features").select(*wanted).collect()}

    def fit(*_):
        raise AssertionError("fitted again")

    monkeypatch.setattr(cltv, "train", fit)
    monkeypatch.setattr(leads, "train", fit)
    done = rescore(spark, root, label_days=7)
    assert done["features"] == len(before)
    assert {tuple(r) for r in Warehouse(spark, root).read("customer_features").select(*wanted).collect()} == before
