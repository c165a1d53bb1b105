"""One key that holds most of the rows is split by the adaptive skew join."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from clientele.operators import attribution, components, identity

LOW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextmanager
def settings(spark, values):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def executed(frame) -> str:
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The executed plans of all tables a module writes."""
    found = []
    for module in (components, identity):
        real = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, label, real=real: found.append(executed(df)) or real(df, label))
    return found


def test_a_long_journey_is_split(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id")).alias("unified_customer_id"),
        F.md5(F.col("id").cast("string")).alias("touchpoint_id"), (F.col("id") % 5 == 0).cast("int").alias("conversion_flag"),
    ).repartition(8)
    with settings(spark, LOW):
        frame = attribution.converting_journeys(rows)
        assert "skew=true" in executed(frame)
    assert frame.count() == rows.join(rows.where("conversion_flag = 1").select("unified_customer_id").distinct(), "unified_customer_id", "left_semi").count()


def test_a_shared_identifier_is_split(spark, plans):
    entities = [f"E{i:05d}" for i in range(20_000)]
    links = spark.createDataFrame(
        [("phone", "one" if i % 10 < 7 else f"p{i}", e, 1.0) for i, e in enumerate(entities)],
        "identifier_type string, identifier_value string, canonical_entity_id string, confidence_score double",
    ).repartition(8)
    with settings(spark, LOW):
        clusters = identity.entity_clusters(identity.link_edges(links)).collect()
    assert sum("skew=true" in plan for plan in plans) >= 2
    assert sum(r["root_id"] == "E00000" for r in clusters) == 14_000 and len(clusters) == 20_000
