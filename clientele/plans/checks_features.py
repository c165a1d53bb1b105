"""Registered queries for the feature table and the refresh, and their check SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from clientele.operators import features
from clientele.plans import checks_identity, checks_sources
from clientele.plans.inputs import LABEL_DAYS, feature_table, rfm_table
from clientele.plans.refresh import refresh
from clientele.sources.scratch import scratch_path
from clientele.sources.warehouse import Warehouse

# The loaded tables and their keys.
KEYS = {
    "customer_profile": "unified_customer_id",
    "identity_map": "id",
    "transaction_fact": "order_id",
    "event_fact": "event_id",
    "campaign_touchpoint": "touchpoint_id",
    "consent_preference": "unified_customer_id",
    "customer_features": "unified_customer_id",
}
# The check text whose rows each table has to hold.
_SOURCES = {
    "customer_profile": "s03_customer_profile",
    "identity_map": "s04_identity_map",
    "transaction_fact": "s05_transaction_fact",
    "event_fact": "s06_event_fact",
    "campaign_touchpoint": "s07_campaign_touchpoint",
    "consent_preference": "s08_consent_preference",
    "customer_features": "s03_customer_profile",
}


def _refresh(v):
    """From the written feeds to all tables with the default rounds; facts about every table."""
    feeds, root = scratch_path(v.spark, "feeds"), scratch_path(v.spark, "warehouse")
    for name, view in checks_sources.FEED_VIEWS.items():
        v[view].write.parquet(f"{feeds}/{name}")
    refresh(v.spark, feeds, root, threshold=checks_identity.THRESHOLD, label_days=LABEL_DAYS)
    store = Warehouse(v.spark, root)

    def facts(table):
        rows = store.read(table)
        sound = F.lit(True)
        if table == "customer_features":
            sound = (
                F.col("churn_risk").between(0, 1) & F.col("cltv_decile").between(1, 10)
                & F.col("lead_score").between(0, 1) & (F.col("predicted_cltv") >= 0)
            )
        return rows.agg(
            F.lit(table).alias("table_name"), F.count("*").alias("rows"), F.countDistinct(KEYS[table]).alias("keys"),
            F.count_if(F.col("unified_customer_id").isNull()).alias("unmapped"),
            F.coalesce(F.every(F.coalesce(sound, F.lit(False))), F.lit(True)).alias("values_in_range"),
        )

    return reduce(lambda left, right: left.unionByName(right), [facts(table) for table in KEYS])


QUERIES = {
    "p01_feature_table": feature_table,
    "p02_churn_risk": lambda v: rfm_table(v).select(
        "unified_customer_id", features.churn_risk(F.col("recency_days")).alias("churn_risk")
    ),
    "p03_refresh_features": _refresh,
}

PARTS = {
    "feature_table": """
        select unified_customer_id, recency_days, frequency, monetary, gross_margin, rfm_score, rfm_segment, predicted_cltv,
               cltv_decile, lead_score, round(case when recency_days > 180 then 1.0 else recency_days / 180.0 end, 3) as churn_risk
        from {rfm} left join (select unified_customer_id, predicted_cltv, cltv_decile from {cltv_deciles}) using (unified_customer_id)
             left join (select unified_customer_id, lead_score from {lead_grades}) using (unified_customer_id)
    """,
}

SQL = {
    "p03_refresh_features": " union all ".join(
        f"""
        select '{table}' as table_name, count(*) as rows, count(distinct {KEYS[table]}) as keys,
               count(*) filter (unified_customer_id is null) as unmapped, true as values_in_range
        from ({checks_sources.SQL[source]})
        """
        for table, source in _SOURCES.items()
    ),
    "p01_feature_table": "select * replace (cast(churn_risk as double) as churn_risk) from {feature_table}",
    "p02_churn_risk": "select unified_customer_id, cast(churn_risk as double) as churn_risk from {feature_table}",
}
