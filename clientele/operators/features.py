"""The customer feature table: segments, value, propensity and churn risk side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.functions.columns import round_half_up
from clientele.operators.rfm import CUSTOMER

# Fixed value: days without an order at which the churn risk reaches 1.
CHURN_DAYS = 180.0


def churn_risk(recency_days: Column) -> Column:
    share = recency_days / F.lit(CHURN_DAYS)
    return round_half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), 3)


def consolidate(rfm: DataFrame, cltv: DataFrame, leads: DataFrame) -> DataFrame:
    """One row per customer of the segment table; values and scores where known."""
    return (
        rfm.join(cltv.select(CUSTOMER, "predicted_cltv", "cltv_decile"), CUSTOMER, "left")
        .join(leads.select(CUSTOMER, "lead_score"), CUSTOMER, "left")
        .select(
            CUSTOMER,
            "recency_days",
            "frequency",
            "monetary",
            "gross_margin",
            "rfm_score",
            "rfm_segment",
            "predicted_cltv",
            "cltv_decile",
            "lead_score",
            churn_risk(F.col("recency_days")).alias("churn_risk"),
        )
    )
