"""Inputs that several registered queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.functions.columns import round_half_up
from clientele.operators import cltv, features, leads, rfm
from clientele.plans.views import Views

CLTV_WINDOW_DAYS = 180
LABEL_DAYS = 7


def plain(df: DataFrame) -> DataFrame:
    """Times as text, for comparison across engines."""
    texts = {
        name: F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        for name, kind in df.dtypes
        if kind == "timestamp"
    }
    return df.withColumns(texts) if texts else df


def flags_as_text(df: DataFrame) -> DataFrame:
    """Three-valued flags as text, for comparison across engines."""
    flags = {name: F.col(name).cast("string") for name, kind in df.dtypes if kind == "boolean"}
    return df.withColumns(flags) if flags else df


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {name: round_half_up(name, digits) for name, kind in df.dtypes if kind == "double"}
    return df.withColumns(doubles) if doubles else df


def rfm_table(v: Views) -> DataFrame:
    return rfm.rfm_features(v["view_transactions"], v["view_customers"])


def cltv_features(v: Views) -> DataFrame:
    return cltv.extract_features(
        v["view_transactions"], v["view_customers"], v["view_early_events"], CLTV_WINDOW_DAYS
    )


def lead_features(v: Views) -> DataFrame:
    return leads.extract_features(
        v["view_customers"], v["view_events"], v["view_purchases"], LABEL_DAYS
    )


def lead_cutoff(v: Views) -> Column:
    return leads.cutoff_date(v["view_events"], v["view_purchases"], LABEL_DAYS)


def fixed_cltv(v: Views) -> DataFrame:
    """A value score by formula instead of a model, so that its use can be checked exactly."""
    value = F.col("hist_revenue") + 25.0 * F.col("total_events")
    return cltv_features(v).withColumn("predicted_cltv", round_half_up(value, 2))


def fixed_lead_scores(v: Views) -> DataFrame:
    """A propensity score by formula, with many ties."""
    recent = F.col("events_last_7d")
    return lead_features(v).withColumn("score", round_half_up(recent / (recent + 10.0), 4))


def feature_table(v: Views) -> DataFrame:
    """The consolidated features on the formula scores."""
    values = cltv.deciles(fixed_cltv(v), "predicted_cltv", "cltv_decile")
    scores = leads.graded_scores(fixed_lead_scores(v), "score")
    return features.consolidate(rfm_table(v), values, scores)
