"""Recency, frequency and monetary segments."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.functions.columns import days_after, exact_sum, round_half_up, whole_days
from clientele.operators.ranking import first_ranks, quantile_buckets
from clientele.sources.scratch import materialise

CUSTOMER = "unified_customer_id"

# Fixed value: recency of a customer who never bought.
NEVER = 999


def reference_date(transactions: DataFrame, given: datetime | None = None) -> Column:
    """The given date, or one day after the last order (a scalar subquery)."""
    if given is not None:
        return F.lit(given).cast("timestamp")
    return transactions.agg(days_after(F.max("order_timestamp"), 1)).scalar()


def purchase_history(
    transactions: DataFrame, given: datetime | None = None
) -> DataFrame:
    """Recency, distinct orders, revenue and margin of each buyer."""
    history = (
        transactions.where(F.col(CUSTOMER).isNotNull())
        .groupBy(CUSTOMER)
        .agg(
            F.max("order_timestamp").alias("last_order"),
            F.countDistinct("order_id").cast("int").alias("frequency"),
            exact_sum(F.col("revenue")).alias("monetary"),
            exact_sum(F.col("gross_margin")).alias("gross_margin"),
        )
    )
    recency = whole_days(F.col("last_order"), reference_date(transactions, given))
    return history.select(
        CUSTOMER, recency.alias("recency_days"), "frequency", "monetary", "gross_margin"
    )


def customer_base(
    transactions: DataFrame, profiles: DataFrame, given: datetime | None = None
) -> DataFrame:
    """All distinct profiles with their history; those who never bought are filled in."""
    return (
        profiles.select(CUSTOMER)
        .dropDuplicates()
        .join(purchase_history(transactions, given), CUSTOMER, "left")
        .select(
            CUSTOMER,
            F.coalesce("recency_days", F.lit(NEVER)).alias("recency_days"),
            F.coalesce("frequency", F.lit(0)).alias("frequency"),
            round_half_up(F.coalesce("monetary", F.lit(0.0)), 2).alias("monetary"),
            round_half_up(F.coalesce("gross_margin", F.lit(0.0)), 2).alias("gross_margin"),
        )
    )


def score_keys() -> dict[str, Column]:
    """What each score ranks, ascending; the fewest days since the last order score highest."""
    return {
        "r_score": -F.col("recency_days"),
        "f_score": F.col("frequency"),
        "m_score": F.col("monetary"),
    }


def score_ranks(base: DataFrame) -> DataFrame:
    """The global rank behind each score."""
    ranks = first_ranks(materialise(base, "customers"), CUSTOMER, score_keys())
    return ranks.select(CUSTOMER, *[F.col(f"{k}_score").alias(f"{k}_rank") for k in "rfm"])


def quintile_scores(base: DataFrame) -> DataFrame:
    """Scores 1-5 from equal-sized buckets of the ranks."""
    return quantile_buckets(materialise(base, "customers"), CUSTOMER, score_keys(), 5)


def score_text() -> Column:
    return F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")])


def segment() -> Column:
    """Segment by rule; the first rule that holds decides."""
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return (
        F.when(F.col("frequency") == 0, "Prospect (Zero Purchases)")
        .when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((f >= 4) & (m >= 3), "Loyal Customers")
        .when((r >= 4) & (f <= 2), "New / Promising Customers")
        .when((r >= 3) & (f >= 3), "Potential Loyalists")
        .when((r <= 2) & (f >= 3) & (m >= 3), "At-Risk High Value")
        .when((r <= 2) & (f >= 2), "Needs Attention")
        .when((r <= 2) & (f == 1), "Hibernating")
        .otherwise("About to Sleep")
    )


def rfm_features(
    transactions: DataFrame, profiles: DataFrame, given: datetime | None = None
) -> DataFrame:
    """One row per profile: history, scores and segment."""
    scored = quintile_scores(customer_base(transactions, profiles, given))
    return scored.withColumns({"rfm_score": score_text(), "rfm_segment": segment()})


def segment_overview(features: DataFrame) -> DataFrame:
    """Customer count and rounded averages per segment, largest first."""
    averages = {
        "avg_recency_days": ("recency_days", 1),
        "avg_orders": ("frequency", 1),
        "avg_monetary_value": ("monetary", 2),
        "avg_predicted_cltv": ("predicted_cltv", 2),
    }
    present = {name: spec for name, spec in averages.items() if spec[0] in features.columns}
    return (
        features.groupBy("rfm_segment")
        .agg(
            F.count("*").alias("customer_count"),
            *[
                round_half_up(exact_sum(F.col(source)) / F.count(source), digits).alias(name)
                for name, (source, digits) in present.items()
            ],
        )
        .orderBy(F.desc("customer_count"), "rfm_segment")
    )


def segment_counts(features: DataFrame) -> DataFrame:
    counts = features.groupBy("rfm_segment").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "rfm_segment")


def segment_summary(features: DataFrame) -> DataFrame:
    """Count, mean predicted value and mean revenue per segment."""
    return features.groupBy("rfm_segment").agg(
        F.count("*").alias("count"),
        (exact_sum(F.col("predicted_cltv")) / F.count("predicted_cltv")).alias("avg_cltv"),
        (exact_sum(F.col("monetary")) / F.count("monetary")).alias("avg_rev"),
    )


def behaviour_sample(features: DataFrame, rows: int = 500) -> DataFrame:
    """The scatter-plot sample: the first customers by id."""
    return (
        features.select(CUSTOMER, "recency_days", "frequency", "predicted_cltv", "rfm_segment")
        .orderBy(CUSTOMER)
        .limit(rows)
    )
