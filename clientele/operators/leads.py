"""Propensity to buy in the days after a cutoff, from what was known at the cutoff."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.functions.columns import dated, days_after, days_before, exact_sum, hash_bucket, round_half_up, whole_days
from clientele.operators import evaluation
from clientele.operators.cltv import assemble, deciles
from clientele.operators.rfm import CUSTOMER, NEVER
from clientele.sources.scratch import materialise

# The model inputs.
FEATURES = (
    "total_sessions",
    "total_pageviews",
    "pricing_views",
    "product_views",
    "cart_adds",
    "form_submits",
    "support_tickets",
    "uses_desktop",
    "uses_mobile",
    "events_last_7d",
    "events_last_30d",
    "recency_of_activity_days",
    "hist_orders",
    "hist_revenue",
    "hist_recency_days",
)

# Which event type or device each count feature counts.
EVENT_TYPE_COUNTS = {
    "pricing_views": "pricing_view",
    "product_views": "product_view",
    "cart_adds": "add_to_cart",
    "form_submits": "lead_form_submitted",
    "support_tickets": "support_ticket",
}
DEVICE_COUNTS = {"uses_desktop": "desktop", "uses_mobile": "mobile"}

MINIMUM_OF_EACH_LABEL = 10


def cutoff_date(
    events: DataFrame,
    transactions: DataFrame,
    label_days: int = 30,
    given: datetime | None = None,
) -> Column:
    """The given date, or the newest event or order less the label window."""
    if given is not None:
        return F.lit(given).cast("timestamp")
    newest = F.greatest(
        events.agg(F.max("event_timestamp")).scalar(),
        transactions.agg(F.max("order_timestamp")).scalar(),
    )
    return days_before(newest, label_days)


def observed_events(events: DataFrame, cutoff: Column) -> DataFrame:
    """Events known at the cutoff."""
    return dated(events, high=cutoff).where(F.col("event_timestamp") <= cutoff)


def behaviour_features(events: DataFrame, cutoff: Column) -> DataFrame:
    """Session, event-type, device and momentum counts in one aggregate."""
    kinds = {name: F.col("event_type") == kind for name, kind in EVENT_TYPE_COUNTS.items()}
    devices = {name: F.col("device_type") == kind for name, kind in DEVICE_COUNTS.items()}
    recent = {
        f"events_last_{days}d": F.col("event_timestamp") > days_before(cutoff, days)
        for days in (7, 30)
    }
    return (
        observed_events(events.where(F.col(CUSTOMER).isNotNull()), cutoff)
        .groupBy(CUSTOMER)
        .agg(
            F.countDistinct("session_id").cast("int").alias("total_sessions"),
            F.count("event_id").cast("int").alias("total_pageviews"),
            *[
                F.count_if(condition).cast("int").alias(name)
                for name, condition in {**kinds, **devices, **recent}.items()
            ],
            F.max("event_timestamp").alias("last_event_ts"),
        )
    )


def order_features(transactions: DataFrame, cutoff: Column, label_days: int = 30) -> DataFrame:
    """Order history up to the cutoff and the forward label, in one pass over the orders."""
    placed = F.col("order_timestamp")
    before = placed <= cutoff
    follows = (placed > cutoff) & (placed <= days_after(cutoff, label_days))
    return (
        transactions.where(F.col(CUSTOMER).isNotNull())
        .groupBy(CUSTOMER)
        .agg(
            F.countDistinct(F.when(before, F.col("order_id"))).cast("int").alias("hist_orders"),
            exact_sum(F.when(before, F.col("revenue"))).alias("hist_revenue"),
            F.max(F.when(before, placed)).alias("hist_last_order"),
            F.max(follows.cast("int")).alias("converted_flag"),
        )
    )


def extract_features(
    profiles: DataFrame,
    events: DataFrame,
    transactions: DataFrame,
    label_days: int = 30,
    given: datetime | None = None,
) -> DataFrame:
    """Model inputs and label for every profile."""
    cutoff = cutoff_date(events, transactions, label_days, given)
    joined = (
        profiles.select(CUSTOMER)
        .join(behaviour_features(events, cutoff), CUSTOMER, "left")
        .join(order_features(transactions, cutoff, label_days), CUSTOMER, "left")
    )
    gaps = {name: 0 for name in (*FEATURES, "converted_flag")}
    gaps |= {"recency_of_activity_days": NEVER, "hist_recency_days": NEVER}
    return (
        joined.withColumns(
            {
                "recency_of_activity_days": whole_days(F.col("last_event_ts"), cutoff),
                "hist_recency_days": whole_days(F.col("hist_last_order"), cutoff),
            }
        )
        .fillna(gaps)
        .select(CUSTOMER, *FEATURES, "converted_flag")
    )


def label_guard(features: DataFrame) -> DataFrame:
    """One row: counts of both labels and whether a model can be fitted."""
    positives = F.coalesce(F.sum(F.col("converted_flag").cast("bigint")), F.lit(0))
    negatives = F.count("*") - positives
    enough = (positives >= MINIMUM_OF_EACH_LABEL) & (negatives >= MINIMUM_OF_EACH_LABEL)
    return features.agg(
        F.when(enough, "OK").otherwise("DEGENERATE_LABEL").alias("status"),
        positives.alias("positives"),
        negatives.alias("negatives"),
        round_half_up(F.coalesce(F.avg("converted_flag"), F.lit(0.0)), 4).alias("positive_rate"),
    )


def constant_scores(features: DataFrame, positives: int, total: int) -> DataFrame:
    """What everybody gets when the label carries no signal."""
    return features.select(
        CUSTOMER,
        F.lit(positives / max(total, 1)).alias("lead_score"),
        F.lit("Insufficient-Signal").alias("lead_grade"),
    )


def stratified_split(
    features: DataFrame, label: str = "converted_flag", train_pct: int = 75
) -> DataFrame:
    """A stable split within each label: the hash covers label and id."""
    key = F.concat_ws(":", F.col(label).cast("string"), F.col(CUSTOMER).cast("string"))
    return features.withColumn("is_train", hash_bucket(key) < train_pct)


def train(features: DataFrame, iterations: int = 150) -> GBTClassificationModel:
    rows = assemble(features.where("is_train"), FEATURES).select("features", "converted_flag")
    return GBTClassifier(
        labelCol="converted_flag",
        maxIter=iterations,
        stepSize=0.05,
        maxDepth=4,
        minInstancesPerNode=20,
        featureSubsetStrategy="0.9",
        seed=42,
    ).fit(rows)


def positive_probability(model: GBTClassificationModel, assembled: DataFrame) -> DataFrame:
    """Add the probability of label 1 as a plain column."""
    scored = model.transform(assembled)
    return scored.withColumn("raw_score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def grade(score: Column) -> Column:
    """Grade by score; each bound belongs to the lower grade."""
    return (
        F.when(score <= 0.15, "Cold")
        .when(score <= 0.35, "Warm")
        .when(score <= 0.6, "Hot")
        .otherwise("Sales-Ready")
    )


def graded_scores(df: DataFrame, score: str) -> DataFrame:
    rounded = df.withColumn("lead_score", round_half_up(score, 4))
    return rounded.select(CUSTOMER, "lead_score", grade(F.col("lead_score")).alias("lead_grade"))


def grade_counts(scores: DataFrame) -> DataFrame:
    counts = scores.groupBy("lead_grade").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "lead_grade")


def evaluate(test: DataFrame, score: str) -> dict[str, object]:
    """All metrics of a scored test part; each comes from a one-row aggregate."""
    label = "converted_flag"
    with_decile = deciles(test, score, "decile")
    frames = (
        evaluation.roc_auc(test, label, score),
        evaluation.average_precision(test, label, score),
        with_decile.agg(
            evaluation.brier_score(label, score), *evaluation.decile_lift(label, "decile")
        ),
        evaluation.precision_recall_at_top(test, CUSTOMER, label, score),
    )
    metrics: dict[str, object] = {}
    for frame in frames:
        metrics |= frame.first().asDict()
    return metrics


def train_and_score(
    features: DataFrame, iterations: int = 150
) -> tuple[DataFrame, dict[str, object]]:
    """Scores and grades for everybody, and the metrics of the test part."""
    split = materialise(stratified_split(features), "leads")
    guard = label_guard(split).first().asDict()
    if guard["status"] != "OK":
        total = guard["positives"] + guard["negatives"]
        return constant_scores(split, guard["positives"], total), guard
    return score_and_evaluate(train(split, iterations), split)


def score_and_evaluate(model: GBTClassificationModel, split: DataFrame) -> tuple[DataFrame, dict[str, object]]:
    """Scores and grades for everybody by a fitted model, and its metrics on the test part."""
    scored = materialise(positive_probability(model, assemble(split, FEATURES)), "leads-scored")
    metrics = {"status": "OK"} | evaluate(scored.where("NOT is_train"), "raw_score")
    return graded_scores(scored, "raw_score"), metrics
