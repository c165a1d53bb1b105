"""Registered queries for kept models on customers whose behaviour carries a signal, and their check SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clientele.operators import cltv, leads, lookalike, scoring
from clientele.plans.checks_sources import NOW
from clientele.plans.inputs import CLTV_WINDOW_DAYS, LABEL_DAYS, feature_table
from clientele.sources.models import ModelStore
from clientele.sources.scratch import checkpoint_root, materialise

#: Rounds of these fits; the signal is strong, and a constant model fails the rows at any number.
ROUNDS = 40


def _store(v):
    return ModelStore(v.spark, f"{checkpoint_root(v.spark)}/models-{uuid.uuid4().hex}")


def _same(left, right, *columns):
    """Rows of both with a flag for each column that tells whether the values are equal."""
    other = right.select("unified_customer_id", *[F.col(c).alias(f"_{c}") for c in columns])
    flags = [F.col(c).eqNullSafe(F.col(f"_{c}")).alias(f"same_{c}") for c in columns]
    return left.join(other, "unified_customer_id").select("unified_customer_id", *flags)


def _value(v):
    """Scores of the kept model against those of the fit, and held-out quality a constant model fails."""
    features = materialise(
        cltv.extract_features(v["signal_transactions"], v["view_customers"], v["signal_events"], CLTV_WINDOW_DAYS), "features"
    )
    split = materialise(cltv.train_test(features), "cltv")
    model = cltv.train(split, ROUNDS)  # as below, one fit
    stored = scoring.keep_value(_store(v), model, split, NOW)
    fitted, metrics = cltv.evaluate(model, split)
    again = metrics.first().asDict()
    return _same(scoring.score_value(stored, features), fitted, "predicted_cltv", "cltv_decile").withColumns(
        {
            "same_metrics": F.lit(again == stored.metrics),
            "better_than_the_mean": F.lit(stored.metrics["r2"] > 0),
            "top_decile_above_a_tenth": F.lit(stored.metrics["top_decile_actual_revenue_share_pct"] > 15),
        }
    )


def _leads(v):
    features = materialise(
        leads.extract_features(v["view_customers"], v["signal_events"], v["signal_purchases"], LABEL_DAYS), "features"
    )
    split = materialise(leads.stratified_split(features), "leads")
    model = leads.train(split, ROUNDS)  # as below, one fit
    stored = scoring.keep_leads(_store(v), model, split, NOW)
    fitted, metrics = leads.score_and_evaluate(model, split)
    return _same(scoring.score_leads(stored, features), fitted, "lead_score", "lead_grade").withColumns(
        {
            "same_metrics": F.lit(metrics == stored.metrics),
            "auc_above_threshold": F.lit(stored.metrics["roc_auc"] > 0.6),
            "lift_above_threshold": F.lit(stored.metrics["top_decile_lift"] > 1.5),
        }
    )


def _lookalikes(v):
    features = materialise(feature_table(v), "features")
    labelled = materialise(lookalike.seed_labels(features, lookalike.seed_by_segment(features, "Champions")), "seed")
    model = lookalike.train(labelled, ROUNDS)  # a second fit adds its sums in another order and may differ
    stored = scoring.keep_lookalikes(_store(v), model, labelled, NOW)
    fitted = lookalike.similarity(model, labelled)
    gap = stored.metrics["mean_of_seeds"] - stored.metrics["mean_of_others"]
    return _same(scoring.score_lookalikes(stored, features), fitted, "raw_score").withColumn("seeds_stand_out", F.lit(gap > 0.5))


QUERIES = {"c09_kept_value_model": _value, "l11_kept_lead_model": _leads, "k05_kept_lookalike_model": _lookalikes}

SQL = {
    "c09_kept_value_model": """
        select unified_customer_id, true as same_predicted_cltv, true as same_cltv_decile, true as same_metrics,
               true as better_than_the_mean, true as top_decile_above_a_tenth from {view_customers}
    """,
    "l11_kept_lead_model": """
        select unified_customer_id, true as same_lead_score, true as same_lead_grade, true as same_metrics,
               true as auc_above_threshold, true as lift_above_threshold from {view_customers}
    """,
    "k05_kept_lookalike_model": "select unified_customer_id, true as same_raw_score, true as seeds_stand_out from {feature_table}",
}
