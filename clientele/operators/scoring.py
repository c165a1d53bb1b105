"""Fit, keep and apply the models: value, propensity and similarity."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.functions.columns import round_half_up
from clientele.operators import cltv, leads, lookalike
from clientele.operators.rfm import CUSTOMER
from clientele.sources.models import ModelStore, StoredModel, has_columns
from clientele.sources.scratch import materialise

VALUE, LEADS, LOOKALIKES = "value", "leads", "lookalikes"


def fit_value(store: ModelStore, features: DataFrame, now: datetime, iterations: int = 100) -> StoredModel:
    """Fit the value model, measure it on the test part, keep both."""
    split = materialise(cltv.train_test(features), "cltv")
    return keep_value(store, cltv.train(split, iterations), split, now)


def keep_value(store: ModelStore, model: GBTRegressionModel, split: DataFrame, now: datetime) -> StoredModel:
    """Keep a fitted value model with its metrics on the test part."""
    test = cltv.deciles(cltv.predict(model, split.where("NOT is_train")), "raw_cltv", "pred_decile")
    metrics = test.agg(
        *cltv.regression_metrics("future_revenue", "raw_cltv"), cltv.top_decile_share("future_revenue", "pred_decile")
    )
    return store.load(VALUE, store.save(VALUE, model, cltv.FEATURES, metrics.first().asDict(), now))


def score_value(stored: StoredModel, features: DataFrame) -> DataFrame:
    """``(customer, predicted_cltv, cltv_decile)`` by a kept model."""
    has_columns(stored, features)
    scored = cltv.predict(stored.model, features).select(CUSTOMER, round_half_up("raw_cltv", 2).alias("predicted_cltv"))
    return cltv.deciles(scored, "predicted_cltv", "cltv_decile")


def fit_leads(store: ModelStore, features: DataFrame, now: datetime, iterations: int = 150) -> StoredModel:
    """Fit the lead model, or keep the constant of a label without signal."""
    split = materialise(leads.stratified_split(features), "leads")
    guard = leads.label_guard(split).first().asDict()
    if guard["status"] != "OK":
        return store.load(LEADS, store.save(LEADS, None, [], guard, now))
    return keep_leads(store, leads.train(split, iterations), split, now)


def keep_leads(store: ModelStore, model: GBTClassificationModel, split: DataFrame, now: datetime) -> StoredModel:
    """Keep a fitted lead model with its metrics on the test part."""
    test = materialise(_probabilities(model, split.where("NOT is_train")), "test")
    metrics = {"status": "OK"} | leads.evaluate(test, "raw_score")
    return store.load(LEADS, store.save(LEADS, model, leads.FEATURES, metrics, now))


def _probabilities(model, features: DataFrame) -> DataFrame:
    return leads.positive_probability(model, cltv.assemble(features, leads.FEATURES))


def score_leads(stored: StoredModel, features: DataFrame) -> DataFrame:
    """``(customer, lead_score, lead_grade)`` by a kept model or constant."""
    has_columns(stored, features)
    if stored.model is None:
        positives = stored.metrics["positives"]
        return leads.constant_scores(features, positives, positives + stored.metrics["negatives"])
    return leads.graded_scores(_probabilities(stored.model, features), "raw_score")


def fit_lookalikes(store: ModelStore, labelled: DataFrame, now: datetime, iterations: int = 70) -> StoredModel:
    """Fit the similarity to a seed and keep it; how far seeds stand above others is kept as its metric."""
    return keep_lookalikes(store, lookalike.train(labelled, iterations), labelled, now)


def keep_lookalikes(store: ModelStore, model: GBTClassificationModel, labelled: DataFrame, now: datetime) -> StoredModel:
    """Keep a fitted similarity with its metric."""
    scored = lookalike.similarity(model, labelled)
    mean = F.avg("raw_score")
    found = {row["is_seed"]: row["m"] for row in scored.groupBy("is_seed").agg(mean.alias("m")).collect()}  # two labels
    metrics = {"mean_of_seeds": found.get(1), "mean_of_others": found.get(0)}
    return store.load(LOOKALIKES, store.save(LOOKALIKES, model, lookalike.numeric_inputs(labelled), metrics, now))


def score_lookalikes(stored: StoredModel, features: DataFrame) -> DataFrame:
    """``features`` with the unrounded ``raw_score`` by a kept model."""
    has_columns(stored, features)
    filled = features.fillna(0, subset=stored.columns)
    return leads.positive_probability(stored.model, cltv.assemble(filled, stored.columns))
