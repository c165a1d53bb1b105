"""The queries on kept models hold when every fit comes out a little different, as on many executors."""

from __future__ import annotations

from clientele.operators import cltv, leads, lookalike
from clientele.plans import checks_models
from clientele.plans.views import Views


def differing(monkeypatch, module):
    """Let every fit take another number of rounds than the one before it."""
    train, calls = module.train, []

    def one_more(rows, iterations):
        calls.append(iterations)
        return train(rows, iterations + len(calls))

    monkeypatch.setattr(module, "train", one_more)
    monkeypatch.setattr(checks_models, "ROUNDS", 5)


def same_flags(spark, name):
    rows = checks_models.QUERIES[name](Views(spark, "/root/testdata/sf0.001")).collect()
    assert rows
    return {c: {row[c] for row in rows} for c in rows[0].asDict() if c.startswith("same_")}


def test_lookalikes(spark, monkeypatch):
    differing(monkeypatch, lookalike)
    assert same_flags(spark, "k05_kept_lookalike_model") == {"same_raw_score": {True}}


def test_values(spark, monkeypatch):
    differing(monkeypatch, cltv)
    flags = same_flags(spark, "c09_kept_value_model")
    assert flags == {"same_predicted_cltv": {True}, "same_cltv_decile": {True}, "same_metrics": {True}}


def test_leads(spark, monkeypatch):
    differing(monkeypatch, leads)
    flags = same_flags(spark, "l11_kept_lead_model")
    assert flags == {"same_lead_score": {True}, "same_lead_grade": {True}, "same_metrics": {True}}
