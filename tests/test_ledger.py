from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest

from clientele.operators import experiment, ledger

T0 = datetime(2024, 1, 1)
REQUESTS = "request_id string, nonce string, campaign_name string, audience_id string, channel string, requested_by string, requested_at timestamp"
APPROVALS = "nonce string, campaign_name string, audience_id string, channel string, approved_by string, issued_at timestamp, expires_at timestamp, consumed_at timestamp, consumed_by string"


def approval(nonce, consumed=None, audience="AUD_1"):
    return (nonce, "A", audience, "email", "boss", T0, T0 + timedelta(hours=1), consumed, "x" if consumed else None)


def request(i, nonce, minutes=5, campaign="A", audience="AUD_1", channel="email"):
    return (f"r{i}", nonce, campaign, audience, channel, "bot", T0 + timedelta(minutes=minutes))


def decide(spark, requests, approvals):
    audiences = [("AUD_1", "COMPLIANT"), ("AUD_2", "COMPLIANT"), ("AUD_SMALL", "REJECTED")]
    decided = ledger.decide_requests(
        spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(approvals, APPROVALS),
        spark.createDataFrame(audiences, "audience_id string, status string"),
    )
    return decided, {r["request_id"]: r["reason"] for r in decided.collect()}


def test_scope_expiry_and_registration(spark):
    _, got = decide(
        spark,
        [
            request(1, "n1"), request(2, "n2", campaign="B"), request(3, "n2", audience="AUD_2"), request(4, "n2", channel="sms"),
            request(5, "n2", minutes=61, campaign="B"), request(6, "n9"), request(7, None), request(8, "n2", minutes=60),
        ],
        [approval("n1"), approval("n2")],
    )
    assert got == {
        "r1": None, "r2": "SCOPE_CAMPAIGN", "r3": "SCOPE_AUDIENCE", "r4": "SCOPE_CHANNEL", "r5": "EXPIRED",
        "r6": "NOT_REGISTERED", "r7": "NOT_REGISTERED", "r8": None,
    }


def test_unknown_and_rejected_audiences_are_refused(spark):
    _, got = decide(
        spark,
        [request(1, "n1", audience="AUD_X"), request(2, "n2", audience="AUD_SMALL"), request(3, "n3", audience=None)],
        [approval("n1", audience="AUD_X"), approval("n2", audience="AUD_SMALL"), approval("n3", audience=None)],
    )
    assert got == {"r1": "UNKNOWN_AUDIENCE", "r2": "AUDIENCE_REJECTED", "r3": "UNKNOWN_AUDIENCE"}


def test_a_nonce_serves_exactly_one_request(spark):
    """Most requests replay one nonce; the earliest passing one wins, ties by id."""
    requests = [request(i, "hot", minutes=10 + i % 3) for i in range(200)] + [request(999, "hot", minutes=9, campaign="B"), request(500, "used")]
    decided, got = decide(spark, requests, [approval("hot"), approval("used", T0)])
    winners = [r for r, reason in got.items() if reason is None]
    assert winners == ["r0"] and got["r500"] == "ALREADY_CONSUMED" and got["r999"] == "SCOPE_CAMPAIGN"
    assert sum(reason == "ALREADY_CONSUMED" for reason in got.values()) == 200
    registry = ledger.consume_approvals(spark.createDataFrame([approval("hot"), approval("used", T0)], APPROVALS), decided)
    used = {r["nonce"]: (r["consumed_at"], r["consumed_by"]) for r in registry.collect()}
    assert used == {"hot": (T0 + timedelta(minutes=10), "bot"), "used": (T0, "x")}
    audiences = spark.createDataFrame([("AUD_1", 120)], "audience_id string, audience_size bigint")
    log = ledger.activations(decided, audiences).collect()
    assert len(log) == 1 and log[0]["audience_size"] == 120 and log[0]["approval_status"] == "APPROVED_AND_ACTIVATED"
    audit = {r["governance_status"]: r["records"] for r in ledger.audit_rollup(ledger.audit_rows(decided, "s")).collect()}
    assert audit == {"APPROVED_BY_HUMAN": 1, "BLOCKED_BY_GOVERNANCE": 201}


def test_issuing_again_resets_the_consumption(spark):
    registry = spark.createDataFrame([approval("n1", T0), approval("n2", T0)], APPROVALS)
    newer = [("n1", "A", "AUD_1", "email", f"b{i}", T0 - timedelta(days=1) + timedelta(hours=i), T0) for i in range(3)]
    issued = spark.createDataFrame(newer, "nonce string, campaign_name string, audience_id string, channel string, approved_by string, issued_at timestamp, expires_at timestamp")
    got = {r["nonce"]: r for r in ledger.upsert_approvals(registry, issued).collect()}
    assert got["n1"]["approved_by"] == "b2" and got["n1"]["consumed_at"] is None and got["n2"]["consumed_at"] == T0


def test_weekly_cap(spark):
    touches = [("a", T0 - timedelta(days=d)) for d in (0, 1, 6)] + [("b", T0 - timedelta(days=7)), ("b", T0), ("c", T0 + timedelta(days=1))]
    df = spark.createDataFrame(touches, "unified_customer_id string, event_timestamp timestamp")
    members = spark.createDataFrame([(c,) for c in "abcd"], "unified_customer_id string")
    assert sorted(r[0] for r in ledger.within_cap(members, df, T0, 2).collect()) == ["b", "c", "d"]


@pytest.mark.parametrize("n, fraction, control", [(20, 0.1, 2), (25, 0.1, 2), (200, 0.25, 50), (20, 0.001, 1)])
def test_holdout_has_the_exact_size_and_is_stable(spark, n, fraction, control):
    members = spark.range(n).select("id").withColumnRenamed("id", "unified_customer_id")
    first = {r[0]: r[1] for r in experiment.assign_arms(members, "E", fraction).collect()}
    again = {r[0]: r[1] for r in experiment.assign_arms(members.repartition(3), "E", fraction).collect()}
    assert first == again and sum(a == "control" for a in first.values()) == control


def test_small_audiences_are_refused(spark):
    with pytest.raises(ValueError, match="too few"):
        experiment.assign_arms(spark.range(19).withColumnRenamed("id", "unified_customer_id"), "E")


@pytest.mark.parametrize("counts", [(100, 900, 8, 110), (50, 450, 25, 150), (10, 90, 0, 0), (20, 180, 0, 9), (1000, 9000, 80, 990)])
def test_lift_matches_the_exact_formula(spark, counts):
    nc, nt, cc, ct = counts
    df = spark.createDataFrame([("control", nc, cc), ("treatment", nt, ct)], "arm string, members bigint, conversions bigint")
    row = experiment.lift(df).first()
    pc, pt, pool = cc / nc, ct / nt, (cc + ct) / (nc + nt)
    se = math.sqrt(pool * (1 - pool) * (1 / nc + 1 / nt))
    p = math.erfc(abs((pt - pc) / se if se else 0.0) / math.sqrt(2))
    assert row["p_value"] == pytest.approx(p, abs=6e-5) and row["is_significant"] == (p < 0.05)
    assert row["lift_pct"] == pytest.approx((pt - pc) / pc * 100 if pc else 0.0, abs=0.006)
    assert row["sample_size"] == nc + nt
