from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clientele.operators import attribution, markov

TOUCHES = "touchpoint_id string, unified_customer_id string, event_timestamp timestamp, channel string, conversion_flag int, attributed_revenue double"
CHANNELS = ["display", "email", "search", "Start"]


def random_touches(seed, customers=40, hot=400):
    """Short journeys, one that holds most touches, ties in time, and touches of nobody."""
    rng = random.Random(seed)
    base = datetime(2024, 1, 1)
    owners = [f"c{rng.randrange(customers)}" for _ in range(200)] + ["hot"] * hot + [None] * 5
    rows = []
    for i, owner in enumerate(owners):
        converts = int(rng.random() < 0.12)
        when = base + timedelta(hours=rng.randrange(24 * 200))
        rows.append((f"t{i:05d}", owner, when, rng.choice(CHANNELS), converts, round(rng.random() * 90, 2) if converts else 0.0))
    return rows


def journeys(rows):
    grouped: dict = {}
    for row in rows:
        if row[1] is not None:
            grouped.setdefault(row[1], []).append(row)
    return [sorted(group, key=lambda r: (r[2], r[0])) for group in grouped.values()]


def credit_by_hand(rows, half_life):
    result: dict = {}
    for touches in journeys(rows):
        if not any(t[4] for t in touches):
            continue
        revenue = sum(t[5] for t in touches if t[4])
        ages = [(touches[-1][2] - t[2]).total_seconds() / 86400 for t in touches]
        weights = [2 ** (-age / half_life) for age in ages]
        for i, t in enumerate(touches):
            shares = (i == 0, i == len(touches) - 1, 1 / len(touches), weights[i] / sum(weights))
            row = result.setdefault(t[3], [0.0] * 8)
            for k, share in enumerate(shares):
                row[2 * k] += share
                row[2 * k + 1] += share * revenue
    return result


@pytest.mark.parametrize("half_life", [7.0, 0.25])
def test_rule_based_matches_a_direct_loop(spark, half_life):
    rows = random_touches(3)
    got = attribution.rule_based(spark.createDataFrame(rows, TOUCHES).repartition(6), half_life).collect()
    want = credit_by_hand(rows, half_life)
    assert {r["channel"] for r in got} == set(want)
    for r in got:
        values = [r[f"{m}_{x}"] for m in attribution.MODELS for x in ("conversions", "revenue")]
        assert values == pytest.approx(want[r["channel"]], abs=0.006)


def test_each_model_gives_one_conversion_per_converting_journey(spark):
    df = spark.createDataFrame(random_touches(4), TOUCHES)
    converting = df.where("conversion_flag = 1").select("unified_customer_id").where("unified_customer_id is not null").distinct().count()
    sums = attribution.journey_credit(df).agg(*[F.sum(m).alias(m) for m in attribution.MODELS]).first()
    for model in attribution.MODELS:
        assert sums[model] == pytest.approx(converting)


def test_reconciliation_and_window(spark):
    rows = [r for r in random_touches(5) if r[1]]
    df = spark.createDataFrame(rows, TOUCHES)
    check = attribution.reconcile(df, attribution.rule_based(df)).first()
    assert check["match"] and check["total_converted_revenue"] == pytest.approx(sum(r[5] for r in rows), abs=0.01)
    inside = attribution.in_window(df, "2024-02-01", "2024-02-10").collect()
    assert {r["touchpoint_id"] for r in inside} == {
        r[0] for r in rows if datetime(2024, 2, 1) <= r[2] <= datetime(2024, 2, 10)
    }


def test_no_converting_journey_gives_an_empty_result(spark):
    df = spark.createDataFrame([("t", "c", datetime(2024, 1, 1), "email", 0, 0.0)], TOUCHES)
    assert attribution.rule_based(df).count() == 0
    assert attribution.reconcile(df, attribution.rule_based(df)).first()["match"]


def markov_by_hand(rows):
    counts: dict = {}
    channels = set()
    for touches in journeys(rows):
        states = [("start",)] + [("ch", t[3]) for t in touches]
        states.append(("conv",) if any(t[4] for t in touches) else ("null",))
        channels |= {t[3] for t in touches}
        for a, b in zip(states, states[1:]):
            counts.setdefault(a, {}).setdefault(b, 0)
            counts[a][b] += 1
    probs = {a: {b: n / sum(to.values()) for b, n in to.items()} for a, to in counts.items()}

    def reach(removed=None):
        mass, total = {("start",): 1.0}, 0.0
        for _ in range(6):
            moved: dict = {}
            for state, p in mass.items():
                if state == ("conv",):
                    total += p
                elif state != ("null",) and state != ("ch", removed):
                    for to, q in probs[state].items():
                        moved[to] = moved.get(to, 0.0) + p * q
            mass = moved
        return total

    base = reach()
    effects = {c: max(0.0, (base - reach(c)) / base) if base else 0.0 for c in channels}
    total = sum(effects.values())
    return counts, {c: e / total if total else 1 / len(channels) for c, e in effects.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_markov_matches_a_direct_loop(spark, seed):
    """The hot journey is longer than a range partition, so its pieces are put together."""
    rows = random_touches(seed, hot=900)
    df = spark.createDataFrame(rows, TOUCHES).repartition(5)
    counts, shares = markov_by_hand(rows)
    name = {("start",): "Start", ("conv",): "Conversion", ("null",): "Null"}
    want = {(name.get(a, f"channel:{a[-1]}"), name.get(b, f"channel:{b[-1]}")): n for a, to in counts.items() for b, n in to.items()}
    assert {(r["from_state"], r["to_state"]): r["n"] for r in markov.transition_counts(df).collect()} == want
    got = {r["channel"]: r["markov_weight"] for r in markov.markov(df).collect()}
    assert got == pytest.approx(shares, abs=6e-5)


def test_markov_without_conversions_shares_equally(spark):
    rows = [(f"t{i}", f"c{i}", datetime(2024, 1, 1), c, 0, 0.0) for i, c in enumerate(["a", "b", "b", "d"])]
    got = {r["channel"]: r["markov_weight"] for r in markov.markov(spark.createDataFrame(rows, TOUCHES)).collect()}
    assert got == {"a": 0.3333, "b": 0.3333, "d": 0.3333}


def test_comparison_and_long_form(spark):
    df = spark.createDataFrame(random_touches(6), TOUCHES)
    both = attribution.compare(attribution.rule_based(df), markov.markov(df))
    assert both.where("markov_weight is null").count() == 0
    assert attribution.conversions_by_model(both).count() == 4 * both.count()
