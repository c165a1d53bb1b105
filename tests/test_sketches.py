"""Session sketches against exact counts."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from clientele.operators import sketches

EVENT = "unified_customer_id string, event_timestamp timestamp, session_id string"
LAST = date(2024, 1, 31)


def exact(rows, days):
    found: dict[str, set] = {}
    for who, when, session in rows:
        if who and when and session and LAST - timedelta(days=days) < when.date() <= LAST:
            found.setdefault(who, set()).add(session)
    return {who: len(s) for who, s in found.items()}


def test_small_counts_are_exact(spark):
    noon = datetime(2024, 1, 31, 12)
    rows = [("a", noon - timedelta(days=n), f"s{n % 9}") for n in range(40)] + [("b", noon - timedelta(days=20), "x")]
    rows += [(None, noon, "x"), ("c", None, "x"), ("d", noon, None), ("e", noon + timedelta(days=1), "y"), ("f", noon - timedelta(days=7), "z")]
    days = sketches.daily_sketches(spark.createDataFrame(rows, EVENT))
    got = {r[0]: (r["sessions_7d"], r["sessions_30d"]) for r in sketches.window_sessions(days, LAST).collect()}
    week, month = exact(rows, 7), exact(rows, 30)
    assert got == {who: (week.get(who, 0), n) for who, n in month.items()} and set(got) == {"a", "b", "f"}
    assert sketches.window_sessions(days.where("false"), LAST).count() == 0


def test_large_counts_stay_within_the_error_and_merge(spark):
    """A customer with most of all sessions, brought in two batches that share days."""
    frame = spark.range(120_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("unified_customer_id"),
        (F.lit(datetime(2024, 1, 31)) - F.make_interval(days=(F.col("id") % 29).cast("int"))).alias("event_timestamp"),
        (F.col("id") % 40_000).cast("string").alias("session_id"),
    )
    first, second = (sketches.daily_sketches(frame.where(F.col("id") % 2 == n)) for n in (0, 1))
    merged = sketches.merged_days(first, second)
    assert merged.count() == merged.select("unified_customer_id", "day").distinct().count()
    got = {r[0]: r for r in sketches.window_sessions(merged, LAST).collect()}
    whole = {r[0]: r for r in sketches.window_sessions(sketches.daily_sketches(frame), LAST).collect()}
    for n in (7, 30):
        counted = frame.where(F.col("event_timestamp") > F.lit(datetime(2024, 1, 31)) - F.make_interval(days=F.lit(n)))
        want = {r[0]: r["n"] for r in counted.groupBy("unified_customer_id").agg(F.countDistinct("session_id").alias("n")).collect()}
        for who, row in got.items():
            bound = 4 * sketches.standard_error() * want[who] + 0.5
            assert abs(row[f"sessions_{n}d"] - want[who]) <= bound and abs(whole[who][f"sessions_{n}d"] - want[who]) <= bound
