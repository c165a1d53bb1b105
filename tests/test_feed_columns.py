"""Feeds are described column by column, without a copy of every row per column."""

from __future__ import annotations

from clientele.plans import checks_sources
from clientele.plans.views import Views


def test_rows_are_not_expanded(spark):
    described = checks_sources.QUERIES["s01_raw_feeds"](Views(spark, "/root/testdata/sf0.001"))
    assert "Expand" not in described._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r["feed"], r["column_name"]): r for r in described.collect()}
    key, absent = rows["events", "event_id"], rows["identities", "created_at"]
    assert key["rows"] == key["known"] == key["values"] > 0
    assert absent["rows"] > 0 and absent["known"] == absent["values"] == 0 and absent["least"] is None
