"""Keyed loads and streams against a load of everything at once."""

from __future__ import annotations

import glob
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clientele.operators import keyed
from clientele.sources import warehouse
from clientele.sources.feeds import conform
from clientele.sources.schemas import FEEDS, TABLES
from clientele.sources.warehouse import Warehouse, fact_rows
from clientele.streaming import intake

NOW = datetime(2026, 1, 1)
DAY = datetime(2024, 3, 1, 12)
EVENT = TABLES["event_fact"]


def event(key, days, kind="view", who="C1"):
    return (key, who, DAY + timedelta(days=days) if days is not None else None, kind, "p", "s", "mobile")


@pytest.fixture
def store(spark, tmp_path):
    made = Warehouse(spark, str(tmp_path / "warehouse"))
    made.ensure_tables()
    return made


def events(spark, rows):
    return spark.createDataFrame(rows, " ".join(EVENT.split()))


def content(store):
    return {(r["event_id"], r["event_type"], r["event_timestamp"]) for r in store.read("event_fact").collect()}


def files(store):
    names = glob.glob(f"{store.path('event_fact')}/date_part=*/*.parquet")
    found = {}
    for name in names:
        found.setdefault(os.path.basename(os.path.dirname(name)), set()).add(os.path.basename(name))
    return found


def rejected(store):
    return sorted((r["reason"], r["row_key"]) for r in store.read("rejected_row").collect())


def test_split_by_key(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), (None, 9, "n"), ("b", None, "u"), ("b", 1, "v"), ("c", 5, "w"), ("c", 5, "w"), ("d", None, "q")]
    df = spark.createDataFrame(rows, "k string, t int, _number string").repartition(3)
    kept, others = keyed.split_by_key(df, ["k"], "t")
    assert sorted(tuple(r) for r in kept.collect() if r["k"] != "d") == [("a", 3, "y"), ("b", 1, "v"), ("c", 5, "w")]
    assert sorted((str(r["k"]), r["_number"], r["reason"]) for r in others.collect()) == [
        ("None", "n", "missing_key"), ("a", "x", "repeated_key"), ("a", "z", "repeated_key"), ("b", "u", "repeated_key"), ("c", "w", "repeated_key"),
    ]
    assert kept.columns == ["k", "t", "_number"]


def test_only_touched_dates_are_rewritten(spark, store):
    store.replace("event_fact", events(spark, [event("1", 0), event("2", 1), event("3", 2), event("4", 3)]))
    before = files(store)
    batch = events(spark, [event("2", 1, "buy"), event("2", 1.1, "newest"), event("5", 5), event(None, 1), event("3", 1, "stale"), event("4", 3)])
    assert store.upsert("event_fact", batch, NOW) == {"coming": 2, "rejected": 3, "dates": 2}
    assert {(k, t) for k, t, _ in content(store)} == {("1", "view"), ("2", "newest"), ("3", "view"), ("4", "view"), ("5", "view")}
    after = files(store)
    same = {date for date in before if after.get(date) == before[date]}
    assert same == {"date_part=2024-03-01", "date_part=2024-03-03", "date_part=2024-03-04"}
    assert rejected(store) == [("missing_key", None), ("older_than_stored", "3"), ("repeated_key", "2")]


def test_the_same_batch_again_changes_no_file(spark, store):
    store.replace("event_fact", events(spark, [event("1", 0)]))
    batch = events(spark, [event("1", 0, "buy"), event("2", 0)])
    store.upsert("event_fact", batch, NOW)
    before, rows = files(store), content(store)
    assert store.upsert("event_fact", batch, NOW)["dates"] <= 1
    assert content(store) == rows
    accepted = events(spark, [tuple(r)[:7] for r in store.read("event_fact").select(*batch.columns).collect()])
    before = files(store)
    assert store.upsert("event_fact", accepted, NOW) == {"coming": 0, "rejected": 0, "dates": 0}
    assert files(store) == before


def test_a_row_may_move_to_another_date(spark, store):
    store.replace("event_fact", events(spark, [event("1", 0), event("2", 1), event("3", None)]))
    store.upsert("event_fact", events(spark, [event("1", 4, "moved"), event("3", 6)]), NOW)
    assert set(files(store)) == {"date_part=2024-03-02", "date_part=2024-03-05", "date_part=2024-03-07"}
    assert {(k, t) for k, t, _ in content(store)} == {("1", "moved"), ("2", "view"), ("3", "view")}


def test_order_of_batches_does_not_matter(spark, tmp_path):
    batches = [[event("1", 0, "a"), event("2", 0, "b")], [event("1", 0, "c"), event("2", 2, "d")], [event("1", 0, "e"), event("2", 1, "f")], []]
    ends = []
    for number, order in enumerate([(0, 1, 2, 3), (3, 2, 1, 0), (1, 0, 2, 1)]):
        made = Warehouse(spark, str(tmp_path / f"w{number}"))
        made.ensure_tables()
        for at in order:
            made.upsert("event_fact", events(spark, batches[at]), NOW)
        ends.append(content(made))
    assert ends[0] == ends[1] == ends[2] and len(ends[0]) == 2


def test_a_hot_key_and_a_table_without_dates(spark, store):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("C"), "id")).alias("unified_customer_id"),
        (F.col("id") % 2 == 0).alias("marketing_opt_in"), (F.lit(DAY) + F.make_interval(secs=F.col("id"))).alias("updated_at"),
    )
    counts = store.upsert("consent_preference", rows, NOW)
    assert counts["coming"] == 1001 and counts["rejected"] == 1999
    hot = store.read("consent_preference").where("unified_customer_id = 'hot'").collect()
    assert len(hot) == 1 and hot[0]["marketing_opt_in"] is False


def test_a_failing_write_leaves_the_table(spark, store):
    store.replace("event_fact", events(spark, [event("1", 0)]))
    broken = events(spark, [event("1", 0, "x")]).withColumn("page_url", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.upsert("event_fact", broken, NOW)
    assert {k for k, _, _ in content(store)} == {"1"}


def test_a_stream_ends_as_a_batch_load(spark, store, tmp_path):
    source, checkpoint = str(tmp_path / "feed"), str(tmp_path / "checkpoint")
    feed = spark.range(400).select(
        F.when(F.col("id") % 50 == 7, F.lit(None)).otherwise((F.col("id") % 300).cast("string")).alias("event_id"),
        F.concat(F.lit("E"), F.col("id") % 9).alias("entity_id"), (F.lit(DAY) + F.make_interval(mins=F.col("id") * 40)).alias("event_timestamp"),
        F.lit("view").alias("event_type"),
    )
    feed = conform(feed, FEEDS["events"])
    mapping = spark.createDataFrame([(f"E{n}", f"U{n % 4}") for n in range(8)], "raw_entity_id string, unified_customer_id string")
    parts = [feed.where(F.pmod(F.crc32(F.col("entity_id")), F.lit(4)) == n) for n in range(4)]
    for n in (3, 0):
        parts[n].coalesce(1).write.mode("append").parquet(source)
    intake.run_available(store, "event_fact", source, mapping, checkpoint, files_per_batch=1)
    some = store.read("event_fact").count()
    for n in (1, 0, 2):  # one part is delivered twice
        parts[n].coalesce(1).write.mode("append").parquet(source)
    again = Warehouse(spark, store.root)
    intake.run_available(again, "event_fact", source, mapping, checkpoint)
    intake.run_available(again, "event_fact", source, mapping, checkpoint)  # nothing new
    at_once = Warehouse(spark, str(tmp_path / "batch"))
    at_once.ensure_tables()
    at_once.upsert("event_fact", fact_rows(feed, mapping, "event_fact"), NOW)
    assert 0 < some < again.read("event_fact").count()
    rows = lambda w: sorted(map(repr, w.read("event_fact").select(*feed.columns[:1], "unified_customer_id", "event_timestamp").collect()))
    assert rows(again) == rows(at_once)


def test_equal_rows_with_gaps_change_nothing_and_others_are_told(spark, store):
    """A stored row with a null comes again: it is no older one; one of the same time with the gap elsewhere is."""
    row = ("1", None, DAY, "view", None, "s", "mobile")
    moved = ("1", None, DAY, "view", "s", None, "mobile")  # the hash that orders rows skips nulls
    store.replace("event_fact", events(spark, [row]))
    before = files(store)
    assert store.upsert("event_fact", events(spark, [row]), NOW) == {"coming": 0, "rejected": 0, "dates": 0}
    assert store.upsert("event_fact", events(spark, [moved]), NOW) == {"coming": 0, "rejected": 1, "dates": 0}
    assert files(store) == before and rejected(store) == [("older_than_stored", "1")]


def test_a_batch_is_shuffled_as_a_whole_only_once(spark, store, monkeypatch):
    """The rows of a batch are told apart by one pass, not by one for each kind, and are written twice at most."""
    written = []
    real = warehouse.materialise
    monkeypatch.setattr(warehouse, "materialise", lambda df, label: written.append(df.columns) or real(df, label))
    store.replace("event_fact", events(spark, [event("1", 0), event("2", 1)]))
    written.clear()
    store.upsert("event_fact", events(spark, [event("1", 3), event("2", 0), event("3", 1), event(None, 1)]), NOW)
    assert sum("page_url" in columns for columns in written) == 2
    assert content(store) == {(k, "view", DAY + timedelta(days=d)) for k, d in (("1", 3), ("2", 1), ("3", 1))}
