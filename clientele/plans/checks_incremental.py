"""Registered queries for batch-by-batch identity, keyed loads and streams, and their check SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clientele.operators import identity, merging, sketches
from clientele.plans.checks_identity import LOOSE_THRESHOLD, THRESHOLD, resolved
from clientele.plans.checks_sources import NOW
from clientele.plans.inputs import feature_table, flags_as_text, plain
from clientele.sources.schemas import FEEDS, TABLES
from clientele.sources.feeds import conform
from clientele.sources.scratch import checkpoint_root, materialise
from clientele.sources.warehouse import Warehouse, fact_rows
from clientele.streaming import intake

#: Batches that the links are dealt to by their entity, so that clusters of one batch are merged by the next.
BATCHES = 3


def _folder(v, name):
    return f"{checkpoint_root(v.spark)}/{name}-{uuid.uuid4().hex}"


def _merged(v, threshold):
    """The stored clusters after all batches, each merged into what the earlier ones left."""
    store = Warehouse(v.spark, _folder(v, "clusters"))
    store.ensure_tables()
    for number in range(BATCHES):
        links = v["view_identities"].where(F.pmod(F.crc32("canonical_entity_id"), F.lit(BATCHES)) == number)
        entities = v["view_entity_ids"].where(F.pmod(F.crc32("entity_id"), F.lit(BATCHES)) == number)
        store.merge_identities(links, threshold, entities)
    return store.clusters()


def _loaded_events(v):
    """Events loaded at once and then brought up to date by a batch of late, repeated and revised rows."""
    store = Warehouse(v.spark, _folder(v, "events"))
    store.ensure_tables()
    mapping = identity.entity_map(resolved(v))
    store.replace("event_fact", fact_rows(v["feed_early_rows"], mapping, "event_fact"))
    store.upsert("event_fact", fact_rows(v["feed_late_rows"], mapping, "event_fact"), NOW)
    return store


def _rejected(v):
    rows = _loaded_events(v).read("rejected_row")
    when = F.to_timestamp(F.get_json_object("content", "$.event_timestamp"))
    return plain(rows.select("table_name", "reason", "row_key", when.alias("event_timestamp"), "rejected_at"))


def _streamed(v, table, feed, view, parts):
    """A feed split into files, half of them brought in by a first run and the rest after a restart, some twice."""
    source, files = _folder(v, "files"), conform(v[view], FEEDS[feed])
    key = files.columns[0]
    part = F.pmod(F.crc32(F.col(key)), F.lit(parts))
    store = Warehouse(v.spark, _folder(v, table))
    store.ensure_tables()
    mapping, checkpoint = identity.entity_map(resolved(v)), _folder(v, "checkpoint")
    for numbers in (range(parts // 2), range(parts // 2 - 1, parts)):  # one part comes again
        files.where(part.isin(list(numbers))).write.mode("append").parquet(source)
        intake.run_available(store, table, source, mapping, checkpoint)
    return plain(conform(store.read(table), TABLES[table]))


def _stored_customer(v):
    """One customer's profile, features and consent, looked up in stored tables."""
    store = Warehouse(v.spark, _folder(v, "customers"))
    tables = {"customer_profile": v["view_profiles"], "customer_features": feature_table(v), "consent_preference": v["view_consent"]}
    for name, rows in tables.items():
        store.replace(name, rows)
    found = identity.customer_360(*(store.of_customer(name, "7") for name in tables))
    return flags_as_text(plain(found.drop("updated_at").withColumn("unified_customer_id", F.col("unified_customer_id").cast("bigint"))))


def _sketched_sessions(v):
    """Exact counts of sessions in the last 7 and 30 days, and whether estimates from daily sketches agree."""
    events = v["view_events"]
    as_of = materialise(events, "events").agg(F.max(F.to_date("event_timestamp"))).first()[0]
    halves = [events.where(F.pmod("event_id", F.lit(2)) == n) for n in (0, 1)]
    days = sketches.merged_days(*(sketches.daily_sketches(half) for half in halves))
    estimated = sketches.window_sessions(days, as_of)
    day = F.to_date("event_timestamp")
    exact = events.where(day > F.date_sub(F.lit(as_of), 30)).groupBy("unified_customer_id").agg(
        *[
            F.countDistinct(F.when(day > F.date_sub(F.lit(as_of), n), F.col("session_id"))).alias(f"exact_{n}d")
            for n in (7, 30)
        ]
    )

    def agrees(n):
        bound = 3 * sketches.standard_error() * F.col(f"exact_{n}d") + 0.5
        return (F.abs(F.col(f"sessions_{n}d") - F.col(f"exact_{n}d")) <= bound).alias(f"agrees_{n}d")

    return exact.join(estimated, "unified_customer_id").select("unified_customer_id", "exact_7d", "exact_30d", agrees(7), agrees(30))


QUERIES = {
    "l03_sketched_sessions": _sketched_sessions,
    "i09_stored_customer": _stored_customer,
    "i04_merged_components": lambda v: merging.entity_roots(_merged(v, THRESHOLD)),
    "i04_merged_components_loose": lambda v: merging.entity_roots(_merged(v, LOOSE_THRESHOLD)),
    "i06_merged_map": lambda v: merging.resolved(_merged(v, THRESHOLD)),
    "s06_upserted_events": lambda v: plain(conform(_loaded_events(v).read("event_fact"), TABLES["event_fact"])),
    "s06_rejected_events": _rejected,
    "s06_streamed_events": lambda v: _streamed(v, "event_fact", "events", "feed_events", 4),
    "s08_streamed_consents": lambda v: flags_as_text(_streamed(v, "consent_preference", "consents", "feed_dated_consents", 4)),
}

_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') as {0}"

PARTS = {
    # Rows of the late batch by key, newest first, and what the table held.
    "late_ranked": """
        select *, row_number() over (partition by event_id order by event_timestamp desc) as rn from {feed_late_rows}
    """,
    "late_newest": "select * from {late_ranked} where rn = 1 and event_id is not null",
    "upserted": """
        select coalesce(l.event_id, e.event_id) as event_id,
               case when l.event_id is not null and (e.event_id is null or l.event_timestamp > e.event_timestamp) then l.entity_id else e.entity_id end as entity_id,
               case when l.event_id is not null and (e.event_id is null or l.event_timestamp > e.event_timestamp) then l.event_timestamp else e.event_timestamp end as event_timestamp,
               case when l.event_id is not null and (e.event_id is null or l.event_timestamp > e.event_timestamp) then l.event_type else e.event_type end as event_type,
               coalesce(e.page_url, l.page_url) as page_url, coalesce(e.session_id, l.session_id) as session_id, coalesce(e.device_type, l.device_type) as device_type
        from {feed_early_rows} e full join {late_newest} l on e.event_id = l.event_id
    """,
}

SQL = {
    "l03_sketched_sessions": """
        select unified_customer_id, count(distinct case when cast(event_timestamp as date) > as_of - 7 then session_id end) as exact_7d,
               count(distinct session_id) as exact_30d, true as agrees_7d, true as agrees_30d
        from {view_events}, (select max(cast(event_timestamp as date)) as as_of from {view_events})
        where cast(event_timestamp as date) > as_of - 30 group by unified_customer_id
    """,
    "i09_stored_customer": "select * from ({customer_360}) where unified_customer_id = 7",
    "i04_merged_components": "select entity_id, root_id from {id_roots}",
    "i04_merged_components_loose": "select entity_id, root_id from {id_roots_loose}",
    "i06_merged_map": "select * from {id_resolved}",
    "s06_upserted_events": f"""
        select event_id, unified_customer_id, {_STAMP.format("event_timestamp")}, event_type, page_url, session_id, device_type
        from {{upserted}} left join {{id_unified}} using (entity_id)
    """,
    "s06_rejected_events": f"""
        select 'event_fact' as table_name, case when l.event_id is null then 'missing_key' when rn > 1 then 'repeated_key' else 'older_than_stored' end as reason,
               l.event_id as row_key, strftime(l.event_timestamp, '%Y-%m-%d %H:%M:%S.%f') as event_timestamp,
               '2026-01-01 00:00:00.000000' as rejected_at
        from {{late_ranked}} l left join {{feed_early_rows}} e on l.event_id = e.event_id
        where l.event_id is null or rn > 1 or l.event_timestamp < e.event_timestamp
    """,
    "s06_streamed_events": f"""
        select event_id, unified_customer_id, {_STAMP.format("event_timestamp")}, event_type, page_url, session_id, device_type
        from {{feed_events}} left join {{id_unified}} using (entity_id)
    """,
    "s08_streamed_consents": f"""
        select unified_customer_id, cast(marketing_opt_in as varchar) as marketing_opt_in, cast(tracking_consent as varchar) as tracking_consent,
               cast(third_party_sharing as varchar) as third_party_sharing, cast(do_not_track as varchar) as do_not_track,
               {_STAMP.format("updated_at")}
        from (select *, row_number() over (partition by unified_customer_id order by updated_at desc, entity_id desc) as rn
              from {{feed_dated_consents}} join {{id_unified}} using (entity_id)) where rn = 1
    """,
}
