"""Registered queries for the feeds and table loads, and their check SQL."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import functions as F

from clientele.operators import identity
from clientele.plans.checks_identity import resolved
from clientele.plans.inputs import feature_table, flags_as_text, plain, rounded
from clientele.sources import feeds, warehouse
from clientele.sources.schemas import FEEDS
from clientele.sources.scratch import checkpoint_root

# Fixed value: the load time of the registered queries.
NOW = datetime(2026, 1, 1)

FEED_VIEWS = {
    "entities": "view_entities",
    "identities": "view_identities",
    "transactions": "feed_transactions",
    "events": "feed_events",
    "touchpoints": "feed_touchpoints",
    "consents": "feed_consents",
}


def _folder(v, name):
    return f"{checkpoint_root(v.spark)}/{name}-{uuid.uuid4().hex}"


def _as_text(name, kind):
    """A value as text that both engines write alike."""
    if kind == "timestamp":
        return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if kind == "double":
        return F.when(F.isnan(name), "NaN").otherwise(F.col(name).try_cast("decimal(28,6)").cast("string"))
    return F.col(name).cast("string")


def _raw_feeds(v):
    """Write the feeds as folders, read them back with their schemas, and describe every column by value."""
    root = _folder(v, "feeds")
    for name, view in FEED_VIEWS.items():
        v[view].write.parquet(f"{root}/{name}")

    def described(feed, name, kind, df):
        # One narrow shuffle per column, of its distinct values; they become text only after that.
        values = df.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("rows"))
        texts = values.groupBy(_as_text("value", kind).alias("text")).agg(F.sum("rows").alias("rows"))
        return texts.agg(
            F.lit(feed).alias("feed"), F.lit(name).alias("column_name"), F.lit(kind).alias("kind"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("text").isNotNull(), F.col("rows"))), F.lit(0)).alias("known"),
            F.count("text").alias("values"), F.min("text").alias("least"), F.max("text").alias("greatest"),
        )

    return reduce(
        lambda left, right: left.unionByName(right),
        [described(feed, name, kind, df) for feed, df in feeds.read_feeds(v.spark, root).items() for name, kind in df.dtypes],
    )


def _mapping(v):
    return identity.entity_map(resolved(v))


def _mapped(v):
    feed = identity.with_unified_id(v["feed_touchpoints"], _mapping(v))
    return feed.select("touchpoint_id", "entity_id", "unified_customer_id")


def _identity_map(v):
    return plain(identity.identity_map(resolved(v)).withColumn("created_at", F.lit(NOW)))


def _fact(feed, table):
    return lambda v: plain(warehouse.fact_rows(v[feed], _mapping(v), table))


def _stored_features(v):
    store = warehouse.Warehouse(v.spark, _folder(v, "warehouse"))
    return plain(
        store.replace("customer_features", feature_table(v).withColumn("computed_at", F.lit(NOW)))
    )


def _adhoc(v):
    warehouse.register(v["view_transactions"], "transaction_fact")
    return rounded(
        warehouse.query(
            v.spark,
            """select channel, count(*) as orders, cast(sum(cast(revenue as decimal(28, 6))) as double) as revenue
               from transaction_fact group by channel""",
        ),
        2,
    )


def _bound(v):
    warehouse.register(v["view_transactions"], "transaction_fact")
    return warehouse.query_params(
        v.spark,
        "select order_id, revenue from transaction_fact where channel = :channel and revenue >= :least",
        {"channel": "paid_search", "least": 100000.0},
    )


def _registered(v):
    warehouse.register(v["view_consent"], "consent_preference")
    return v.spark.table("consent_preference").select("unified_customer_id", "tracking_consent", "third_party_sharing")


QUERIES = {
    "s01_raw_feeds": _raw_feeds,
    "s02_unified_ids_on_feed": _mapped,
    "s03_customer_profile": lambda v: plain(
        warehouse.profile_rows(v["view_entities"], _mapping(v), NOW)
    ),
    "s04_identity_map": _identity_map,
    "s05_transaction_fact": _fact("feed_transactions", "transaction_fact"),
    "s06_event_fact": _fact("feed_events", "event_fact"),
    "s07_campaign_touchpoint": _fact("feed_touchpoints", "campaign_touchpoint"),
    "s08_consent_preference": lambda v: flags_as_text(
        plain(warehouse.consent_rows(v["feed_consents"], _mapping(v)))
    ),
    "s09_store_customer_features": _stored_features,
    "s10_adhoc_sql": _adhoc,
    "s11_bound_parameters": _bound,
    "s12_registered_frame": _registered,
}

_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') as {0}"


# Columns of the feeds that the derived views do not have; they are read as nulls.
_ABSENT = {"entities": ("churn_propensity", "cltv_archetype", "preferred_channel"), "identities": ("created_at",)}


def _described(feed: str) -> list[str]:
    """One row per column of a feed: kind, known and distinct values, least and greatest."""
    texts = []
    for name, kind in (field.split() for field in FEEDS[feed].split(",")):
        text = {
            "timestamp": f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f')",
            "double": f"case when isnan({name}) then 'NaN' else cast(try_cast({name} as decimal(28, 6)) as varchar) end",
        }.get(kind, f"cast({name} as varchar)")
        if name in _ABSENT.get(feed, ()):
            text = "cast(null as varchar)"
        texts.append(f"""
            select '{feed}' as feed, '{name}' as column_name, '{kind}' as kind, count(*) as rows, count({text}) as known,
                   count(distinct {text}) as values, min({text}) as least, max({text}) as greatest from {{{FEED_VIEWS[feed]}}}
        """)
    return texts


SQL = {
    "s01_raw_feeds": " union all ".join(text for feed in FEED_VIEWS for text in _described(feed)),
    "s02_unified_ids_on_feed": """
        select touchpoint_id, entity_id, unified_customer_id from {feed_touchpoints} left join {id_unified} using (entity_id)
    """,
    "s03_customer_profile": f"""
        select * replace ({_STAMP.format("created_at")}), '2026-01-01 00:00:00.000000' as updated_at from {{id_golden}}
    """,
    "s04_identity_map": "select *, '2026-01-01 00:00:00.000000' as created_at from {id_map}",
    "s05_transaction_fact": f"""
        select order_id, unified_customer_id, {_STAMP.format("order_timestamp")}, revenue, gross_margin, channel, payment_status, items_count
        from {{feed_transactions}} left join {{id_unified}} using (entity_id)
    """,
    "s06_event_fact": f"""
        select event_id, unified_customer_id, {_STAMP.format("event_timestamp")}, event_type, page_url, session_id, device_type
        from {{feed_events}} left join {{id_unified}} using (entity_id)
    """,
    "s07_campaign_touchpoint": f"""
        select touchpoint_id, unified_customer_id, {_STAMP.format("event_timestamp")}, channel, campaign_name, conversion_flag, order_id,
               attributed_revenue
        from {{feed_touchpoints}} left join {{id_unified}} using (entity_id)
    """,
    "s08_consent_preference": f"""
        select unified_customer_id, cast(marketing_opt_in as varchar) as marketing_opt_in, cast(tracking_consent as varchar) as tracking_consent,
               cast(third_party_sharing as varchar) as third_party_sharing, cast(do_not_track as varchar) as do_not_track,
               {_STAMP.format("updated_at")}
        from (select *, row_number() over (partition by unified_customer_id order by updated_at desc, entity_id desc) as rn
              from {{feed_consents}} join {{id_unified}} using (entity_id)) where rn = 1
    """,
    "s09_store_customer_features": """
        select * replace (cast(unified_customer_id as varchar) as unified_customer_id, cast(churn_risk as double) as churn_risk), '2026-01-01 00:00:00.000000' as computed_at from {feature_table}
    """,
    "s10_adhoc_sql": """
        select channel, count(*) as orders, round(cast(sum(cast(revenue as decimal(28, 6))) as double), 2) as revenue
        from {view_transactions} group by channel
    """,
    "s11_bound_parameters": """
        select order_id, revenue from {view_transactions} where channel = 'paid_search' and revenue >= 100000
    """,
    "s12_registered_frame": "select unified_customer_id, tracking_consent, third_party_sharing from {view_consent}",
}
