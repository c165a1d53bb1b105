"""Customer-data shapes derived from the given tables.

Each text runs unchanged on Spark and on DuckDB.  ``{name}`` refers to a given table,
to another view, or (DuckDB only) to a named part of a check query.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # Raw profiles: customers, and suppliers as prospects who never bought.
    "view_entities": """
        select concat('ENT_', lpad(cast(c_custkey as string), 7, '0')) as entity_id,
               c_custkey as customer_key,
               concat('F', cast(c_custkey % 97 as string)) as first_name,
               concat('L', cast(c_custkey % 89 as string)) as last_name,
               case when c_custkey % 40 = 39 then null
                    else concat('cust', cast(c_custkey as string), '@mail', cast(c_custkey % 5 as string), '.example.com') end as email,
               case when c_custkey % 30 = 29 then null
                    else concat('555', lpad(cast(c_custkey % 10000000 as string), 7, '0')) end as phone,
               n_name as city, r_name as country, timestamp '1995-01-01 00:00:00' as created_at,
               case when c_custkey % 20 < 8 then 'active' when c_custkey % 20 < 11 then 'churned' else 'none' end as subscription_status
        from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
        union all
        select concat('PRO_', lpad(cast(s_suppkey as string), 7, '0')), -1 - s_suppkey, s_name, null, null, null,
               n_name, r_name, timestamp '1996-01-01 00:00:00', 'none'
        from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
    """,
    # Identity links: cookies overlap in chains of seven, phones join four chains each.
    "view_identities": """
        select 'salesforce_crm' as source_system, 'crm_id' as identifier_type,
               concat('CRM_', cast(c_custkey as string)) as identifier_value,
               concat('ENT_', lpad(cast(c_custkey as string), 7, '0')) as canonical_entity_id,
               cast(1.0 as double) as confidence_score from {customer}
        union all
        select 'marketing_cloud', 'email',
               concat(case when c_custkey % 2 = 0 then '  CUST' else 'cust' end, cast(c_custkey as string), '@mail.example.com'),
               concat('ENT_', lpad(cast(c_custkey as string), 7, '0')), cast(1.0 as double) from {customer}
        union all
        select 'web_sdk', 'cookie_id', concat('ck_', cast(c_custkey as string)),
               concat('ENT_', lpad(cast(c_custkey as string), 7, '0')), cast(0.85 as double) from {customer}
        union all
        select 'web_sdk', 'cookie_id',
               concat('CK_', cast(case when c_custkey % 7 = 6 then c_custkey else c_custkey + 1 end as string)),
               concat('ENT_', lpad(cast(c_custkey as string), 7, '0')), cast(0.80 as double) from {customer}
        union all
        select 'mobile_app', 'device_id', concat('idfa_', cast(c_custkey as string)),
               concat('ENT_', lpad(cast(c_custkey as string), 7, '0')), cast(0.90 as double) from {customer}
        union all
        select 'guest_checkout', 'phone', concat('555', cast(c_custkey - c_custkey % 28 as string)),
               concat('ENT_', lpad(cast(c_custkey as string), 7, '0')), cast(0.72 as double) from {customer}
        union all
        select 'partner_file', 'phone', case when s_suppkey % 2 = 0 then null else '  ' end,
               concat('PRO_', lpad(cast(s_suppkey as string), 7, '0')), cast(1.0 as double) from {supplier}
        union all
        select 'partner_file', 'email', s_name,
               concat('PRO_', lpad(cast(s_suppkey as string), 7, '0')), cast('NaN' as double) from {supplier}
    """,
    # Ids of all entities, and the profile columns that the analytics read, without the joins.
    "view_entity_ids": """
        select concat('ENT_', lpad(cast(c_custkey as string), 7, '0')) as entity_id from {customer}
        union all select concat('PRO_', lpad(cast(s_suppkey as string), 7, '0')) from {supplier}
    """,
    "view_customers": """
        select c_custkey as unified_customer_id,
               case when c_custkey % 20 < 8 then 'active' when c_custkey % 20 < 11 then 'churned' else 'none' end as subscription_status
        from {customer}
        union all select -1 - s_suppkey, 'none' from {supplier}
    """,
    "view_profiles": """
        select customer_key as unified_customer_id, email as primary_email, phone as primary_phone,
               first_name, last_name, city, country, subscription_status, created_at
        from {view_entities}
    """,
    "view_transactions": """
        select concat('ORD_', cast(o_orderkey as string)) as order_id, o_custkey as unified_customer_id,
               o_orderdate as order_timestamp, o_totalprice as revenue,
               o_totalprice * (0.35 + 0.0003 * (o_orderkey % 1000)) as gross_margin,
               case o_orderkey % 7 when 0 then 'paid_search' when 1 then 'paid_social' when 2 then 'organic_search'
                    when 3 then 'email_marketing' when 4 then 'direct' when 5 then 'referral' else 'display' end as channel,
               'completed' as payment_status, cast(coalesce(items, 0) as int) as items_count
        from {orders} left join (select l_orderkey, count(*) as items from {lineitem} group by l_orderkey) li
             on o_orderkey = l_orderkey
    """,
    "view_events": """
        select event_id, user_id as unified_customer_id, ts as event_timestamp,
               case when event_id % 100 < 40 then 'page_view' when event_id % 100 < 65 then 'product_view'
                    when event_id % 100 < 77 then 'pricing_view' when event_id % 100 < 87 then 'add_to_cart'
                    when event_id % 100 < 93 then 'checkout_step' when event_id % 100 < 97 then 'lead_form_submitted'
                    else 'support_ticket' end as event_type,
               concat('https://shop.example.com/p/', cast(event_id % 500 as string)) as page_url,
               concat(cast(user_id as string), '_', cast(cast(ts as date) as string)) as session_id,
               case event_id % 3 when 0 then 'desktop' when 1 then 'mobile' else 'tablet' end as device_type
        from {events}
    """,
    # The same events moved before the order cutoff, for lifetime value.
    "view_early_events": """
        select event_id, unified_customer_id, event_timestamp - interval 8400 day as event_timestamp, event_type,
               session_id, device_type
        from {view_events}
    """,
    # Purchases on the clock of the events, for lead scoring and experiments.
    "view_purchases": """
        select event_id as order_id, user_id as unified_customer_id, ts as order_timestamp, value as revenue,
               value * 0.5 as gross_margin
        from {events} where event_type = 'purchase'
    """,
    # Campaign touches; a journey is one user on one day.
    "view_touchpoints": """
        select event_id as touchpoint_id,
               concat(cast(user_id as string), '_', cast(cast(ts as date) as string)) as unified_customer_id,
               ts as event_timestamp,
               case (event_id + 3 * user_id) % 7 when 0 then 'paid_search' when 1 then 'paid_social' when 2 then 'organic_search'
                    when 3 then 'email_marketing' when 4 then 'direct' when 5 then 'referral' else 'display' end as channel,
               concat('camp_', cast(event_id % 12 as string)) as campaign_name,
               case when event_type = 'purchase' then 1 else 0 end as conversion_flag,
               case when event_type = 'purchase' then event_id end as order_id,
               case when event_type = 'purchase' then value else cast(0.0 as double) end as attributed_revenue
        from {events}
    """,
    # Consent; prospects have no row and some flags are null.
    "view_consent": """
        select c_custkey as unified_customer_id,
               case when c_custkey % 50 = 48 then null else c_custkey % 20 >= 3 end as marketing_opt_in,
               c_custkey % 10 <> 0 as tracking_consent, c_custkey % 20 >= 7 as third_party_sharing,
               case when c_custkey % 50 = 47 then null else c_custkey % 25 < 2 end as do_not_track,
               timestamp '2001-01-01 00:00:00' as updated_at
        from {customer}
    """,
    # The raw feeds, keyed by entity.
    "feed_transactions": """
        select order_id, concat('ENT_', lpad(cast(unified_customer_id as string), 7, '0')) as entity_id, order_timestamp,
               revenue, gross_margin, channel, payment_status, items_count
        from {view_transactions}
    """,
    "feed_events": """
        select cast(event_id as string) as event_id, concat('ENT_', lpad(cast(unified_customer_id as string), 7, '0')) as entity_id,
               event_timestamp, event_type, page_url, session_id, device_type
        from {view_events}
    """,
    "feed_touchpoints": """
        select cast(event_id as string) as touchpoint_id,
               case when event_type = 'error' then concat('GUEST_', cast(user_id as string))
                    else concat('ENT_', lpad(cast(user_id as string), 7, '0')) end as entity_id,
               ts as event_timestamp, concat('channel_', cast(event_id % 7 as string)) as channel,
               concat('camp_', cast(event_id % 12 as string)) as campaign_name,
               case when event_type = 'purchase' then 1 else 0 end as conversion_flag,
               case when event_type = 'purchase' then cast(event_id as string) end as order_id,
               case when event_type = 'purchase' then value else cast(0.0 as double) end as attributed_revenue
        from {events}
    """,
    "feed_consents": """
        select concat('ENT_', lpad(cast(unified_customer_id as string), 7, '0')) as entity_id, marketing_opt_in, tracking_consent,
               third_party_sharing, do_not_track, updated_at
        from {view_consent}
    """,
    "feed_dated_consents": """
        select entity_id, marketing_opt_in, tracking_consent, third_party_sharing, do_not_track,
               updated_at + cast(substring(entity_id, 5) as int) % 5000 * interval 1 minute as updated_at
        from {feed_consents}
    """,
    # Events loaded first, and a later batch: late rows, stored ones again, revised and outdated ones, some without a key.
    "feed_early_rows": "select * from {feed_events} where cast(event_id as bigint) % 5 <> 0",
    "feed_late_rows": """
        select * from {feed_events} where cast(event_id as bigint) % 5 in (0, 1)
        union all
        select event_id, entity_id, event_timestamp + interval 1 day, concat(event_type, '_revised'), page_url, session_id, device_type
        from {feed_events} where cast(event_id as bigint) % 10 in (5, 6, 7)
        union all
        select event_id, entity_id, event_timestamp - interval 1 hour, 'outdated', page_url, session_id, device_type
        from {feed_events} where cast(event_id as bigint) % 5 = 4
        union all
        select cast(null as string), entity_id, event_timestamp, event_type, page_url, session_id, device_type
        from {feed_events} where cast(event_id as bigint) % 50 = 3
    """,
    # Customers whose past tells their future: each spends in steps of their own, and a quarter looks at prices and buys.
    "signal_transactions": """
        select concat('ORD_', cast(o_orderkey as string)) as order_id, o_custkey as unified_customer_id, o_orderdate as order_timestamp,
               cast(100 + 100 * (o_custkey % 9) as double) as revenue, cast(50 as double) as gross_margin
        from {orders} where o_orderdate < timestamp '1998-01-01 00:00:00'
        union all
        select concat('NEXT_', cast(c_custkey as string)), c_custkey, timestamp '1998-03-01 00:00:00',
               cast(300 + 300 * (c_custkey % 9) as double), cast(150 as double)
        from {customer}
    """,
    "signal_events": """
        select o_orderkey as event_id, o_custkey as unified_customer_id,
               timestamp '2024-01-10 00:00:00' - (o_orderkey % 20) * interval 1 day as event_timestamp,
               case when o_custkey % 4 = 0 then 'pricing_view' else 'page_view' end as event_type,
               concat(cast(o_custkey as string), '_', cast(o_orderkey % 20 as string)) as session_id, 'desktop' as device_type
        from {orders}
    """,
    "signal_purchases": """
        select c_custkey as order_id, c_custkey as unified_customer_id, timestamp '2024-01-17 00:00:00' as order_timestamp,
               cast(10 as double) as revenue, cast(5 as double) as gross_margin
        from {customer} where c_custkey % 4 = 0 or c_custkey % 40 = 1
    """,
    # One audience per market segment and nation.
    "view_audience_members": """
        select concat('AUD_', c_mktsegment, '_', cast(c_nationkey as string)) as audience_id,
               c_custkey as unified_customer_id, timestamp '2001-01-01 00:00:00' as added_at
        from {customer}
    """,
    "view_audiences": """
        select audience_id, concat('Audience ', audience_id) as name, count(*) as audience_size,
               case when count(*) % 4 = 1 then 'REJECTED' else 'COMPLIANT' end as status
        from {view_audience_members} group by audience_id
    """,
    # Campaign requests, one per catalogue part; some name an unknown audience.
    "view_campaign_requests": """
        select concat('camp_', cast(p_partkey as string)) as campaign_name,
               concat('AUD_', case p_partkey % 6 when 0 then 'HOUSEHOLD' when 1 then 'MACHINERY' when 2 then 'FURNITURE'
                      when 3 then 'BUILDING' when 4 then 'AUTOMOBILE' else 'UNKNOWN' end, '_', cast(p_size % 25 as string)) as audience_id,
               case p_partkey % 3 when 0 then 'email_marketing' when 1 then 'paid_social' else 'display' end as channel,
               p_type as message_objective, concat(cast(p_size as string), '% off ', p_brand) as offer_discount,
               cast(1 + p_partkey % 3 as int) as frequency_cap, timestamp '2001-06-01 00:00:00' as requested_at
        from {part}
    """,
    # One approval per order; a few are already consumed.
    "view_approvals": """
        select concat('N', cast(o_orderkey as string)) as nonce, concat('camp_', cast(o_orderkey % 40 as string)) as campaign_name,
               concat('AUD_', case o_orderkey % 5 when 0 then 'HOUSEHOLD' when 1 then 'MACHINERY' when 2 then 'FURNITURE' when 3 then 'BUILDING' else 'AUTOMOBILE' end,
                      '_', cast(o_orderkey % 25 as string)) as audience_id,
               case o_orderkey % 3 when 0 then 'email_marketing' when 1 then 'paid_social' else 'display' end as channel,
               o_orderpriority as approved_by, o_orderdate as issued_at,
               o_orderdate + interval 60 day as expires_at,
               case when o_orderkey % 17 = 0 then o_orderdate + interval 1 day end as consumed_at,
               case when o_orderkey % 17 = 0 then 'earlier_run' end as consumed_by
        from {orders}
    """,
    # Approvals issued again for the same nonce; the newest of a batch counts.
    "view_reissued_approvals": """
        select concat('N', cast(l_orderkey + 7 as string)) as nonce, concat('camp_', cast(l_partkey % 40 as string)) as campaign_name,
               concat('AUD_', cast(l_suppkey % 25 as string)) as audience_id, 'email_marketing' as channel,
               concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-',
                      cast(cast(round(l_extendedprice * 100) as bigint) as string), '-', cast(cast(l_shipdate as date) as string)) as approved_by,
               l_shipdate as issued_at, l_shipdate + interval 60 day as expires_at
        from {lineitem}
    """,
    # Activation requests, one per order line: replays, late ones, wrong scopes, unknown nonces.
    "view_activation_requests": """
        select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-',
                      cast(cast(round(l_extendedprice * 100) as bigint) as string), '-', cast(cast(l_shipdate as date) as string)) as request_id,
               case when l_quantity > 48 then concat('X', cast(l_orderkey as string)) else concat('N', cast(l_orderkey as string)) end as nonce,
               concat('camp_', cast(case when l_quantity < 3 then 99 else l_orderkey % 40 end as string)) as campaign_name,
               concat('AUD_', case l_orderkey % 5 when 0 then 'HOUSEHOLD' when 1 then 'MACHINERY' when 2 then 'FURNITURE' when 3 then 'BUILDING' else 'AUTOMOBILE' end,
                      '_', cast(case when l_discount > 0.09 then 99 else l_orderkey % 25 end as string)) as audience_id,
               case when l_tax > 0.07 then 'direct' else case l_orderkey % 3 when 0 then 'email_marketing' when 1 then 'paid_social' else 'display' end end as channel,
               l_returnflag as requested_by, l_shipdate as requested_at
        from {lineitem}
    """,
    # Members of one activation.
    "view_experiment_members": """
        select 'ACT_SPRING' as activation_id, c_custkey as unified_customer_id from {customer}
    """,
}


def parts_of(text: str) -> list[str]:
    """Names in braces, in order of first use."""
    return list(dict.fromkeys(name for _, name, _, _ in Formatter().parse(text) if name))


_SCHEMAS: dict[str, T.StructType] = {}


class Views:
    """The given tables of one folder and the views on them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._built: dict[str, DataFrame] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        """One given table; time columns without a zone are read as UTC.

        The schema is read from the file once per path, each later read names it.
        """
        path = f"{self.sf_dir}/{name}.parquet"
        reader = self.spark.read
        if path in _SCHEMAS:
            reader = reader.schema(_SCHEMAS[path])
        df = reader.parquet(path)
        _SCHEMAS[path] = df.schema
        zoneless = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
        return df.withColumns(zoneless) if zoneless else df

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in TABLES:
                self._built[name] = self.table(name)
            else:
                text = VIEWS[name]
                parts = {part: self[part] for part in parts_of(text)}
                self._built[name] = self.spark.sql(text, **parts)
        return self._built[name]


def duck(text: str, parts: dict[str, str]) -> str:
    """Spell ``text`` for DuckDB: the views and check parts it names become a WITH list."""
    known = {**VIEWS, **parts}
    needed: dict[str, str] = {}

    def visit(body: str) -> None:
        for name in parts_of(body):
            if name in known and name not in needed:
                visit(known[name])
                needed[name] = known[name]

    visit(text)
    names = {name: name for name in [*TABLES, *known]}
    ctes = ",\n".join(f"{name} as ({body.format(**names)})" for name, body in needed.items())
    return f"with recursive {ctes}\n{text.format(**names)}" if needed else text.format(**names)
