"""Registered queries for identity resolution and the customer view, and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.operators import identity
from clientele.plans.inputs import feature_table, flags_as_text, plain
from clientele.sources.scratch import materialise

THRESHOLD = 0.75
LOOSE_THRESHOLD = 0.70


def resolved(v, threshold=THRESHOLD):
    return identity.resolve(v["view_identities"], threshold, v["view_entity_ids"])


def _clusters(v, threshold):
    edges = materialise(identity.link_edges(v["view_identities"], threshold), "identity")
    return identity.entity_clusters(edges, v["view_entity_ids"])


def _golden(v):
    mapping = identity.entity_map(resolved(v))
    return plain(identity.golden_records(v["view_entities"], mapping))


def _customer_360(v):
    view = identity.customer_360(v["view_profiles"], feature_table(v), v["view_consent"])
    return flags_as_text(plain(view))


def _customer_lookup(v):
    view = identity.customer_360(v["view_profiles"], feature_table(v), v["view_consent"])
    return flags_as_text(plain(identity.lookup_customers(_lookups(v), view)))


def _spelled_phones(v):
    """Phones as people write them; other identifiers as they are."""
    digits = F.col("identifier_value")
    spelled = F.concat(F.lit("+1 ("), F.substring(digits, 1, 3), F.lit(") "), F.substring(digits, 4, 3), F.lit("-"), F.substr(digits, F.lit(7)))
    is_phone = (F.col("identifier_type") == "phone") & (F.length(digits) >= 10)
    return v["view_identities"].withColumn("identifier_value", F.when(is_phone, spelled).otherwise(digits))


def _lookups(v):
    return v["orders"].select((F.col("o_custkey") + 5).alias("unified_customer_id")).distinct()


QUERIES = {
    "i01_normalised_identifiers": lambda v: identity.normalised(v["view_identities"]).select(
        "source_system", "node", "canonical_entity_id"
    ),
    "i02_confident_links": lambda v: identity.confident(v["view_identities"], THRESHOLD).select(
        "source_system", "identifier_type", "identifier_value", "canonical_entity_id", "confidence_score"
    ),
    "i03_identity_edges": lambda v: identity.link_edges(v["view_identities"], THRESHOLD).select(
        "node", "entity_id"
    ),
    "i04_connected_components": lambda v: _clusters(v, THRESHOLD).select("entity_id", "root_id"),
    "i04_connected_components_loose": lambda v: _clusters(v, LOOSE_THRESHOLD).select(
        "entity_id", "root_id"
    ),
    "i05_unified_ids": lambda v: _clusters(v, THRESHOLD).select(
        "entity_id", identity.unified_id(F.col("cluster")).alias("unified_customer_id")
    ),
    "i06_resolved_map": resolved,
    "i07_golden_records": _golden,
    "i08_resolution_summary": lambda v: identity.resolution_summary(resolved(v)),
    "i09_customer_360": _customer_360,
    "i09_customer_lookup": _customer_lookup,
    "i10_customer_explorer": lambda v: identity.explorer(v["view_profiles"], feature_table(v)),
    "i11_linked_identifiers": lambda v: identity.linked_identifiers(
        identity.identity_map(resolved(v))
    ),
    "i11_one_customers_identifiers": lambda v: identity.linked_identifiers(
        identity.identity_map(resolved(v)), "UCID_000005"
    ),
    "i12_transaction_history": lambda v: plain(
        identity.transaction_history(v["view_transactions"])
    ),
    "i12_one_customers_transactions": lambda v: plain(identity.transaction_history(v["view_transactions"], 7)),
    "i01_phone_numbers": lambda v: identity.normalised(_spelled_phones(v), phones=True).select(
        "source_system", "identifier_value", "node", "canonical_entity_id"
    ),
}

PARTS = {
    "linked_identifiers": """
        select unified_customer_id, identifier_type,
               case when identifier_type = 'email' then case when identifier_value like '%@%'
                         then concat(left(identifier_value, 2), '***@', split_part(identifier_value, '@', -1)) else '[REDACTED]' end
                    when identifier_type = 'phone' then concat('***-***-', right(identifier_value, 4))
                    else concat('***', right(identifier_value, 4)) end as identifier_value
        from {id_map}
    """,
    "customer_360": """
        select p.* replace (strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') as created_at), f.recency_days, f.frequency, f.monetary,
               f.rfm_segment, f.predicted_cltv, f.lead_score, f.churn_risk, cast(c.marketing_opt_in as varchar) as marketing_opt_in,
               cast(c.do_not_track as varchar) as do_not_track
        from {masked_profiles} p left join {feature_table} f using (unified_customer_id)
             left join {view_consent} c using (unified_customer_id)
    """,
    "id_links": """
        select source_system, identifier_type, lower(trim(identifier_value)) as identifier_value,
               concat(identifier_type, ':', lower(trim(identifier_value))) as node, canonical_entity_id, confidence_score
        from {view_identities} where trim(identifier_value) <> ''
    """,
    "id_edges": """
        select distinct node, canonical_entity_id as entity_id, identifier_type, identifier_value
        from {id_links} where not isnan(confidence_score) and confidence_score >= 0.75
    """,
    "id_edges_loose": """
        select distinct node, canonical_entity_id as entity_id
        from {id_links} where not isnan(confidence_score) and confidence_score >= 0.70
    """,
    "id_neighbours": """
        select distinct a.entity_id as x, b.entity_id as y from {id_edges} a join {id_edges} b on a.node = b.node
    """,
    "id_neighbours_loose": """
        select distinct a.entity_id as x, b.entity_id as y from {id_edges_loose} a join {id_edges_loose} b on a.node = b.node
    """,
    "id_reach": """
        select entity_id as x, entity_id as y from {view_entities}
        union select r.x, n.y from id_reach r join {id_neighbours} n on r.y = n.x
    """,
    "id_reach_loose": """
        select entity_id as x, entity_id as y from {view_entities}
        union select r.x, n.y from id_reach_loose r join {id_neighbours_loose} n on r.y = n.x
    """,
    "id_roots": "select x as entity_id, min(y) as root_id from {id_reach} group by x",
    "id_roots_loose": "select x as entity_id, min(y) as root_id from {id_reach_loose} group by x",
    "id_unified": """
        select entity_id, root_id, concat('UCID_', lpad(cast(dense_rank() over (order by root_id) as varchar), 6, '0')) as unified_customer_id
        from {id_roots}
    """,
    "id_resolved": """
        select unified_customer_id, entity_id as raw_entity_id, 'entity' as node_type, 'entity_id' as identifier_type,
               entity_id as identifier_value, root_id as cluster_key from {id_unified}
        union all
        select distinct unified_customer_id, null, 'identifier', identifier_type, identifier_value, root_id
        from {id_edges} join {id_unified} using (entity_id)
    """,
    "id_golden": """
        select unified_customer_id, arg_min(email, (created_at, entity_id)) filter (email is not null) as primary_email,
               arg_min(phone, (created_at, entity_id)) filter (phone is not null) as primary_phone,
               arg_min(first_name, (created_at, entity_id)) filter (first_name is not null) as first_name,
               arg_min(last_name, (created_at, entity_id)) filter (last_name is not null) as last_name,
               arg_min(city, (created_at, entity_id)) filter (city is not null) as city,
               arg_min(country, (created_at, entity_id)) filter (country is not null) as country,
               arg_min(subscription_status, (created_at, entity_id)) filter (subscription_status is not null) as subscription_status,
               min(created_at) as created_at
        from {view_entities} join {id_unified} using (entity_id) group by unified_customer_id
    """,
    "masked_profiles": """
        select unified_customer_id,
               case when primary_email like '%@%' then concat(left(primary_email, 2), '***@', split_part(primary_email, '@', -1))
                    else '[REDACTED]' end as primary_email,
               case when primary_phone is null then '[REDACTED]' else concat('***-***-', right(primary_phone, 4)) end as primary_phone,
               case when first_name is null then '' else concat(left(first_name, 1), '***') end as first_name,
               case when last_name is null then '' else concat(left(last_name, 1), '***') end as last_name,
               city, country, subscription_status, created_at
        from {view_profiles}
    """,
    "id_map": """
        select concat('IDM_', lpad(cast(row_number() over (order by unified_customer_id, node_type, identifier_type, identifier_value) - 1 as varchar), 7, '0')) as id,
               unified_customer_id, identifier_type, identifier_value
        from {id_resolved}
    """,
}

SQL = {
    "i01_normalised_identifiers": "select source_system, node, canonical_entity_id from {id_links}",
    "i02_confident_links": """
        select source_system, identifier_type, identifier_value, canonical_entity_id, confidence_score from {view_identities}
        where not isnan(confidence_score) and confidence_score >= 0.75
    """,
    "i03_identity_edges": "select node, entity_id from {id_edges}",
    "i04_connected_components": "select entity_id, root_id from {id_roots}",
    "i04_connected_components_loose": "select entity_id, root_id from {id_roots_loose}",
    "i05_unified_ids": "select entity_id, unified_customer_id from {id_unified}",
    "i06_resolved_map": "select * from {id_resolved}",
    "i07_golden_records": """
        select * replace (strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') as created_at) from {id_golden}
    """,
    "i08_resolution_summary": """
        select count(*) as mapping_rows, count(distinct unified_customer_id) as unified_customers from {id_resolved}
    """,
    "i09_customer_360": "select * from {customer_360}",
    "i09_customer_lookup": """
        select r.unified_customer_id, p.* exclude (unified_customer_id),
               case when p.unified_customer_id is null then 'NOT_FOUND' else 'PII_MASKED' end as status
        from (select distinct o_custkey + 5 as unified_customer_id from {orders}) r
             left join {customer_360} p on r.unified_customer_id = p.unified_customer_id
    """,
    "i10_customer_explorer": """
        select unified_customer_id, first_name, last_name, primary_email, subscription_status, rfm_segment, predicted_cltv,
               lead_score, recency_days, frequency, monetary
        from {masked_profiles} join {feature_table} using (unified_customer_id)
        order by predicted_cltv desc, unified_customer_id limit 200
    """,
    "i11_linked_identifiers": "select * from ({linked_identifiers})",
    "i11_one_customers_identifiers": """
        select * from ({linked_identifiers}) where unified_customer_id = 'UCID_000005'
    """,
    "i12_one_customers_transactions": """
        select unified_customer_id, order_id, strftime(order_timestamp, '%Y-%m-%d %H:%M:%S.%f') as order_timestamp, revenue,
               gross_margin, channel
        from {view_transactions} where unified_customer_id = 7
    """,
    "i01_phone_numbers": """
        select source_system, case when identifier_type = 'phone' then right(regexp_replace(identifier_value, '[^0-9]', '', 'g'), 10) else identifier_value end as identifier_value,
               concat(identifier_type, ':', case when identifier_type = 'phone' then right(regexp_replace(identifier_value, '[^0-9]', '', 'g'), 10) else identifier_value end) as node,
               canonical_entity_id
        from {id_links}
    """,
    "i12_transaction_history": """
        select unified_customer_id, order_id, strftime(order_timestamp, '%Y-%m-%d %H:%M:%S.%f') as order_timestamp, revenue,
               gross_margin, channel
        from {view_transactions}
    """,
}
