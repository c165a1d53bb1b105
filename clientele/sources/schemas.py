"""Schemas of the raw feeds and of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the feeds and tables.
FEEDS = {
    "entities": """entity_id string, first_name string, last_name string, email string, phone string,
        city string, country string, created_at timestamp, churn_propensity double, cltv_archetype string,
        preferred_channel string, subscription_status string""",
    "identities": """source_system string, identifier_type string, identifier_value string,
        canonical_entity_id string, confidence_score double, created_at timestamp""",
    "transactions": """order_id string, entity_id string, order_timestamp timestamp, revenue double,
        gross_margin double, channel string, payment_status string, items_count int""",
    "events": """event_id string, entity_id string, event_timestamp timestamp, event_type string,
        page_url string, session_id string, device_type string""",
    "touchpoints": """touchpoint_id string, entity_id string, event_timestamp timestamp, channel string,
        campaign_name string, conversion_flag int, order_id string, attributed_revenue double""",
    "consents": """entity_id string, marketing_opt_in boolean, tracking_consent boolean,
        third_party_sharing boolean, do_not_track boolean, updated_at timestamp""",
}

TABLES = {
    "customer_profile": """unified_customer_id string, primary_email string, primary_phone string,
        first_name string, last_name string, city string, country string, subscription_status string,
        created_at timestamp, updated_at timestamp""",
    "identity_map": """id string, unified_customer_id string, identifier_type string,
        identifier_value string, created_at timestamp""",
    "transaction_fact": """order_id string, unified_customer_id string, order_timestamp timestamp,
        revenue double, gross_margin double, channel string, payment_status string, items_count int""",
    "event_fact": """event_id string, unified_customer_id string, event_timestamp timestamp,
        event_type string, page_url string, session_id string, device_type string""",
    "campaign_touchpoint": """touchpoint_id string, unified_customer_id string, event_timestamp timestamp,
        channel string, campaign_name string, conversion_flag int, order_id string, attributed_revenue double""",
    "consent_preference": """unified_customer_id string, marketing_opt_in boolean, tracking_consent boolean,
        third_party_sharing boolean, do_not_track boolean, updated_at timestamp""",
    "customer_features": """unified_customer_id string, recency_days int, frequency int, monetary double,
        gross_margin double, rfm_score string, rfm_segment string, predicted_cltv double, cltv_decile int,
        lead_score double, churn_risk double, computed_at timestamp""",
    "audience_definition": """audience_id string, name string, description string, filter_criteria string,
        created_by string, created_at timestamp, status string""",
    "audience_membership": "audience_id string, unified_customer_id string, added_at timestamp",
    "campaign_activation": """activation_id string, audience_id string, campaign_name string,
        target_channel string, approved_by string, approval_status string, activated_at timestamp,
        audience_size int, payload string""",
    "agent_audit_log": """log_id string, session_id string, action_type string, tool_name string,
        request_prompt string, governance_status string, details string, timestamp timestamp""",
    "approval_token": """nonce string, campaign_name string, audience_id string, channel string,
        approved_by string, issued_at timestamp, expires_at timestamp, consumed_at timestamp, consumed_by string""",
    "approval_claim": """nonce string, request_id string, requested_by string, requested_at timestamp,
        claimed_at timestamp""",
    "experiment_result": """experiment_id string, activation_id string, audience_id string, metric_name string,
        control_value double, treatment_value double, lift_pct double, p_value double, is_significant boolean,
        sample_size int, measured_at timestamp""",
    # Clusters as batches of links found them, and rows that a keyed load did not take.
    "entity_root": "entity_id string, root_id string",
    "identifier_root": "node string, identifier_type string, identifier_value string, root_id string",
    "absorbed_root": "absorbed_root string, root_id string",
    "rejected_row": "table_name string, reason string, row_key string, content string, rejected_at timestamp",
}

# The key of a table and the time by which the newest row of a key counts.
KEYS = {
    "customer_profile": ("unified_customer_id", "updated_at"),
    "transaction_fact": ("order_id", "order_timestamp"),
    "event_fact": ("event_id", "event_timestamp"),
    "campaign_touchpoint": ("touchpoint_id", "event_timestamp"),
    "consent_preference": ("unified_customer_id", "updated_at"),
}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(" ".join(ddl.split()))
