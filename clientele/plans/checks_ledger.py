"""Registered queries for approvals, activations and audit, and their check SQL."""

from __future__ import annotations

from datetime import datetime

from clientele.operators import ledger
from clientele.plans.inputs import plain

AS_OF = datetime(2024, 1, 25)
# A cap that some of the event users reach and some do not.
WEEKLY_CAP = 16


def _decided(v):
    return ledger.decide_requests(v["view_activation_requests"], v["view_approvals"], v["view_audiences"])


def _log(v):
    return ledger.activations(_decided(v), v["view_audiences"])


def _audit(v):
    return ledger.audit_rows(_decided(v), "session_1")


QUERIES = {
    "n01_approval_upsert": lambda v: plain(
        ledger.upsert_approvals(v["view_approvals"], v["view_reissued_approvals"])
    ),
    "n02_campaign_drafts": lambda v: plain(
        ledger.draft_campaigns(v["view_campaign_requests"], v["view_audiences"])
    ),
    "n03_activation_gate": lambda v: ledger.check_requests(
        v["view_activation_requests"], v["view_approvals"], v["view_audiences"]
    ).select("request_id", "nonce", "gate_reason"),
    "n04_single_use": lambda v: _decided(v).select("request_id", "status", "reason"),
    "n04_consumed_approvals": lambda v: plain(
        ledger.consume_approvals(v["view_approvals"], _decided(v)).select(
            "nonce", "consumed_at", "consumed_by"
        )
    ),
    "n05_activation_log": lambda v: plain(_log(v)),
    "n06_latest_activations": lambda v: ledger.latest_activations(_log(v)),
    "n07_audit_log": lambda v: plain(_audit(v)),
    "n08_audit_rollup": lambda v: ledger.audit_rollup(_audit(v)),
    "n09_frequency_cap": lambda v: ledger.within_cap(
        v["view_customers"].select("unified_customer_id"), v["view_events"], AS_OF, WEEKLY_CAP
    ),
}

_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') as {0}"

PARTS = {
    "gated": """
        select q.*, r.approved_by, r.consumed_at,
               case when r.nonce is null then 'NOT_REGISTERED' when r.expires_at < q.requested_at then 'EXPIRED'
                    when r.campaign_name is distinct from q.campaign_name then 'SCOPE_CAMPAIGN'
                    when r.audience_id is distinct from q.audience_id then 'SCOPE_AUDIENCE'
                    when r.channel is distinct from q.channel then 'SCOPE_CHANNEL'
                    when a.audience_id is null then 'UNKNOWN_AUDIENCE' when a.status is distinct from 'COMPLIANT' then 'AUDIENCE_REJECTED' end as gate_reason
        from {view_activation_requests} q left join {view_approvals} r on q.nonce = r.nonce
             left join {view_audiences} a on q.audience_id = a.audience_id
    """,
    "decided": """
        select *, case when gate_reason is not null then gate_reason when consumed_at is null and turn = 1 then null
                       else 'ALREADY_CONSUMED' end as reason
        from (select *, row_number() over (partition by nonce, gate_reason is null order by requested_at, request_id) as turn from {gated})
    """,
    "activation_log": """
        select concat('ACT_', upper(md5(request_id))) as activation_id, audience_id, campaign_name,
               channel as target_channel, approved_by, 'APPROVED_AND_ACTIVATED' as approval_status, requested_at as activated_at,
               coalesce(audience_size, 0) as audience_size,
               concat('{{"nonce":"', nonce, '","target_channel":"', channel, '","approved_by":"', approved_by, '"}}') as payload
        from {decided} left join {view_audiences} using (audience_id) where reason is null
    """,
}

SQL = {
    "n01_approval_upsert": f"""
        select nonce, campaign_name, audience_id, channel, approved_by, {_STAMP.format("issued_at")}, {_STAMP.format("expires_at")},
               {_STAMP.format("consumed_at")}, consumed_by
        from (select *, row_number() over (partition by nonce order by batch desc, issued_at desc, expires_at desc, approved_by desc) as rn
              from (select *, 0 as batch from {{view_approvals}}
                    union all by name select *, null::timestamp as consumed_at, null::varchar as consumed_by, 1 as batch from {{view_reissued_approvals}}))
        where rn = 1
    """,
    "n02_campaign_drafts": """
        select campaign_name, audience_id, channel, message_objective as objective, offer_discount as offer,
               concat(frequency_cap, ' touches / week') as frequency_cap, coalesce(audience_size, 0) as audience_size,
               'PENDING_HUMAN_APPROVAL' as approval_status,
               strftime(requested_at + interval 60 minute, '%Y-%m-%d %H:%M:%S.%f') as token_expires_at
        from {view_campaign_requests} left join {view_audiences} using (audience_id)
    """,
    "n03_activation_gate": "select request_id, nonce, gate_reason from {gated}",
    "n04_single_use": """
        select request_id, case when reason is null then 'SUCCESS' else 'REJECTED' end as status, reason from {decided}
    """,
    "n04_consumed_approvals": """
        select nonce, strftime(coalesce(r.consumed_at, d.requested_at), '%Y-%m-%d %H:%M:%S.%f') as consumed_at,
               coalesce(r.consumed_by, d.requested_by) as consumed_by
        from {view_approvals} r left join (select * from {decided} where reason is null) d using (nonce)
    """,
    "n05_activation_log": f"select * replace ({_STAMP.format('activated_at')}) from {{activation_log}}",
    "n06_latest_activations": """
        select campaign_name, target_channel, audience_size, approval_status
        from {activation_log} order by activated_at desc, activation_id limit 5
    """,
    "n07_audit_log": """
        select concat('LOG_', upper(md5(request_id))) as log_id, 'session_1' as session_id,
               case when reason is null then 'campaign_activation' else 'activation_attempt' end as action_type,
               'activate_campaign' as tool_name, campaign_name as request_prompt,
               case when reason is null then 'APPROVED_BY_HUMAN' else 'BLOCKED_BY_GOVERNANCE' end as governance_status,
               concat('{{', case when reason is null then '' else concat('"reason":"', reason, '",') end, '"campaign_name":"', campaign_name,
                      '","audience_id":"', audience_id, '","channel":"', channel, '"}}') as details,
               strftime(requested_at, '%Y-%m-%d %H:%M:%S.%f') as timestamp
        from {decided}
    """,
    "n08_audit_rollup": """
        select case when reason is null then 'APPROVED_BY_HUMAN' else 'BLOCKED_BY_GOVERNANCE' end as governance_status, count(*) as records
        from {decided} group by 1
    """,
    "n09_frequency_cap": """
        select unified_customer_id from {view_customers} where unified_customer_id not in (
            select unified_customer_id from {view_events}
            where event_timestamp > timestamp '2024-01-18' and event_timestamp <= timestamp '2024-01-25'
            group by unified_customer_id having count(*) >= 16)
    """,
}
