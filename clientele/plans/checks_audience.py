"""Registered queries for audiences, consent and masking, and their check SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from clientele.functions import privacy
from clientele.operators import audience
from clientele.plans.inputs import feature_table, plain
from clientele.sources.scratch import materialise

NOW = datetime(2026, 1, 1)
CRITERIA = {"min_cltv": 500000.0, "min_frequency": 5, "min_recency_days": 10, "max_recency_days": 400, "min_churn_risk": 0.1}
WIN_BACK = {"rfm_segment": "At-Risk High Value", "min_frequency": 2}
HOSTILE = {"rfm_segment": "Loyal' OR frequency >= 0 -- \"all of them\""}
MARKERS = {"emails": "EMAIL", "ssns": "SSN", "cards": "CARD", "phones": "PHONE"}


def _features(v):
    return materialise(feature_table(v), "features")


def _verdicts(v):
    """The gate on a normal audience, on one below the size floor, and on an empty one."""
    features = _features(v)
    cases = {"win_back": (WIN_BACK, None), "tiny": ({}, 5), "hostile": (HOSTILE, None)}
    rows = None
    for name, (criteria, limit) in cases.items():
        chosen = audience.select_audience(features, criteria, limit)
        row = audience.compliance_summary(chosen, v["view_consent"]).withColumn("audience", F.lit(name))
        rows = row if rows is None else rows.unionByName(row)
    return rows.select("audience", "is_compliant", "governance_note")


def _win_back(v):
    return audience.select_audience(feature_table(v), WIN_BACK)


def _summary(v):
    return audience.compliance_summary(_win_back(v), v["view_consent"])


def _members(v):
    return audience.compliant_members(materialise(_win_back(v), "audience"), v["view_consent"])


def _texts(v):
    documents = v["documents"].select(
        F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("text_id"), "text"
    )
    turn = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    conversations = v["conversations"].select(
        F.lit("conversations").alias("origin"), turn.alias("text_id"), "text"
    )
    return documents.unionByName(conversations)


def _masked_texts(v):
    """Masked texts; letters, digits and marks beyond ASCII shown as x, to compare engines."""
    masked = privacy.mask_text(F.col("text"))
    counts = [
        F.regexp_count("masked", F.lit(rf"\[REDACTED_{marker}\]")).cast("bigint").alias(name)
        for name, marker in MARKERS.items()
    ]
    shown = F.col("masked")
    for kind in "LNM":
        shown = F.regexp_replace(shown, rf"[^\x00-\x7F\P{{{kind}}}]", "x")
    return (
        _texts(v)
        .withColumn("masked", masked)
        .select("origin", "text_id", *counts, shown.alias("masked"))
    )


def _flagged(v):
    phrase = privacy.policy_phrase(F.col("text"))
    return _texts(v).select("origin", "text_id", phrase.isNotNull().alias("blocked"), phrase.alias("phrase"))


QUERIES = {
    "g01_audience_filter": lambda v: audience.select_audience(feature_table(v), CRITERIA, None),
    "g02_audience_limit": lambda v: audience.select_audience(feature_table(v), {"min_frequency": 3}, 200),
    "g03_size_floor": _verdicts,
    "g04_consent_gate": _members,
    "g04_consent_gate_without_opt_in": lambda v: audience.compliant_members(
        materialise(_win_back(v), "audience"), v["view_consent"], require_opt_in=False
    ),
    "g05_compliance_summary": _summary,
    "g06_audience_definition": lambda v: plain(
        audience.audience_definition(_summary(v), "AUD_WINBACK", WIN_BACK, "session_1", NOW)
    ),
    "g06_audience_membership": lambda v: plain(
        audience.audience_membership(_members(v), "AUD_WINBACK", NOW)
    ),
    "g07_mask_text": _masked_texts,
    "g08_mask_profile": lambda v: plain(privacy.mask_profile(v["view_profiles"])),
    "g09_consent_summary": lambda v: audience.consent_summary(v["view_consent"]),
    "g10_policy_phrases": _flagged,
}

PARTS = {
    "win_back": """
        select * from {feature_table} where rfm_segment = 'At-Risk High Value' and frequency >= 2
    """,
    "win_back_consent": "select * from {win_back} left join {view_consent} using (unified_customer_id)",
    "win_back_counts": """
        select count(*) as evaluated,
               count(*) filter (coalesce(do_not_track, true) = false and coalesce(marketing_opt_in, false) = true) as compliant
        from {win_back_consent}
    """,
    "win_back_note": """
        select evaluated >= 10 as is_compliant, evaluated, case when evaluated >= 10 then compliant else 0 end as compliant,
               case when evaluated >= 10 then evaluated - compliant else 0 end as suppressed,
               case when evaluated = 0 then 'Nobody meets the criteria.'
                    when evaluated < 10 then concat('Refused: ', evaluated, ' members, k-anonymity asks for 10.')
                    else concat('Audience validation passed: ', evaluated, ' members looked at, ', compliant,
                                ' may be contacted. Suppressed for lack of consent: ', evaluated - compliant, '.') end as governance_note
        from {win_back_counts}
    """,
    "win_back_members": """
        select unified_customer_id from {win_back_consent}
        where coalesce(do_not_track, true) = false and coalesce(marketing_opt_in, false) = true
          and (select count(*) from {win_back}) >= 10
    """,
    "all_texts": """
        select 'documents' as origin, cast(doc_id as varchar) as text_id, text from {documents}
        union all select 'conversations', concat(conv_id, '-', turn), text from {conversations}
    """,
}

# The same masking for the check: emails first, then word characters beyond ASCII become x
# (the check engine's word boundary knows ASCII only), then the other patterns.
# The masking patterns and markers.
_STEPS = (
    (r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "[REDACTED_EMAIL]"),
    (r"[^\x00-\x7F\P{L}]", "x"),
    (r"[^\x00-\x7F\P{N}]", "x"),
    (r"[^\x00-\x7F\P{M}]", "x"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    (r"\b(?:\d[ -]?){13,16}\b", "[REDACTED_CARD]"),
    (r"(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}\b", "[REDACTED_PHONE]"),
)


def _masked_sql() -> str:
    masked = "text"
    for pattern, marker in _STEPS:
        masked = f"regexp_replace({masked}, '{pattern}', '{marker}', 'g')"
    # Braces name parts elsewhere, so those of the patterns are doubled.
    masked = masked.replace("{", "{{").replace("}", "}}")
    counts = ", ".join(
        rf"len(regexp_extract_all(masked, '\[REDACTED_{marker}\]')) as {name}" for name, marker in MARKERS.items()
    )
    return f"select origin, text_id, {counts}, masked from (select origin, text_id, {masked} as masked from {{all_texts}})"


SQL = {
    "g01_audience_filter": """
        select unified_customer_id, rfm_segment, predicted_cltv, frequency, recency_days, cast(churn_risk as double) as churn_risk
        from {feature_table} where predicted_cltv >= 500000 and frequency >= 5 and recency_days between 10 and 400 and churn_risk >= 0.1
    """,
    "g02_audience_limit": """
        select unified_customer_id, rfm_segment, predicted_cltv, frequency, recency_days, cast(churn_risk as double) as churn_risk
        from {feature_table} where frequency >= 3 order by unified_customer_id limit 200
    """,
    "g03_size_floor": """
        select 'win_back' as audience, is_compliant, governance_note from {win_back_note}
        union all select 'tiny', false, concat('Refused: ', least(count(*), 5), ' members, k-anonymity asks for 10.')
                  from {feature_table}
        union all select 'hostile', false, 'Nobody meets the criteria.'
    """,
    "g04_consent_gate": "select * from {win_back_members}",
    "g04_consent_gate_without_opt_in": """
        select unified_customer_id from {win_back_consent} where coalesce(do_not_track, true) = false
           and (select count(*) from {win_back}) >= 10
    """,
    "g05_compliance_summary": "select * from {win_back_note}",
    "g06_audience_definition": """
        select 'AUD_WINBACK' as audience_id, 'Audience AUD_WINBACK' as name, governance_note as description,
               json_object('rfm_segment', 'At-Risk High Value', 'min_cltv', null, 'min_frequency', 2, 'min_recency_days', null,
                           'max_recency_days', null, 'min_churn_risk', null)::varchar as filter_criteria,
               'session_1' as created_by, '2026-01-01 00:00:00.000000' as created_at,
               case when is_compliant then 'COMPLIANT' else 'REJECTED' end as status
        from {win_back_note}
    """,
    "g06_audience_membership": """
        select 'AUD_WINBACK' as audience_id, unified_customer_id, '2026-01-01 00:00:00.000000' as added_at from {win_back_members}
    """,
    "g07_mask_text": _masked_sql(),
    "g08_mask_profile": """
        select * replace (strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') as created_at) from {masked_profiles}
    """,
    "g09_consent_summary": """
        select count(*) filter (marketing_opt_in) as marketing_opted_in, count(*) filter (not marketing_opt_in) as marketing_opted_out,
               count(*) filter (do_not_track) as do_not_track_active
        from {view_consent}
    """,
    "g10_policy_phrases": """
        select origin, text_id, phrase is not null as blocked, phrase
        from (select origin, text_id, nullif(regexp_extract(lower(text), 'raw email|export pii|unmasked phone|dump pii|raw phone|extract emails|extract phone'), '') as phrase
              from {all_texts})
    """,
}
