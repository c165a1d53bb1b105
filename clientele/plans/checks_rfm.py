"""Registered queries for segments, and their check SQL."""

from __future__ import annotations

from clientele.operators import rfm
from clientele.plans.inputs import feature_table, plain, rfm_table, rounded


def _base(v):
    return rfm.customer_base(v["view_transactions"], v["view_customers"])


QUERIES = {
    "r01_reference_date": lambda v: plain(
        v.spark.range(1).select(rfm.reference_date(v["view_transactions"]).alias("reference_date"))
    ),
    "r02_purchase_history": lambda v: rounded(rfm.purchase_history(v["view_transactions"]), 2),
    "r03_customer_base": _base,
    "r04_score_ranks": lambda v: rfm.score_ranks(_base(v)),
    "r05_quintile_scores": lambda v: rfm.quintile_scores(_base(v)).select(
        "unified_customer_id", "r_score", "f_score", "m_score"
    ),
    "r06_rfm_score": lambda v: rfm_table(v).select("unified_customer_id", "rfm_score"),
    "r07_rfm_segment": rfm_table,
    "r08_segment_overview": lambda v: rfm.segment_overview(feature_table(v)),
    "r09_segment_summary": lambda v: rounded(rfm.segment_summary(feature_table(v)), 4),
    "r10_behaviour_sample": lambda v: rfm.behaviour_sample(feature_table(v)),
    "r11_segment_counts": lambda v: rfm.segment_counts(rfm_table(v)),
}

PARTS = {
    "rfm_reference": "select max(order_timestamp) + interval 1 day as ref from {view_transactions}",
    "rfm_history": """
        select unified_customer_id,
               cast(date_sub('day', max(order_timestamp), (select ref from {rfm_reference})) as int) as recency_days,
               cast(count(distinct order_id) as int) as frequency,
               cast(sum(cast(revenue as decimal(28, 6))) as double) as monetary,
               cast(sum(cast(gross_margin as decimal(28, 6))) as double) as gross_margin
        from {view_transactions} where unified_customer_id is not null group by unified_customer_id
    """,
    "rfm_base": """
        select unified_customer_id, coalesce(recency_days, 999) as recency_days, coalesce(frequency, 0) as frequency,
               round(coalesce(monetary, 0.0), 2) as monetary, round(coalesce(gross_margin, 0.0), 2) as gross_margin
        from (select distinct unified_customer_id from {view_customers}) left join {rfm_history} using (unified_customer_id)
    """,
    "rfm_ranks": """
        select *, row_number() over (order by recency_days desc, unified_customer_id) as r_rank,
               row_number() over (order by frequency, unified_customer_id) as f_rank,
               row_number() over (order by monetary, unified_customer_id) as m_rank,
               count(*) over () as n
        from {rfm_base}
    """,
    "rfm_scores": """
        select *, cast(greatest(1, ceil(5.0 * (r_rank - 1) / (n - 1))) as int) as r_score,
               cast(greatest(1, ceil(5.0 * (f_rank - 1) / (n - 1))) as int) as f_score,
               cast(greatest(1, ceil(5.0 * (m_rank - 1) / (n - 1))) as int) as m_score
        from {rfm_ranks}
    """,
    "rfm": """
        select unified_customer_id, recency_days, frequency, monetary, gross_margin, r_score, f_score, m_score,
               concat(r_score, f_score, m_score) as rfm_score,
               case when frequency = 0 then 'Prospect (Zero Purchases)'
                    when r_score >= 4 and f_score >= 4 and m_score >= 4 then 'Champions'
                    when f_score >= 4 and m_score >= 3 then 'Loyal Customers'
                    when r_score >= 4 and f_score in (1, 2) then 'New / Promising Customers'
                    when r_score >= 3 and f_score >= 3 then 'Potential Loyalists'
                    when r_score <= 2 and f_score >= 3 and m_score >= 3 then 'At-Risk High Value'
                    when r_score <= 2 and f_score >= 2 then 'Needs Attention'
                    when r_score <= 2 and f_score = 1 then 'Hibernating'
                    else 'About to Sleep' end as rfm_segment
        from {rfm_scores}
    """,
}

SQL = {
    "r01_reference_date": "select strftime(ref, '%Y-%m-%d %H:%M:%S.%f') as reference_date from {rfm_reference}",
    "r02_purchase_history": """
        select unified_customer_id, recency_days, frequency, round(monetary, 2) as monetary,
               round(gross_margin, 2) as gross_margin from {rfm_history}
    """,
    "r03_customer_base": "select * from {rfm_base}",
    "r04_score_ranks": "select unified_customer_id, r_rank, f_rank, m_rank from {rfm_ranks}",
    "r05_quintile_scores": "select unified_customer_id, r_score, f_score, m_score from {rfm_scores}",
    "r06_rfm_score": "select unified_customer_id, rfm_score from {rfm}",
    "r07_rfm_segment": "select * from {rfm}",
    "r08_segment_overview": """
        select rfm_segment, count(*) as customer_count, round(avg(recency_days), 1) as avg_recency_days,
               round(avg(frequency), 1) as avg_orders,
               round(cast(sum(cast(monetary as decimal(28, 6))) as double) / count(*), 2) as avg_monetary_value,
               round(cast(sum(cast(predicted_cltv as decimal(28, 6))) as double) / count(*), 2) as avg_predicted_cltv
        from {feature_table} group by rfm_segment
    """,
    "r09_segment_summary": """
        select rfm_segment, count(*) as count,
               round(cast(sum(cast(predicted_cltv as decimal(28, 6))) as double) / count(*), 4) as avg_cltv,
               round(cast(sum(cast(monetary as decimal(28, 6))) as double) / count(*), 4) as avg_rev
        from {feature_table} group by rfm_segment
    """,
    "r10_behaviour_sample": """
        select unified_customer_id, recency_days, frequency, predicted_cltv, rfm_segment
        from {feature_table} order by unified_customer_id limit 500
    """,
    "r11_segment_counts": "select rfm_segment, count(*) as count from {rfm} group by rfm_segment",
}
