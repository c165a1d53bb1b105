"""Registered queries for lead scoring, and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.operators import cltv, evaluation, leads
from clientele.plans.inputs import (
    LABEL_DAYS,
    fixed_lead_scores,
    lead_cutoff,
    lead_features,
    plain,
)
from clientele.sources.scratch import materialise

LABEL = "converted_flag"


def _model_scores(v):
    split = materialise(leads.stratified_split(lead_features(v)), "leads")
    model = leads.train(split)
    scored = materialise(leads.positive_probability(model, cltv.assemble(split, leads.FEATURES)), "scored")
    grades = leads.graded_scores(scored, "raw_score").withColumnRenamed("unified_customer_id", "_id")
    # Over all customers: the test part of the smallest folder holds a handful of buyers.  With so few no tree
    # can split, and one score for everybody is the right answer.
    flat = scored.agg(F.min("raw_score") == F.max("raw_score")).first()[0]
    auc = evaluation.roc_auc(scored, LABEL, "raw_score").first()["roc_auc"]
    lift = cltv.deciles(scored, "raw_score", "decile").agg(*evaluation.decile_lift(LABEL, "decile")).first()["top_decile_lift"]
    least = {"Cold": 0.0, "Warm": 0.15, "Hot": 0.35, "Sales-Ready": 0.6}
    floor = F.coalesce(*[F.when(F.col("lead_grade") == name, F.lit(bound)) for name, bound in least.items()])
    return scored.join(grades, F.col("unified_customer_id") == F.col("_id")).select(
        "unified_customer_id",
        LABEL,
        "is_train",
        F.col("raw_score").between(0, 1).alias("is_a_probability"),
        (F.abs(F.col("lead_score") - F.col("raw_score")) <= 0.0000501).alias("rounds_the_score"),
        (F.col("lead_score") >= floor).alias("grade_fits"),
        F.lit(flat or auc > 0.6).alias("auc_above_threshold_or_one_score"),
        F.lit(flat or lift > 1.5).alias("lift_above_threshold_or_one_score"),
    )


def _constant_scores(v):
    """A label without signal: nobody converts, so everybody gets the share of converters."""
    features = lead_features(v).withColumn(LABEL, F.lit(0))
    return leads.train_and_score(features)[0]


def _order_part(*columns):
    def build(v):
        orders = leads.order_features(v["view_purchases"], lead_cutoff(v), LABEL_DAYS)
        return plain(orders.select("unified_customer_id", *columns))

    return build


QUERIES = {
    "l01_cutoff": lambda v: plain(
        v.spark.range(1).select(lead_cutoff(v).alias("cutoff"))
    ),
    "l02_observed_events": lambda v: leads.observed_events(v["view_events"], lead_cutoff(v)).select(
        "event_id", "unified_customer_id"
    ),
    "l03_behaviour_features": lambda v: plain(
        leads.behaviour_features(v["view_events"], lead_cutoff(v)).drop(
            "events_last_7d", "events_last_30d"
        )
    ),
    "l04_momentum": lambda v: leads.behaviour_features(v["view_events"], lead_cutoff(v)).select(
        "unified_customer_id", "events_last_7d", "events_last_30d"
    ),
    "l05_order_history": lambda v: _order_part("hist_orders", "hist_revenue", "hist_last_order")(v)
    .where("hist_orders > 0"),
    "l06_profile_features": lambda v: lead_features(v).select(
        "unified_customer_id", "total_sessions", "total_pageviews", "hist_orders"
    ),
    "l07_forward_label": lambda v: lead_features(v).select("unified_customer_id", LABEL),
    "l08_features": lead_features,
    "l09_constant_scores": _constant_scores,
    "l09_label_guard": lambda v: leads.label_guard(lead_features(v)),
    "l10_stratified_split": lambda v: leads.stratified_split(lead_features(v)).select(
        "unified_customer_id", LABEL, "is_train"
    ),
    "l11_boosted_classifier": _model_scores,
    "l12_roc_auc": lambda v: evaluation.roc_auc(fixed_lead_scores(v), LABEL, "score"),
    "l13_average_precision": lambda v: evaluation.average_precision(
        fixed_lead_scores(v), LABEL, "score"
    ),
    "l14_brier_score": lambda v: fixed_lead_scores(v).agg(evaluation.brier_score(LABEL, "score")),
    "l15_decile_lift": lambda v: cltv.deciles(fixed_lead_scores(v), "score", "decile").agg(
        *evaluation.decile_lift(LABEL, "decile")
    ),
    "l16_precision_recall_at_top": lambda v: evaluation.precision_recall_at_top(
        materialise(fixed_lead_scores(v), "scores"), "unified_customer_id", LABEL, "score"
    ),
    "l17_lead_grades": lambda v: leads.graded_scores(fixed_lead_scores(v), "score"),
    "l18_grade_counts": lambda v: leads.grade_counts(
        leads.graded_scores(fixed_lead_scores(v), "score")
    ),
}

PARTS = {
    "lead_split": """
        select unified_customer_id, converted_flag,
               cast(concat('0x', substr(md5(concat(converted_flag, ':', unified_customer_id)), 1, 7)) as bigint) % 100 < 75 as is_train
        from {lead_features}
    """,
    "lead_cutoff": """
        select greatest((select max(event_timestamp) from {view_events}), (select max(order_timestamp) from {view_purchases}))
               - interval 7 day as cutoff
    """,
    "lead_events": "select * from {view_events} where event_timestamp <= (select cutoff from {lead_cutoff})",
    "lead_behaviour": """
        select unified_customer_id, cast(count(distinct session_id) as int) as total_sessions,
               cast(count(*) as int) as total_pageviews,
               cast(count(*) filter (event_type = 'pricing_view') as int) as pricing_views,
               cast(count(*) filter (event_type = 'product_view') as int) as product_views,
               cast(count(*) filter (event_type = 'add_to_cart') as int) as cart_adds,
               cast(count(*) filter (event_type = 'lead_form_submitted') as int) as form_submits,
               cast(count(*) filter (event_type = 'support_ticket') as int) as support_tickets,
               cast(count(*) filter (device_type = 'desktop') as int) as uses_desktop,
               cast(count(*) filter (device_type = 'mobile') as int) as uses_mobile,
               max(event_timestamp) as last_event_ts
        from {lead_events} group by unified_customer_id
    """,
    "lead_momentum": """
        select u.unified_customer_id, cast(coalesce(w.n, 0) as int) as events_last_7d, cast(coalesce(m.n, 0) as int) as events_last_30d
        from (select distinct unified_customer_id from {lead_events}) u
        left join (select unified_customer_id, count(*) as n from {lead_events}
                   where event_timestamp > (select cutoff from {lead_cutoff}) - interval 7 day group by 1) w
             on u.unified_customer_id = w.unified_customer_id
        left join (select unified_customer_id, count(*) as n from {lead_events}
                   where event_timestamp > (select cutoff from {lead_cutoff}) - interval 30 day group by 1) m
             on u.unified_customer_id = m.unified_customer_id
    """,
    "lead_orders": """
        select unified_customer_id, cast(count(distinct order_id) as int) as hist_orders,
               cast(sum(cast(revenue as decimal(28, 6))) as double) as hist_revenue, max(order_timestamp) as hist_last_order
        from {view_purchases} where order_timestamp <= (select cutoff from {lead_cutoff}) group by unified_customer_id
    """,
    "lead_buyers": """
        select distinct unified_customer_id from {view_purchases}
        where order_timestamp > (select cutoff from {lead_cutoff})
          and order_timestamp <= (select cutoff from {lead_cutoff}) + interval 7 day
    """,
    "lead_features": """
        select p.unified_customer_id, coalesce(total_sessions, 0) as total_sessions, coalesce(total_pageviews, 0) as total_pageviews,
               coalesce(pricing_views, 0) as pricing_views, coalesce(product_views, 0) as product_views,
               coalesce(cart_adds, 0) as cart_adds, coalesce(form_submits, 0) as form_submits,
               coalesce(support_tickets, 0) as support_tickets, coalesce(uses_desktop, 0) as uses_desktop,
               coalesce(uses_mobile, 0) as uses_mobile, coalesce(events_last_7d, 0) as events_last_7d,
               coalesce(events_last_30d, 0) as events_last_30d,
               cast(coalesce(date_sub('day', last_event_ts, (select cutoff from {lead_cutoff})), 999) as int) as recency_of_activity_days,
               coalesce(hist_orders, 0) as hist_orders, coalesce(hist_revenue, 0.0) as hist_revenue,
               cast(coalesce(date_sub('day', hist_last_order, (select cutoff from {lead_cutoff})), 999) as int) as hist_recency_days,
               cast(p.unified_customer_id in (select unified_customer_id from {lead_buyers}) as int) as converted_flag
        from {view_customers} p left join {lead_behaviour} using (unified_customer_id)
             left join {lead_momentum} using (unified_customer_id) left join {lead_orders} using (unified_customer_id)
    """,
    "lead_fixed": """
        select *, round(events_last_7d / (events_last_7d + 10.0), 4) as score from {lead_features}
    """,
    "lead_grades": """
        select unified_customer_id, score as lead_score,
               case when score <= 0.15 then 'Cold' when score <= 0.35 then 'Warm' when score <= 0.6 then 'Hot'
                    else 'Sales-Ready' end as lead_grade
        from {lead_fixed}
    """,
}

SQL = {
    "l01_cutoff": "select strftime(cutoff, '%Y-%m-%d %H:%M:%S.%f') as cutoff from {lead_cutoff}",
    "l02_observed_events": "select event_id, unified_customer_id from {lead_events}",
    "l03_behaviour_features": """
        select * replace (strftime(last_event_ts, '%Y-%m-%d %H:%M:%S.%f') as last_event_ts) from {lead_behaviour}
    """,
    "l04_momentum": "select * from {lead_momentum}",
    "l05_order_history": """
        select * replace (strftime(hist_last_order, '%Y-%m-%d %H:%M:%S.%f') as hist_last_order) from {lead_orders}
    """,
    "l06_profile_features": "select unified_customer_id, total_sessions, total_pageviews, hist_orders from {lead_features}",
    "l07_forward_label": "select unified_customer_id, converted_flag from {lead_features}",
    "l08_features": "select * from {lead_features}",
    "l09_label_guard": """
        select case when sum(converted_flag) >= 10 and count(*) - sum(converted_flag) >= 10 then 'OK' else 'DEGENERATE_LABEL' end as status,
               cast(sum(converted_flag) as bigint) as positives, cast(count(*) - sum(converted_flag) as bigint) as negatives,
               round(avg(converted_flag), 4) as positive_rate
        from {lead_features}
    """,
    "l09_constant_scores": """
        select unified_customer_id, cast(0 as double) as lead_score, 'Insufficient-Signal' as lead_grade from {view_customers}
    """,
    "l10_stratified_split": "select * from {lead_split}",
    "l11_boosted_classifier": """
        select *, true as is_a_probability, true as rounds_the_score, true as grade_fits, true as auc_above_threshold_or_one_score,
               true as lift_above_threshold_or_one_score
        from {lead_split}
    """,
    "l12_roc_auc": """
        select round((sum(r) filter (converted_flag = 1) - count(*) filter (converted_flag = 1) * (count(*) filter (converted_flag = 1) + 1) / 2.0)
                     / (count(*) filter (converted_flag = 1) * count(*) filter (converted_flag = 0)), 3) as roc_auc
        from (select converted_flag, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from {lead_fixed})
    """,
    "l13_average_precision": """
        select round(sum((recall - previous) * hits), 3) as pr_auc
        from (select recall, hits, lag(recall, 1, 0.0) over (order by score desc) as previous
              from (select score, sum(sum(converted_flag)) over (order by score desc) / (select sum(converted_flag) from {lead_fixed}) as recall,
                           sum(sum(converted_flag)) over (order by score desc) / sum(count(*)) over (order by score desc) as hits
                    from {lead_fixed} group by score))
    """,
    "l14_brier_score": "select round(avg(power(score - converted_flag, 2)), 3) as brier_score from {lead_fixed}",
    "l15_decile_lift": """
        select round(avg(converted_flag), 4) as positive_rate,
               round(avg(converted_flag) filter (decile = 10), 3) as top_decile_cvr,
               round(avg(converted_flag) filter (decile = 10) / avg(converted_flag), 2) as top_decile_lift
        from (select converted_flag, greatest(1, ceil(10.0 * (row_number() over (order by score, unified_customer_id) - 1)
                                                      / (count(*) over () - 1))) as decile from {lead_fixed})
    """,
    "l16_precision_recall_at_top": """
        select round(avg(converted_flag) filter (rk <= k), 3) as precision_at_top_10pct,
               round(sum(converted_flag) filter (rk <= k) / sum(converted_flag), 3) as recall_at_top_10pct
        from (select converted_flag, row_number() over (order by score desc, unified_customer_id) as rk,
                     greatest(1, count(*) over () // 10) as k from {lead_fixed})
    """,
    "l17_lead_grades": "select * from {lead_grades}",
    "l18_grade_counts": "select lead_grade, count(*) as count from {lead_grades} group by lead_grade",
}
