"""Registered queries for lifetime value, and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.functions.columns import round_half_up
from clientele.operators import cltv
from clientele.plans.inputs import (
    CLTV_WINDOW_DAYS,
    cltv_features,
    fixed_cltv,
    plain,
)
from clientele.sources.scratch import materialise


def _deciles(v):
    return cltv.deciles(fixed_cltv(v), "predicted_cltv", "cltv_decile")


def _model_metrics(v):
    """What must hold of the metrics of any fitted model, and the size of the part they come from."""
    features = materialise(cltv_features(v), "features")
    metrics = cltv.train_and_evaluate(features)[1]
    test = cltv.train_test(features).where("NOT is_train").agg(F.count("*")).scalar()
    share = F.col("top_decile_actual_revenue_share_pct")
    return metrics.select(
        test.alias("test_customers"),
        (F.col("mae") >= 0).alias("error_is_no_less_than_zero"),
        (F.col("rmse") >= F.col("mae")).alias("rmse_is_no_less_than_mae"),
        (F.col("r2") <= 1).alias("r2_is_at_most_one"),
        share.between(0, 100).alias("share_is_a_percentage"),
    )


def _model_scores(v):
    """Every customer with the split flag and what must hold of the fitted score."""
    split = materialise(cltv.train_test(cltv_features(v)), "cltv")
    scored = materialise(cltv.predict(cltv.train(split), split), "scored")
    rounded = scored.withColumn("predicted_cltv", round_half_up("raw_cltv", 2))
    ranked = cltv.deciles(rounded, "predicted_cltv", "cltv_decile")
    lowest = ranked.groupBy((F.col("cltv_decile") - 1).alias("cltv_decile")).agg(F.min("predicted_cltv").alias("_next"))
    score = F.col("predicted_cltv")
    return ranked.join(F.broadcast(lowest), "cltv_decile", "left").select(
        "unified_customer_id",
        "is_train",
        (score >= 0).alias("not_negative"),
        (F.abs(score - F.col("raw_cltv")) <= 0.005001).alias("rounds_the_prediction"),
        (F.coalesce("_next", score) >= score).alias("in_decile_order"),
    )


QUERIES = {
    "c01_cutoff": lambda v: plain(
        v.spark.range(1).select(
            cltv.cutoff_date(v["view_transactions"], CLTV_WINDOW_DAYS).alias("cutoff")
        )
    ),
    "c02_split_periods": lambda v: cltv.split_periods(
        v["view_transactions"], CLTV_WINDOW_DAYS
    ).select("order_id", "unified_customer_id", "period"),
    "c03_history_features": lambda v: plain(
        cltv.history_features(v["view_transactions"], CLTV_WINDOW_DAYS)
    ),
    "c04_engagement_features": lambda v: cltv.engagement_features(
        v["view_early_events"], v["view_transactions"], CLTV_WINDOW_DAYS
    ),
    "c05_future_revenue": lambda v: cltv.future_revenue(v["view_transactions"], CLTV_WINDOW_DAYS),
    "c06_features": cltv_features,
    "c07_is_subscriber": lambda v: cltv_features(v).select("unified_customer_id", "is_subscriber"),
    "c08_train_test_split": lambda v: cltv.train_test(v["view_customers"]).select(
        "unified_customer_id", "is_train"
    ),
    "c09_boosted_regression": _model_metrics,
    "c10_model_scores": _model_scores,
    "c11_score_deciles": lambda v: _deciles(v).select(
        "unified_customer_id", "predicted_cltv", "cltv_decile"
    ),
    "c12_regression_metrics": lambda v: fixed_cltv(v).agg(
        *cltv.regression_metrics("future_revenue", "predicted_cltv")
    ),
    "c13_top_decile_share": lambda v: _deciles(v).agg(
        cltv.top_decile_share("future_revenue", "cltv_decile")
    ),
    "c14_mean_by_decile": lambda v: cltv.mean_by_decile(_deciles(v)),
}

PARTS = {
    "cltv_split": """
        select unified_customer_id,
               cast(concat('0x', substr(md5(cast(unified_customer_id as varchar)), 1, 7)) as bigint) % 100 < 75 as is_train
        from {view_customers}
    """,
    "cltv_cutoff": "select max(order_timestamp) - interval 180 day as cutoff from {view_transactions}",
    "cltv_history": """
        select unified_customer_id, cast(count(distinct order_id) as int) as hist_orders,
               cast(sum(cast(revenue as decimal(28, 6))) as double) as hist_revenue,
               cast(sum(cast(gross_margin as decimal(28, 6))) as double) as hist_margin,
               cast(sum(cast(revenue as decimal(28, 6))) as double) / count(*) as avg_order_value,
               max(order_timestamp) as last_order_date, min(order_timestamp) as first_order_date,
               cast(date_sub('day', max(order_timestamp), (select cutoff from {cltv_cutoff})) as int) as hist_recency_days,
               cast(date_sub('day', min(order_timestamp), (select cutoff from {cltv_cutoff})) as int) as customer_tenure_days
        from {view_transactions} where order_timestamp <= (select cutoff from {cltv_cutoff}) group by unified_customer_id
    """,
    "cltv_engagement": """
        select unified_customer_id, cast(count(*) as int) as total_events,
               cast(count(*) filter (event_type = 'pricing_view') as int) as pricing_views,
               cast(count(*) filter (event_type = 'add_to_cart') as int) as cart_adds
        from {view_early_events} where event_timestamp <= (select cutoff from {cltv_cutoff}) group by unified_customer_id
    """,
    "cltv_target": """
        select unified_customer_id, cast(sum(cast(revenue as decimal(28, 6))) as double) as future_revenue
        from {view_transactions} where order_timestamp > (select cutoff from {cltv_cutoff}) group by unified_customer_id
    """,
    "cltv_features": """
        select unified_customer_id, coalesce(hist_orders, 0) as hist_orders, coalesce(hist_revenue, 0.0) as hist_revenue,
               coalesce(hist_margin, 0.0) as hist_margin, coalesce(avg_order_value, 0.0) as avg_order_value,
               coalesce(hist_recency_days, 999) as hist_recency_days, coalesce(customer_tenure_days, 0) as customer_tenure_days,
               coalesce(total_events, 0) as total_events, coalesce(pricing_views, 0) as pricing_views,
               coalesce(cart_adds, 0) as cart_adds, case when subscription_status = 'active' then 1 else 0 end as is_subscriber,
               coalesce(future_revenue, 0.0) as future_revenue
        from {view_customers} left join {cltv_history} using (unified_customer_id)
             left join {cltv_engagement} using (unified_customer_id) left join {cltv_target} using (unified_customer_id)
    """,
    "cltv_fixed": """
        select *, round(hist_revenue + 25.0 * total_events, 2) as predicted_cltv from {cltv_features}
    """,
    "cltv_deciles": """
        select *, cast(greatest(1, ceil(10.0 * (row_number() over (order by predicted_cltv, unified_customer_id) - 1)
                                        / (count(*) over () - 1))) as int) as cltv_decile
        from {cltv_fixed}
    """,
}

SQL = {
    "c01_cutoff": "select strftime(cutoff, '%Y-%m-%d %H:%M:%S.%f') as cutoff from {cltv_cutoff}",
    "c02_split_periods": """
        select order_id, unified_customer_id,
               case when order_timestamp <= (select cutoff from {cltv_cutoff}) then 'observation' else 'performance' end as period
        from {view_transactions}
    """,
    "c03_history_features": """
        select unified_customer_id, hist_orders, hist_revenue, hist_margin, avg_order_value,
               strftime(last_order_date, '%Y-%m-%d %H:%M:%S.%f') as last_order_date,
               strftime(first_order_date, '%Y-%m-%d %H:%M:%S.%f') as first_order_date, hist_recency_days, customer_tenure_days
        from {cltv_history}
    """,
    "c04_engagement_features": "select * from {cltv_engagement}",
    "c05_future_revenue": "select * from {cltv_target}",
    "c06_features": "select * from {cltv_features}",
    "c07_is_subscriber": """
        select unified_customer_id, cast(coalesce(subscription_status, '') = 'active' as int) as is_subscriber from {view_customers}
    """,
    "c08_train_test_split": "select * from {cltv_split}",
    "c09_boosted_regression": """
        select (select count(*) from {cltv_split} where not is_train) as test_customers, true as error_is_no_less_than_zero,
               true as rmse_is_no_less_than_mae, true as r2_is_at_most_one, true as share_is_a_percentage
    """,
    "c10_model_scores": """
        select unified_customer_id, is_train, true as not_negative, true as rounds_the_prediction, true as in_decile_order
        from {cltv_split}
    """,
    "c11_score_deciles": "select unified_customer_id, predicted_cltv, cltv_decile from {cltv_deciles}",
    "c12_regression_metrics": """
        select round(avg(abs(future_revenue - predicted_cltv)), 2) as mae,
               round(sqrt(avg(power(future_revenue - predicted_cltv, 2))), 2) as rmse,
               round(1 - sum(power(future_revenue - predicted_cltv, 2))
                         / sum(power(future_revenue - (select avg(future_revenue) from {cltv_fixed}), 2)), 3) as r2
        from {cltv_fixed}
    """,
    "c13_top_decile_share": """
        select round(sum(case when cltv_decile = 10 then future_revenue else 0 end) / sum(future_revenue) * 100, 1)
               as top_decile_actual_revenue_share_pct from {cltv_deciles}
    """,
    "c14_mean_by_decile": """
        select cltv_decile, cast(sum(cast(predicted_cltv as decimal(28, 6))) as double) / count(*) as mean_predicted_cltv
        from {cltv_deciles} group by cltv_decile
    """,
}
