"""Registered queries for attribution, and their check SQL."""

from __future__ import annotations

from clientele.operators import attribution, markov
from clientele.plans.inputs import rounded

# Half-life, and the window of the date filter.
HALF_LIFE_DAYS = 7.0
START, END = "2024-01-08", "2024-01-20"

KEY = "unified_customer_id"


def _touches(v):
    return v["view_touchpoints"]


def _credit(v):
    return attribution.journey_credit(_touches(v), HALF_LIFE_DAYS)


def _rule_based(v):
    return attribution.rule_based(_touches(v), HALF_LIFE_DAYS)


def _probabilities(v):
    return markov.transition_probabilities(markov.transition_counts(_touches(v)))


def _reached(v):
    return markov.conversion_probabilities(_probabilities(v))


QUERIES = {
    "a01_touch_window": lambda v: attribution.in_window(_touches(v), START, END).select(
        "touchpoint_id", KEY, "channel", "conversion_flag"
    ),
    "a02_converting_journeys": lambda v: attribution.converting_journeys(_touches(v)).select(
        "touchpoint_id", KEY
    ),
    "a03_first_touch": lambda v: _credit(v)
    .where("first_touch > 0")
    .select(KEY, "channel", "first_touch", "revenue"),
    "a04_last_touch": lambda v: _credit(v)
    .where("last_touch > 0")
    .select(KEY, "channel", "last_touch", "revenue"),
    "a05_linear": lambda v: rounded(_credit(v).select(KEY, "channel", "linear")),
    "a06_time_decay": lambda v: rounded(_credit(v).select(KEY, "channel", "time_decay")),
    "a06_time_decay_short": lambda v: rounded(
        attribution.journey_credit(_touches(v), 0.25).select(KEY, "channel", "time_decay")
    ),
    "a07_channel_rollup": _rule_based,
    "a08_journey_edges": lambda v: markov.journey_steps(_touches(v)),
    "a09_transition_counts": lambda v: markov.transition_counts(_touches(v)),
    "a10_transition_probabilities": lambda v: rounded(_probabilities(v)),
    "a11_conversion_probability": lambda v: rounded(_reached(v)),
    "a12_removal_effect": lambda v: rounded(markov.removal_effects(_reached(v))),
    "a13_markov_shares": lambda v: markov.markov(_touches(v)),
    "a14_model_comparison": lambda v: attribution.compare(
        _rule_based(v), markov.markov(_touches(v))
    ),
    "a15_reconciliation": lambda v: attribution.reconcile(_touches(v), _rule_based(v)),
    "a16_conversions_by_model": lambda v: attribution.conversions_by_model(_rule_based(v)),
}



def _step(previous: str) -> str:
    """One transition of all scenarios."""
    return f"""
        select s.removed, t.to_state as state, sum(s.mass * t.p) as mass
        from {{{previous}}} s join {{markov_matrix}} t on s.state = t.from_state
        where s.state <> s.removed group by s.removed, t.to_state
    """


PARTS = {
    "journeys": """
        select t.*, row_number() over (partition by unified_customer_id order by event_timestamp, touchpoint_id) as position,
               count(*) over (partition by unified_customer_id) as touches,
               max(event_timestamp) over (partition by unified_customer_id) as last_time,
               max(conversion_flag) over (partition by unified_customer_id) as converted,
               sum(cast(case when conversion_flag = 1 then attributed_revenue else 0 end as decimal(28, 6)))
                   over (partition by unified_customer_id) as total
        from {view_touchpoints} t
    """,
    "weighted": """
        select *, power(2.0, -date_diff('microsecond', event_timestamp, last_time) / 86400000000.0 / 7.0) as w7,
               power(2.0, -date_diff('microsecond', event_timestamp, last_time) / 86400000000.0 / 0.25) as w025
        from {journeys} where converted = 1
    """,
    "touch_credit": """
        select unified_customer_id, channel, cast(total as double) as revenue,
               case when position = 1 then 1.0 else 0.0 end as ft, case when position = touches then 1.0 else 0.0 end as lt,
               1.0 / touches as lin, w7 / sum(w7) over (partition by unified_customer_id) as td,
               w025 / sum(w025) over (partition by unified_customer_id) as td_short
        from {weighted}
    """,
    "rule_based": """
        select channel, round(sum(ft), 2) as first_touch_conversions, round(sum(ft * revenue), 2) as first_touch_revenue,
               round(sum(lt), 2) as last_touch_conversions, round(sum(lt * revenue), 2) as last_touch_revenue,
               round(sum(lin), 2) as linear_conversions, round(sum(lin * revenue), 2) as linear_revenue,
               round(sum(td), 2) as time_decay_conversions, round(sum(td * revenue), 2) as time_decay_revenue
        from (select channel, cast(ft as double) as ft, cast(lt as double) as lt, cast(lin as double) as lin, td, revenue from {touch_credit})
        group by channel
    """,
    "markov_edges": """
        select case when position = 1 then 'Start' end as from_state, concat('channel:', channel) as to_state
        from {journeys} where position = 1
        union all
        select concat('channel:', channel),
               coalesce(lead(concat('channel:', channel)) over (partition by unified_customer_id order by position),
                        case when converted = 1 then 'Conversion' else 'Null' end)
        from {journeys}
    """,
    "markov_counts": """
        select from_state, to_state, cast(count(*) as bigint) as n from {markov_edges} group by from_state, to_state
    """,
    "markov_matrix": """
        select from_state, to_state, n, n / sum(n) over (partition by from_state) as p from {markov_counts}
    """,
    "mass0": """
        select removed, 'Start' as state, cast(1.0 as double) as mass
        from (select '' as removed union all select distinct concat('channel:', channel) from {view_touchpoints})
    """,
    **{f"mass{i}": _step(f"mass{i - 1}") for i in range(1, 6)},
    "markov_reached": """
        select removed, coalesce(sum(m.mass), 0.0) as conversion_probability
        from (select removed from {mass0}) left join (
            select removed, mass from (select * from {mass1} union all select * from {mass2} union all select * from {mass3}
            union all select * from {mass4} union all select * from {mass5}) where state = 'Conversion') m using (removed)
        group by removed
    """,
    "markov_effects": """
        select substr(removed, 9) as channel,
               greatest(0, (base - conversion_probability) / base) as removal_effect
        from {markov_reached}, (select conversion_probability as base from {markov_reached} where removed = '')
        where removed <> ''
    """,
    "markov_shares": """
        select channel, round(removal_effect / sum(removal_effect) over (), 4) as markov_weight,
               round(removal_effect / sum(removal_effect) over () * 100, 2) as markov_share_pct
        from {markov_effects}
    """,
}

SQL = {
    "a01_touch_window": """
        select touchpoint_id, unified_customer_id, channel, conversion_flag from {view_touchpoints}
        where event_timestamp >= timestamp '2024-01-08' and event_timestamp <= timestamp '2024-01-20'
    """,
    "a02_converting_journeys": """
        select touchpoint_id, unified_customer_id from {view_touchpoints}
        where unified_customer_id in (select unified_customer_id from {view_touchpoints} where conversion_flag = 1)
    """,
    "a03_first_touch": """
        select unified_customer_id, channel, cast(ft as double) as first_touch, revenue from {touch_credit} where ft > 0
    """,
    "a04_last_touch": """
        select unified_customer_id, channel, cast(lt as double) as last_touch, revenue from {touch_credit} where lt > 0
    """,
    "a05_linear": """
        select unified_customer_id, channel, round(count(*) / max(touches), 6) as linear
        from {journeys} where converted = 1 group by unified_customer_id, channel
    """,
    "a06_time_decay": """
        select unified_customer_id, channel, round(sum(td), 6) as time_decay from {touch_credit} group by unified_customer_id, channel
    """,
    "a06_time_decay_short": """
        select unified_customer_id, channel, round(sum(td_short), 6) as time_decay from {touch_credit} group by unified_customer_id, channel
    """,
    "a07_channel_rollup": "select * from {rule_based}",
    "a08_journey_edges": """
        select unified_customer_id, null as touchpoint_id, 'Start' as from_state, concat('channel:', coalesce(channel, 'unknown')) as to_state
        from {journeys} where position = 1 and unified_customer_id is not null
        union all
        select unified_customer_id, touchpoint_id, concat('channel:', coalesce(channel, 'unknown')),
               coalesce(lead(concat('channel:', coalesce(channel, 'unknown'))) over (partition by unified_customer_id order by position),
                        case when converted = 1 then 'Conversion' else 'Null' end)
        from {journeys} where unified_customer_id is not null
    """,
    "a09_transition_counts": "select * from {markov_counts}",
    "a10_transition_probabilities": "select from_state, to_state, n, round(p, 6) as p from {markov_matrix}",
    "a11_conversion_probability": """
        select removed, round(conversion_probability, 6) as conversion_probability from {markov_reached}
    """,
    "a12_removal_effect": "select channel, round(removal_effect, 6) as removal_effect from {markov_effects}",
    "a13_markov_shares": "select * from {markov_shares}",
    "a14_model_comparison": """
        select r.*, coalesce(markov_weight, 0) as markov_weight, coalesce(markov_share_pct, 0) as markov_share_pct
        from {rule_based} r left join {markov_shares} using (channel)
    """,
    "a15_reconciliation": """
        select total_converted_revenue, last_touch_attributed_revenue,
               abs(total_converted_revenue - last_touch_attributed_revenue) < 1.0 as match
        from (select round(cast(sum(cast(attributed_revenue as decimal(28, 6))) as double), 2) as total_converted_revenue
              from {view_touchpoints} where conversion_flag = 1),
             (select round(sum(last_touch_revenue), 2) as last_touch_attributed_revenue from {rule_based})
    """,
    "a16_conversions_by_model": """
        select channel, 'first_touch_conversions' as attribution_model, first_touch_conversions as conversions from {rule_based}
        union all select channel, 'last_touch_conversions', last_touch_conversions from {rule_based}
        union all select channel, 'linear_conversions', linear_conversions from {rule_based}
        union all select channel, 'time_decay_conversions', time_decay_conversions from {rule_based}
    """,
}
