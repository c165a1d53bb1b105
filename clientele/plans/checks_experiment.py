"""Registered queries for holdout experiments, and their check SQL."""

from __future__ import annotations

from datetime import datetime

from clientele.operators import experiment
from clientele.plans.inputs import plain

ACTIVATION = "ACT_SPRING"
ACTIVATED_AT = datetime(2024, 1, 28)
# Later by half the time of the events, so that both sides of it hold purchases.
ADJUSTED_AT = datetime(2024, 1, 16)
NOW = datetime(2026, 1, 1)


def _arms(v):
    return experiment.assign_arms(v["view_experiment_members"], ACTIVATION, 0.1)


def _outcomes(v):
    return experiment.arm_outcomes(_arms(v), v["view_purchases"], ACTIVATED_AT)


def _lift(v):
    return experiment.lift(_outcomes(v))


QUERIES = {
    "x01_holdout_split": _arms,
    "x02_arm_outcomes": _outcomes,
    "x03_lift_test": _lift,
    "x03_adjusted_lift": lambda v: experiment.adjusted_lift(
        experiment.revenue_around(_arms(v), v["view_purchases"], ADJUSTED_AT)
    ),
    "x04_experiment_result": lambda v: plain(
        experiment.experiment_result(_lift(v), "EXP_SPRING", ACTIVATION, "AUD_SPRING", NOW)
    ),
}

PARTS = {
    "arms": """
        select unified_customer_id, case when rk <= greatest(1, n // 10) then 'control' else 'treatment' end as arm
        from (select unified_customer_id, count(*) over () as n,
                     row_number() over (order by md5(concat('ACT_SPRING:', unified_customer_id)), unified_customer_id) as rk
              from {view_experiment_members})
    """,
    "outcomes": """
        select arm, count(*) as members, count(*) filter (bought) as conversions, round(avg(cast(bought as int)), 4) as conversion_rate
        from (select arm, unified_customer_id in (select unified_customer_id from {view_purchases}
                                                  where order_timestamp > timestamp '2024-01-28') as bought from {arms})
        group by arm
    """,
    "rates": """
        select max(members) filter (arm = 'control') as nc, max(members) filter (arm = 'treatment') as nt,
               max(conversions) filter (arm = 'control') as cc, max(conversions) filter (arm = 'treatment') as ct
        from {outcomes}
    """,
    "z_test": """
        select *, cc / nc as pc, ct / nt as pt,
               abs(ct / nt - cc / nc) / sqrt((cc + ct) / (nc + nt) * (1 - (cc + ct) / (nc + nt)) * (1.0 / nc + 1.0 / nt)) / sqrt(2.0) as x
        from {rates}
    """,
    "tested": """
        select nc, nt, pc, pt, 1 - 2 / sqrt(pi()) * sum(power(-1, k) * exp((2 * k + 1) * ln(x) - lgamma(k + 1)) / (2 * k + 1)) as p
        from {z_test}, range(0, 80) series(k) group by nc, nt, pc, pt
    """,
    "lift": """
        select round(pc, 4) as control_value, round(pt, 4) as treatment_value,
               round(case when pc > 0 then (pt - pc) / pc * 100 else 0 end, 2) as lift_pct, round(p, 4) as p_value,
               p < 0.05 as is_significant, nc + nt as sample_size, nc as holdout_size, nt as treatment_size
        from {tested}
    """,
}

_SUMS = ", ".join(
    f"sum(cast({term} as decimal(28, 6))) filter (arm = '{arm}') as {arm[0]}_{name}"
    for arm in ("control", "treatment")
    for name, term in {"x": "x", "y": "y", "xx": "x * x", "xy": "x * y", "yy": "y * y"}.items()
)

PARTS |= {
    "around": """
        select arm, coalesce(cast(sum(cast(case when order_timestamp <= timestamp '2024-01-16' then revenue end as decimal(28, 6))) as double), 0) as x,
               coalesce(cast(sum(cast(case when order_timestamp > timestamp '2024-01-16' then revenue end as decimal(28, 6))) as double), 0) as y
        from {arms} a left join {view_purchases} p on a.unified_customer_id = p.unified_customer_id group by a.unified_customer_id, arm
    """,
    "moments": f"""
        select cast(count(*) filter (arm = 'control') as double) as c_n, cast(count(*) filter (arm = 'treatment') as double) as t_n, {_SUMS}
        from {{around}}
    """,
    "within": """
        select c_n, t_n, cast(c_x as double) / c_n as mcx, cast(t_x as double) / t_n as mtx, cast(c_y as double) / c_n as mcy, cast(t_y as double) / t_n as mty,
               (cast(c_xx as double) - cast(c_x as double) * cast(c_x as double) / c_n) + (cast(t_xx as double) - cast(t_x as double) * cast(t_x as double) / t_n) as sxx,
               (cast(c_xy as double) - cast(c_x as double) * cast(c_y as double) / c_n) + (cast(t_xy as double) - cast(t_x as double) * cast(t_y as double) / t_n) as sxy,
               (cast(c_yy as double) - cast(c_y as double) * cast(c_y as double) / c_n) + (cast(t_yy as double) - cast(t_y as double) * cast(t_y as double) / t_n) as syy
        from {moments}
    """,
}

SQL = {
    "x03_adjusted_lift": """
        select round(mcy, 4) as control_mean, round(mty, 4) as treatment_mean, round(mty - mcy, 4) as difference,
               round((mty - mcy) / sqrt(syy / (c_n + t_n - 2) * (1 / c_n + 1 / t_n)), 4) as z,
               round((mty - mcy) - sxy / sxx * (mtx - mcx), 4) as adjusted_difference,
               round(((mty - mcy) - sxy / sxx * (mtx - mcx)) / sqrt((syy - sxy / sxx * sxy) / (c_n + t_n - 3) * (1 / c_n + 1 / t_n)), 4) as adjusted_z,
               round(sxy / sxx, 6) as slope, round(sxy / sxx * sxy / syy * 100, 2) as variance_saved_pct
        from {within}
    """,
    "x01_holdout_split": "select * from {arms}",
    "x02_arm_outcomes": "select * from {outcomes}",
    "x03_lift_test": "select * from {lift}",
    "x04_experiment_result": """
        select 'EXP_SPRING' as experiment_id, 'ACT_SPRING' as activation_id, 'AUD_SPRING' as audience_id, 'conversion_rate' as metric_name,
               control_value, treatment_value, lift_pct, p_value, is_significant, cast(sample_size as int) as sample_size,
               '2026-01-01 00:00:00.000000' as measured_at
        from {lift}
    """,
}
