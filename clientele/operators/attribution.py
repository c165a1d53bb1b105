"""Rule-based credit for the touches of converting journeys, rolled up by channel.

One journey may hold a large share of all touches, so no window runs over raw touches.
They are first aggregated (map-side, then by journey, channel and time block), which
leaves a few rows per journey; totals over the journey then run on those rows.

Time decay weighs a touch ``2 ** (-age / half_life)``, age counted to the journey's last
touch.  Inside a block the age is counted to the block's end, and the block sum is scaled
once the last touch is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.functions.columns import MICROS_PER_DAY, amount, dated, exact_sum, round_half_up
from clientele.operators.rfm import CUSTOMER
from clientele.sources.scratch import materialise

# Half-lives per time block: sums inside a block span at most this many powers of two.
BLOCK_HALF_LIVES = 32

MODELS = ("first_touch", "last_touch", "linear", "time_decay")


def in_window(touches: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Touches between two optional moments, both included; a bare date means its midnight."""
    if start:
        first = F.lit(start).cast("timestamp")
        touches = dated(touches, low=first).where(F.col("event_timestamp") >= first)
    if end:
        last = F.lit(end).cast("timestamp")
        touches = dated(touches, high=last).where(F.col("event_timestamp") <= last)
    return touches


def converting_journeys(touches: DataFrame) -> DataFrame:
    """All touches of customers with at least one conversion."""
    # Written first, so that both join inputs are plain shuffles and a long journey can be split.
    converters = materialise(touches.where(F.col("conversion_flag") == 1).select(CUSTOMER).distinct(), "converters")
    return touches.join(converters, CUSTOMER, "left_semi")


def _elapsed(later: Column, earlier: Column, half_life_days: float) -> Column:
    """Time between two microsecond stamps, in half-lives."""
    return (later - earlier) / F.lit(MICROS_PER_DAY * half_life_days)


def _blocks(touches: DataFrame, half_life_days: float) -> DataFrame:
    """One row per journey, channel and time block."""
    width = F.lit(int(BLOCK_HALF_LIVES * half_life_days * MICROS_PER_DAY))
    stamp = F.unix_micros("event_timestamp")
    block_end = stamp - F.pmod(stamp, width) + width
    order = F.struct("event_timestamp", "touchpoint_id")
    converted = F.col("conversion_flag") == 1
    return (
        touches.where(F.col(CUSTOMER).isNotNull())
        .withColumns({"_stamp": stamp, "_block_end": block_end})
        .groupBy(CUSTOMER, "channel", "_block_end")
        .agg(
            F.count("*").alias("_touches"),
            F.sum(
                F.pow(F.lit(2.0), -_elapsed(F.col("_block_end"), F.col("_stamp"), half_life_days))
            ).alias("_decay"),
            F.min(order).alias("_first"),
            F.max(order).alias("_last"),
            F.max("_stamp").alias("_latest"),
            F.max(converted.cast("int")).alias("_converted"),
            F.sum(amount(F.when(converted, F.col("attributed_revenue")))).alias("_revenue"),
        )
    )


def journey_credit(touches: DataFrame, half_life_days: float = 7.0) -> DataFrame:
    """Credit of every channel in every converting journey, by model.

    The credits of one model add up to 1 per journey; revenue is the journey's total, to which amounts
    that are no finite number add nothing.
    """
    journey = Window.partitionBy(CUSTOMER)
    scale = F.pow(
        F.lit(2.0), -_elapsed(F.col("_journey_latest"), F.col("_block_end"), half_life_days)
    )
    blocks = (
        _blocks(touches, half_life_days)
        .withColumns(
            {
                "_journey_converted": F.max("_converted").over(journey),
                "_journey_latest": F.max("_latest").over(journey),
                "_journey_first": F.min("_first").over(journey),
                "_journey_last": F.max("_last").over(journey),
                "_journey_touches": F.sum("_touches").over(journey),
                "_journey_revenue": F.sum("_revenue").over(journey),
            }
        )
        .where(F.col("_journey_converted") == 1)
        .withColumn("_weight", F.col("_decay") * scale)
        .withColumn("_journey_weight", F.sum("_weight").over(journey))
    )
    return blocks.groupBy(CUSTOMER, "channel").agg(
        F.sum((F.col("_first") == F.col("_journey_first")).cast("double")).alias("first_touch"),
        F.sum((F.col("_last") == F.col("_journey_last")).cast("double")).alias("last_touch"),
        (F.sum("_touches") / F.max("_journey_touches")).alias("linear"),
        (F.sum("_weight") / F.max("_journey_weight")).alias("time_decay"),
        F.max("_journey_revenue").cast("double").alias("revenue"),
    )


def channel_rollup(credit: DataFrame) -> DataFrame:
    """Attributed conversions and revenue per channel and model."""
    columns = []
    for model in MODELS:
        columns += [
            round_half_up(F.sum(model), 2).alias(f"{model}_conversions"),
            round_half_up(F.sum(F.col(model) * F.col("revenue")), 2).alias(f"{model}_revenue"),
        ]
    return credit.where(F.col("channel").isNotNull()).groupBy("channel").agg(*columns)


def rule_based(touches: DataFrame, half_life_days: float = 7.0) -> DataFrame:
    """First-touch, last-touch, linear and time-decay results by channel."""
    return channel_rollup(journey_credit(touches, half_life_days))


def compare(rule_based_result: DataFrame, markov_result: DataFrame) -> DataFrame:
    """Rule-based next to removal-effect attribution; a channel without a share gets 0."""
    return rule_based_result.join(markov_result, "channel", "left").fillna(0)


def reconcile(touches: DataFrame, rule_based_result: DataFrame) -> DataFrame:
    """Does the last-touch revenue add up to the converted revenue?"""
    converted = F.when(F.col("conversion_flag") == 1, F.col("attributed_revenue"))
    attributed = rule_based_result.agg(F.coalesce(F.sum("last_touch_revenue"), F.lit(0.0))).scalar()
    return (
        touches.agg(F.coalesce(exact_sum(converted), F.lit(0.0)).alias("total_converted_revenue"))
        .withColumn("last_touch_attributed_revenue", attributed)
        .select(
            round_half_up("total_converted_revenue", 2).alias("total_converted_revenue"),
            round_half_up("last_touch_attributed_revenue", 2).alias("last_touch_attributed_revenue"),
            (
                F.abs(F.col("total_converted_revenue") - F.col("last_touch_attributed_revenue")) < 1.0
            ).alias("match"),
        )
    )


def conversions_by_model(comparison: DataFrame) -> DataFrame:
    """Channel, model, conversions: the wide result as rows."""
    return comparison.unpivot(
        "channel", [f"{model}_conversions" for model in MODELS], "attribution_model", "conversions"
    )
