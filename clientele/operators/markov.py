"""Removal-effect attribution on the transition matrix of all journeys.

Journeys are put in order by range partitions on (customer, time, touch), so a journey of
any length is spread over partitions.  Steps inside a piece come from ``lead``; the steps
between pieces come from the pieces' first and last states, a table with one row per
journey and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.functions.columns import round_half_up
from clientele.operators.ranking import range_partitions
from clientele.operators.rfm import CUSTOMER
from clientele.sources.scratch import materialise

# The outer states; channel states carry a prefix, so names cannot collide.
START, CONVERSION, NULL = "Start", "Conversion", "Null"
PREFIX = "channel:"

# Only journeys of up to this many transitions earn conversion probability.
HORIZON = 5

NOTHING_REMOVED = ""


# Order of a piece's rows: its first state, then its last state, then its conversion mark.
_HEAD, _TAIL, _MARK = 0, 1, 2


def _pieces(touches: DataFrame) -> DataFrame:
    """Counted steps inside pieces; first state, last state and conversion mark per piece.

    One linear plan: the range split is computed once, and its partition number is a
    column of every row that follows from it.
    """
    state = F.concat(F.lit(PREFIX), F.coalesce("channel", F.lit("unknown")))
    in_order = Window.partitionBy("_part", CUSTOMER).orderBy("event_timestamp", "touchpoint_id")
    steps = (
        touches.where(F.col(CUSTOMER).isNotNull())
        .select(
            CUSTOMER,
            "event_timestamp",
            "touchpoint_id",
            state.alias("_state"),
            (F.col("conversion_flag") == 1).alias("_converts"),
        )
        .repartitionByRange(
            range_partitions(touches.sparkSession), CUSTOMER, "event_timestamp", "touchpoint_id"
        )
        .withColumn("_part", F.spark_partition_id())
        .withColumns(
            {"_next": F.lead("_state").over(in_order), "_previous": F.lag("_state").over(in_order)}
        )
    )

    def piece_row(kind: int, condition: Column, known: Column) -> Column:
        return F.when(
            condition,
            F.struct(
                F.col(CUSTOMER), F.col("_part"), F.lit(kind).alias("_kind"),
                known.alias("_from"), F.lit(None).cast("string").alias("_to"),
            ),
        )

    inner_step = F.when(
        F.col("_next").isNotNull(),
        F.struct(
            F.when(F.lit(False), F.col(CUSTOMER)).alias(CUSTOMER),
            F.lit(None).cast("int").alias("_part"), F.lit(None).cast("int").alias("_kind"),
            F.col("_state").alias("_from"), F.col("_next").alias("_to"),
        ),
    )
    rows = F.array(
        inner_step,
        piece_row(_HEAD, F.col("_previous").isNull(), F.col("_state")),
        piece_row(_TAIL, F.col("_next").isNull(), F.col("_state")),
        piece_row(_MARK, F.col("_converts"), F.lit(CONVERSION)),
    )
    return (
        steps.select(F.inline(F.array_compact(rows)))
        .groupBy(CUSTOMER, "_part", "_kind", "_from", "_to")
        .agg(F.count("*").alias("_count"))
    )


def transition_counts(touches: DataFrame) -> DataFrame:
    """How often each state follows another, over all customers.

    A journey's pieces are put together here: at most three rows per journey and partition.
    """
    kind = F.col("_kind")
    journey = Window.partitionBy(CUSTOMER)
    marks_last = journey.orderBy("_late", "_part", "_kind")
    outcome = F.when(F.col("_converted"), CONVERSION).otherwise(NULL)
    following = F.when(F.col("_next_kind") == _HEAD, F.col("_next_state"))
    pieces = (
        _pieces(touches)
        .withColumn("_late", F.coalesce(kind == _MARK, F.lit(False)))
        .withColumns(
            {
                "_next_state": F.lead("_from").over(marks_last),
                "_next_kind": F.lead("_kind").over(marks_last),
                "_is_first": F.row_number().over(marks_last) == 1,
                "_converted": F.max("_late").over(journey),
            }
        )
        .where(kind.isNull() | (kind == _TAIL) | ((kind == _HEAD) & F.col("_is_first")))
    )
    return (
        pieces.select(
            F.when(kind == _HEAD, START).otherwise(F.col("_from")).alias("from_state"),
            F.when(kind.isNull(), F.col("_to"))
            .when(kind == _HEAD, F.col("_from"))
            .otherwise(F.coalesce(following, outcome))
            .alias("to_state"),
            F.when(kind.isNull(), F.col("_count")).otherwise(1).alias("n"),
        )
        .groupBy("from_state", "to_state")
        .agg(F.sum("n").alias("n"))
    )


def journey_steps(touches: DataFrame) -> DataFrame:
    """Every step of every journey: ``(customer, touchpoint_id, from_state, to_state)``.

    The step into the first channel has no touch; the last touch leads to Conversion or Null.  Steps
    inside a range partition come from ``lead``, those between partitions from one row per journey and
    partition.
    """
    order = ["event_timestamp", "touchpoint_id"]
    state = F.concat(F.lit(PREFIX), F.coalesce("channel", F.lit("unknown")))
    inside = Window.partitionBy("_part", CUSTOMER).orderBy(*order)
    steps = materialise(
        touches.where(F.col(CUSTOMER).isNotNull())
        .select(CUSTOMER, *order, state.alias("_state"), (F.col("conversion_flag") == 1).alias("_converts"))
        .repartitionByRange(range_partitions(touches.sparkSession), CUSTOMER, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_next", F.lead("_state").over(inside)),
        "steps",
    )
    pieces = steps.groupBy(CUSTOMER, "_part").agg(
        F.min_by("_state", F.struct(*order)).alias("_head"), F.max(F.coalesce("_converts", F.lit(False))).alias("_converts")
    )
    journey = Window.partitionBy(CUSTOMER)
    ends = materialise(
        pieces.withColumns(
            {
                "_next_head": F.lead("_head").over(journey.orderBy("_part")),
                "_first": F.row_number().over(journey.orderBy("_part")) == 1,
                "_outcome": F.when(F.max("_converts").over(journey), CONVERSION).otherwise(NULL),
            }
        ).drop("_converts"),
        "ends",
    )
    starts = ends.where("_first").select(
        CUSTOMER, F.lit(None).cast(steps.schema["touchpoint_id"].dataType).alias("touchpoint_id"),
        F.lit(START).alias("from_state"), F.col("_head").alias("to_state"),
    )
    following = steps.join(ends, [CUSTOMER, "_part"]).select(
        CUSTOMER, "touchpoint_id", F.col("_state").alias("from_state"),
        F.coalesce("_next", "_next_head", "_outcome").alias("to_state"),
    )
    return starts.unionByName(following)


def transition_probabilities(counts: DataFrame) -> DataFrame:
    """Share of each next state; the counts have at most (channels + 2) squared rows."""
    total = F.sum("n").over(Window.partitionBy("from_state"))
    return counts.withColumn("p", F.col("n") / total)


def conversion_probabilities(probabilities: DataFrame) -> DataFrame:
    """Probability of reaching Conversion from Start, as is and without each channel.

    All removals advance together.  Mass that enters Null or the removed channel is lost,
    mass in Conversion stays there, so five steps leave the bounded total.
    """
    matrix = materialise(probabilities.select("from_state", "to_state", "p"), "matrix")
    stays = matrix.where(F.col("to_state") == CONVERSION).select(
        F.lit(CONVERSION).alias("from_state"), "to_state", F.lit(1.0).alias("p")
    )
    steps = matrix.unionByName(stays.distinct())
    state = F.col("from_state")
    removed = F.when(state.startswith(PREFIX), state).when(state == START, NOTHING_REMOVED)
    scenarios = matrix.select(removed.alias("removed")).where("removed is not null").distinct()
    # One entry per channel, so this list is as long as the matrix is wide.
    listed = scenarios.agg(F.array_agg("removed")).scalar()
    mass = matrix.where(state == START).select(
        F.explode(listed).alias("removed"), F.col("to_state").alias("state"), F.col("p").alias("mass")
    )
    for _ in range(HORIZON - 1):
        alive = mass.where(F.col("state") != F.col("removed"))
        mass = (
            alive.join(steps, F.col("state") == F.col("from_state"))
            .groupBy("removed", F.col("to_state").alias("state"))
            .agg(F.sum(F.col("mass") * F.col("p")).alias("mass"))
        )
    converted = mass.where(F.col("state") == CONVERSION).select("removed", "mass")
    return scenarios.join(converted, "removed", "left").select(
        "removed", F.coalesce("mass", F.lit(0.0)).alias("conversion_probability")
    )


def removal_effects(reached: DataFrame) -> DataFrame:
    """Relative loss of conversion probability per removed channel (one row per channel)."""
    everything = Window.partitionBy(F.lit(1))
    base = F.max(
        F.when(F.col("removed") == NOTHING_REMOVED, F.col("conversion_probability"))
    ).over(everything)
    lost = (F.col("_base") - F.col("conversion_probability")) / F.col("_base")
    effect = F.when(F.col("_base") > 0, F.greatest(F.lit(0.0), lost)).otherwise(0.0)
    return (
        reached.withColumn("_base", base)
        .where(F.col("removed") != NOTHING_REMOVED)
        .select(
            F.substr("removed", F.lit(len(PREFIX) + 1)).alias("channel"),
            effect.alias("removal_effect"),
        )
    )


def channel_shares(effects: DataFrame) -> DataFrame:
    """Removal effects scaled to add up to 1; equal shares when nothing has an effect."""
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("removal_effect").over(everything)
    share = F.when(total > 0, F.col("removal_effect") / total).otherwise(
        1.0 / F.count("*").over(everything)
    )
    return (
        effects.withColumn("_share", share)
        .select(
            "channel",
            round_half_up("_share", 4).alias("markov_weight"),
            round_half_up(F.col("_share") * 100, 2).alias("markov_share_pct"),
        )
        .orderBy(F.desc("markov_weight"), "channel")
    )


def markov(touches: DataFrame) -> DataFrame:
    """Removal-effect attribution by channel."""
    probabilities = transition_probabilities(transition_counts(touches))
    return channel_shares(removal_effects(conversion_probabilities(probabilities)))
