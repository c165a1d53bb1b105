"""Distinct sessions over sliding windows from daily sketches.

An exact distinct count has to look at all sessions of a window again each day.  Here every customer and day
has a HyperLogLog sketch of its sessions; sketches of days, and of batches of one day, are merged for any
window, so a day is read once.  The exact count stays the default of the lead features; this is
for windows over long histories.

Small counts are exact; beyond, estimates of a sketch with 2^k registers have a relative standard error of
``1.04 / sqrt(2^k)``.  Defined cases: rows without a customer, a time or a session count nowhere; an empty table
gives an empty result; a customer without events in a window has 0 there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.operators.rfm import CUSTOMER

#: log2 of the registers of a sketch: a relative standard error of 1.6 %.
REGISTERS = 12


def standard_error(registers: int = REGISTERS) -> float:
    return 1.04 / math.sqrt(1 << registers)


def daily_sketches(events: DataFrame, registers: int = REGISTERS) -> DataFrame:
    """``(customer, day, sketch)`` of the sessions of each customer and day."""
    known = events.where(F.col(CUSTOMER).isNotNull() & F.col("event_timestamp").isNotNull() & F.col("session_id").isNotNull())
    return known.groupBy(CUSTOMER, F.to_date("event_timestamp").alias("day")).agg(
        F.hll_sketch_agg("session_id", registers).alias("sketch")
    )


def merged_days(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Stored sketches with those of a later batch, which may hold days that are stored already."""
    both = stored.unionByName(added)
    return both.groupBy(CUSTOMER, "day").agg(F.hll_union_agg("sketch").alias("sketch"))


def window_sessions(sketches: DataFrame, as_of: date | Column, days: Sequence[int] = (7, 30)) -> DataFrame:
    """``(customer, sessions_7d, sessions_30d, ...)``: estimates for the last so many days up to a date, that included.

    Customers without an event in the longest window are left out.
    """
    last = F.lit(as_of) if isinstance(as_of, date) else as_of
    recent = sketches.where((F.col("day") <= last) & (F.col("day") > F.date_sub(last, max(days))))
    estimates = [
        F.coalesce(
            F.hll_sketch_estimate(F.hll_union_agg(F.when(F.col("day") > F.date_sub(last, n), F.col("sketch")))), F.lit(0).cast("bigint")
        ).alias(f"sessions_{n}d")
        for n in days
    ]
    return recent.groupBy(CUSTOMER).agg(*estimates)
