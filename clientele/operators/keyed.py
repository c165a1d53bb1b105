"""Rows by key: one row per key is kept, the others are told apart with a reason.

The newest row of a key counts, of equally new ones the one with the larger content hash, so
the outcome does not depend on the order in which rows came.  The newest are found by an aggregate that
combines before it shuffles, and rows are told apart by a number of their own, so that one key may hold
most of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.sources.scratch import materialise

MISSING, REPEATED, STALE = "missing_key", "repeated_key", "older_than_stored"
#: Rows of a batch that go into the table, and those that it holds already.
COMING, SAME = "coming", "same"


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def row_order(df: DataFrame, newest: str) -> Column:
    """How rows of one key compare: by time, unknown times first, then by content."""
    return F.struct(F.col(newest).isNotNull().alias("a"), F.col(newest).alias("b"), F.xxhash64(*df.columns).alias("c"))


def content(df: DataFrame) -> Column:
    """A hash of a row that tells nulls in different columns apart, too."""
    return F.xxhash64(*df.columns, *[F.col(name).isNull() for name in df.columns])


def newest_numbers(numbered: DataFrame, key: str, newest: str, columns: Sequence[str], number: str) -> DataFrame:
    """Of each key the newest row's number, ``_order`` and ``_content``; rows without a key have none."""
    row = numbered.select(*columns)
    order = F.struct(row_order(row, newest).alias("order"), F.col(number).alias("number"), content(row).alias("content"))
    first = numbered.where(has_key([key])).groupBy(key).agg(F.max(order).alias("_first"))
    return first.select(
        key, F.col("_first.number").alias(number), F.col("_first.order").alias("_order"), F.col("_first.content").alias("_content")
    )


def has_key(key: Sequence[str]) -> Column:
    every = F.lit(True)
    for name in key:
        every = every & F.col(name).isNotNull()
    return every


def split_by_key(rows: DataFrame, key: Sequence[str], newest: str) -> tuple[DataFrame, DataFrame]:
    """The newest row of each key, and all other rows with a ``reason``.

    A row with a null in its key is ``missing_key``; older and repeated ones are ``repeated_key``.
    """
    number = free_name(rows, "_number")
    numbered = materialise(rows.withColumn(number, F.monotonically_increasing_id()), "numbered")
    order = F.struct(row_order(rows, newest).alias("order"), F.col(number).alias("number"))
    first = numbered.where(has_key(key)).groupBy(*key).agg(F.max(order).alias("_first"))
    first = materialise(first.select(F.col("_first.number").alias(number)), "first")
    kept = numbered.join(first, number, "left_semi").select(*rows.columns)
    reason = F.when(has_key(key), REPEATED).otherwise(MISSING)
    others = numbered.join(first, number, "left_anti").select(*rows.columns, reason.alias("reason"))
    return kept, others
