"""Small expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# The date by which stored facts are laid out.
DATE = "date_part"


def dated(df: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Leave out the dates of a stored fact table before and after two moments, so that a scan skips them.

    Frames without the date column pass as they are; the exact bounds stay with the caller.
    """
    if DATE in df.columns:
        if low is not None:
            df = df.where(F.col(DATE) >= F.to_date(low))
        if high is not None:
            df = df.where(F.col(DATE) <= F.to_date(high))
    return df


def amount(column: Column) -> Column:
    """The amount as a decimal of six places, far below a cent; null if it is no finite number."""
    return column.cast("double").try_cast("decimal(28,6)")


def exact_sum(column: Column) -> Column:
    """Sum as decimals, so the total does not depend on the row order and nothing is rounded to cents.

    A NaN or an infinity among the amounts makes the sum one, as it does with doubles.
    """
    value = column.cast("double")
    odd = F.sum(F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), value))
    return F.coalesce(odd, F.sum(amount(value)).cast("double"))


def round_half_up(column: Column | str, digits: int) -> Column:
    """Scale, round halves away from zero, scale back: what SQL engines do with doubles.

    Spark's own ``round`` looks at the shortest decimal text of the number instead, and so
    decides some halves differently.
    """
    value = F.col(column) if isinstance(column, str) else column
    scale = F.lit(float(10**digits))
    return F.round(value.cast("double") * scale) / scale


def whole_days(earlier: Column, later: Column) -> Column:
    """Whole elapsed 24-hour days (not calendar days)."""
    return F.timestamp_diff("DAY", earlier, later).cast("int")


def days_before(moment: Column, days: int) -> Column:
    return moment - F.make_dt_interval(F.lit(days))


def days_after(moment: Column, days: int) -> Column:
    return moment + F.make_dt_interval(F.lit(days))


def stripped(column: Column) -> Column:
    """Trim all white space at both ends, not only blanks."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def identifier_key(kind: Column, value: Column) -> Column:
    """``type:value`` with the value trimmed and lower-cased."""
    return F.concat_ws(":", kind, F.lower(stripped(value)))


def phone_digits(column: Column) -> Column:
    """The last ten digits of a phone number."""
    return F.right(F.regexp_replace(column, "[^0-9]", ""), F.lit(10))


def hash_bucket(column: Column, buckets: int = 100) -> Column:
    """A stable 0..buckets-1 bucket from the leading digits of the md5 sum."""
    digits = F.substring(F.md5(column.cast("string")), 1, 7)
    return F.conv(digits, 16, 10).cast("bigint") % buckets
