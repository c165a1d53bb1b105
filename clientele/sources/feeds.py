"""The raw feeds: Parquet folders read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.sources.schemas import FEEDS, struct


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Select the schema's columns by name and cast them; absent columns become null."""
    return df.select(
        *[
            (F.col(field.name) if field.name in df.columns else F.lit(None)).cast(field.dataType).alias(field.name)
            for field in struct(ddl).fields
        ]
    )


def read_feed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One raw feed; times without a zone are taken in the session zone."""
    return conform(spark.read.parquet(f"{root}/{name}"), FEEDS[name])


def read_feeds(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_feed(spark, root, name) for name in FEEDS}
