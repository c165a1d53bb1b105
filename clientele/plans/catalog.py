"""All registered queries and their check SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clientele.plans import (
    checks_attribution,
    checks_audience,
    checks_cltv,
    checks_experiment,
    checks_features,
    checks_identity,
    checks_incremental,
    checks_leads,
    checks_ledger,
    checks_lookalike,
    checks_models,
    checks_rfm,
    checks_sources,
)
from clientele.plans.views import Views, duck

GROUPS = (
    checks_sources,
    checks_identity,
    checks_incremental,
    checks_rfm,
    checks_cltv,
    checks_leads,
    checks_attribution,
    checks_lookalike,
    checks_models,
    checks_audience,
    checks_ledger,
    checks_experiment,
    checks_features,
)


def _on_folder(build: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Views(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _on_folder(build) for group in GROUPS for name, build in group.QUERIES.items()}


def check_sql() -> dict[str, str]:
    parts = {name: text for group in GROUPS for name, text in getattr(group, "PARTS", {}).items()}
    return {name: duck(text, parts) for group in GROUPS for name, text in group.SQL.items()}
