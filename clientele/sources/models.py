"""Fitted models kept beside the tables, so that customers are scored without fitting again.

A model is a folder of numbered versions, each with the model as Spark ML writes it and one row of details: its
kind, the columns it was fitted on in their order, the metrics of its test part and the time.  The details are
written last, so a version with details is whole; the newest whole version is the model.

Defined cases: a label without signal has no model, and its constant is kept in its place; scoring a table
that lacks a fitted column is an error that names it; a name never saved is an error.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession

DETAILS = "kind string, columns array<string>, metrics string, fitted_at timestamp"

#: What a model of each kind is; a constant has none.
KINDS = {"regression": GBTRegressionModel, "classification": GBTClassificationModel, "constant": None}


class StoredModel(NamedTuple):
    model: GBTRegressionModel | GBTClassificationModel | None
    kind: str
    columns: list[str]
    metrics: dict[str, object]
    version: int


class ModelStore:
    """Models by name below one folder that every executor reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root

    def versions(self, name: str) -> list[int]:
        """The whole versions, oldest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        found = [status.getPath() for status in store.listStatus(path)]
        whole = [f.getName() for f in found if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f, "details/_SUCCESS"))]
        return sorted(int(n.removeprefix("v")) for n in whole if n.startswith("v") and n[1:].isdigit())

    def save(
        self, name: str, model: GBTRegressionModel | GBTClassificationModel | None, columns: Sequence[str],
        metrics: dict[str, object], now: datetime,
    ) -> int:
        """Keep a model, or the metrics of a label without signal, as the next version."""
        versions = self.versions(name)
        number = versions[-1] + 1 if versions else 0
        folder = f"{self.root}/{name}/v{number}"
        kind = next(kind for kind, of in KINDS.items() if (of is None) == (model is None) and (of is None or isinstance(model, of)))
        if model is not None:
            model.write().overwrite().save(f"{folder}/model")  # what a failed save has left is replaced
        row = (kind, list(columns), json.dumps(metrics, sort_keys=True), now)
        self.spark.createDataFrame([row], DETAILS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/details")
        return number

    def load(self, name: str, version: int | None = None) -> StoredModel:
        versions = self.versions(name)
        if version is None and versions:
            version = versions[-1]
        if version not in versions:
            raise LookupError(f"There is no model {name}" + ("." if version is None else f" of version {version}."))
        folder = f"{self.root}/{name}/v{version}"
        row = self.spark.read.schema(DETAILS).parquet(f"{folder}/details").first()
        of = KINDS[row["kind"]]
        return StoredModel(
            None if of is None else of.load(f"{folder}/model"), row["kind"], list(row["columns"]), json.loads(row["metrics"]), version
        )


def has_columns(stored: StoredModel, table: DataFrame) -> None:
    """Raise if the table lacks a column the model was fitted on."""
    missing = [c for c in stored.columns if c not in table.columns]
    if missing:
        raise ValueError(f"The model was fitted on columns that are missing here: {', '.join(missing)}.")
