"""Feeds as streams of files, brought into the warehouse by key.

Files are read as they come, rows delivered twice within the delay are dropped by state, and every micro-batch is
brought into the table by ``Warehouse.upsert``, which takes the newest row of a key and may see a batch twice.
So the table ends as a batch load of the same files would leave it, whatever the order of the files
and however often the stream was restarted from its checkpoint.

The watermark is on the time of arrival, not on that of the event: no row is ever late, and none is dropped for it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clientele.sources.schemas import FEEDS, struct
from clientele.sources.warehouse import FACTS, Warehouse, consent_rows, fact_rows

#: How long a repeated delivery is recognised by state; one that comes later is recognised by its key.
DELAY = "6 hours"

_ARRIVED = "_arrived"


def arriving(spark: SparkSession, folder: str, feed: str, delay: str = DELAY, files_per_batch: int | None = None) -> DataFrame:
    """The rows of a feed's files as they come, without repeated deliveries."""
    reader = spark.readStream.schema(struct(FEEDS[feed]))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(folder)
    seen = rows.withColumn(_ARRIVED, F.current_timestamp()).withWatermark(_ARRIVED, delay)
    return seen.dropDuplicatesWithinWatermark(rows.columns).drop(_ARRIVED)


def _rows_of(table: str) -> tuple[str, Callable[[DataFrame, DataFrame], DataFrame]]:
    """The feed of a table, and its rows from the feed and the entities' unified ids."""
    if table == "consent_preference":
        return "consents", consent_rows
    return FACTS[table], lambda rows, mapping: fact_rows(rows, mapping, table)


def start(
    warehouse: Warehouse, table: str, folder: str, mapping: DataFrame, checkpoint: str, delay: str = DELAY,
    files_per_batch: int | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Start bringing a feed's files into a fact or consent table.

    ``mapping`` gives the unified id of each entity.  With ``available_now`` the stream ends once the files that
    are there have been read; ``checkpoint`` is where the next start goes on.
    """
    feed, rows_of = _rows_of(table)

    def bring(batch: DataFrame, _: int) -> None:
        warehouse.upsert(table, rows_of(batch, mapping), datetime.now(timezone.utc))

    writer = arriving(warehouse.spark, folder, feed, delay, files_per_batch).writeStream
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).foreachBatch(bring).start()


def run_available(warehouse: Warehouse, table: str, folder: str, mapping: DataFrame, checkpoint: str, **more) -> None:
    """Bring all files that are there into the table."""
    query = start(warehouse, table, folder, mapping, checkpoint, **more)
    query.awaitTermination()
