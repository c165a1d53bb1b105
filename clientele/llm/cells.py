"""Meeting the rows of a bucket block by block.

Rows that share a bucket meet in cells of bounded size: a bucket with many rows is dealt to chunks by a
hash of the row, and every pair of chunks becomes a cell of its own, so that a hot bucket is spread over
many tasks and none holds more than two chunks.  Cells are runs of sorted rows, streamed to
Python in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.operators.ranking import range_partitions
from clientele.sources.scratch import materialise

#: Expected rows of a chunk.
CHUNK = 2_048


def chunk_counts(rows: DataFrame, key: Sequence[str], size: int = CHUNK) -> DataFrame:
    """Keys with more than ``size`` rows and the number of their chunks; all others have one."""
    counted = rows.groupBy(*key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > size)
    return materialise(counted.select(*key, F.ceil(F.col("_rows") / size).cast("int").alias("_chunks")), "hot")


def chunk_of(row: Column, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(row), chunks).cast("int")


def sorted_cells(rows: DataFrame, key: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """Bring the rows of each cell together, one after another."""
    parts = range_partitions(rows.sparkSession)
    return rows.repartition(parts, *key).sortWithinPartitions(*key, *then)


def runs(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each cell of at least two rows, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(name).to_numpy(zero_copy_only=False) for name in key]
        changes = np.zeros(batch.num_rows - 1, bool)
        for column in columns:
            changes |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for first, end in zip(cuts, cuts[1:], strict=False):
            name = tuple(column[first] for column in columns)
            if held and name != last:
                if sum(h.num_rows for h in held) > 1:
                    yield pa.Table.from_batches(held)
                held = []
            last = name
            held.append(batch.slice(first, end - first))
    if held and sum(h.num_rows for h in held) > 1:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors written as little-endian doubles, one per row."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """True for a vector that is not null, empty or zero and holds finite numbers only."""
    odd = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return F.coalesce(~odd & F.exists(vector, lambda x: x != 0.0), F.lit(False))
