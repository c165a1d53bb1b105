"""Nearest neighbours by largest inner product with cross-polytope hashing.

Candidates are split into bands of nearly equal length, in which order by inner product is nearly
order by angle, and every band is searched by hashing its vectors scaled to unit length.  In every table
three rounds of random signs and a fast Hadamard transform turn the sphere; a vector belongs to the
bucket of its nearest signed axis (or of several such axes, one per hash).  A query probes the buckets of
its best axes.  Candidates of a bucket are ranked by the exact inner product of the original vectors
inside the task, cell by cell, so only the best of each cell travel on.  A query that finds fewer
than it asks for is searched again against all rows, in blocks.

Axes, hashes, tables and probes of a band follow from its number of rows by one rule (``plan``): the share of the
buckets that a query probes falls with the cube root of the rows, as neighbours come nearer the more rows there
are, and small bands have fewer axes, so that buckets hold rows at all.  Nothing is fitted.

Defined cases: null ids, vectors that are null, empty, zero or hold null or non-finite components
take no part; queries meet candidates of their own length only.  Rows with the same id and vector
count once, and every row with the query's id is the query's own.  Of equal vectors only the smallest
ids can be among the nearest, so only those are searched.  Empty tables give an empty result; extra
columns are ignored.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.cells import CHUNK, chunk_counts, chunk_of, matrix, runs, sorted_cells, usable
from clientele.sources.scratch import materialise

SEED = 11

#: Lengths of a band differ by less than this factor.
BAND = 1.25
#: Expected rows of a bucket below which a table has fewer axes.
BUCKET_ROWS = 8
#: Share of the buckets that a query probes in each of 16 tables at so many rows.
SHARE, SHARE_ROWS = 1 / 32, 16_000
#: From so many rows on, two hashes name a bucket: that share of the buckets is probed in each of 24 tables.
TWO_HASHES, TWO_SHARE = 1_000_000, 1 / 128

_SPAN = 64  # tables of a band are numbered within so many


class Plan(NamedTuple):
    axes: int
    hashes: int
    tables: int
    probes: int


def plan(rows: int, width: int) -> Plan:
    """How a band of so many rows is hashed; vectors have ``width`` coordinates after the rotation."""
    axes = min(width, 1 << max(0, (rows // (2 * BUCKET_ROWS)).bit_length() - 1))
    if rows < TWO_HASHES:
        share = min(1.0, SHARE * (SHARE_ROWS / max(rows, 1)) ** (1 / 3))
        return Plan(axes, 1, 16, max(min(2, axes), int(np.ceil(2 * axes * share))))
    share = TWO_SHARE * (TWO_HASHES / rows) ** (1 / 3)
    return Plan(axes, 2, 24, max(8, int(np.ceil(4 * axes * axes * share))))


_BUCKET = ["size", "table", "bucket"]
_CELL = [*_BUCKET, "chunk", "query_chunk"]


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, width, half = *rows.shape, 1
    while half < width:
        pairs = rows.reshape(n, -1, 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return rows / np.sqrt(width)


def width_of(size: int) -> int:
    """Coordinates of a vector of this size after the rotation."""
    return 1 << max(1, (size - 1).bit_length())


class CrossPolytope:
    """Scores of signed axes for vectors of one size."""

    def __init__(self, size: int) -> None:
        self.width = width_of(size)
        self._size = size
        self._signs: dict[tuple[int, int], np.ndarray] = {}

    def axes(self, unit: np.ndarray, table: int, one: int, axes: int) -> np.ndarray:
        """Coordinates after the pseudo-rotation, for the first axes and then their opposites."""
        if (table, one) not in self._signs:
            random = np.random.default_rng([SEED, self._size, table, one])
            self._signs[table, one] = random.choice([-1.0, 1.0], (3, self.width))
        turned = np.zeros((len(unit), self.width))
        turned[:, : unit.shape[1]] = unit
        for signs in self._signs[table, one]:
            turned = hadamard(turned * signs)
        return np.concatenate([turned[:, :axes], -turned[:, :axes]], axis=1)

    def buckets(self, unit: np.ndarray, table: int, how: Plan) -> np.ndarray:
        """The best buckets of each vector, best first; several hashes add their scores."""
        scores = self.axes(unit, table, 0, how.axes)
        every = np.broadcast_to(np.arange(2 * how.axes), scores.shape)
        names = every
        for one in range(1, how.hashes):
            # Only combinations of each side's best can be among the best sums.
            names, scores = _best(names, scores, how.probes)
            more, more_scores = _best(every, self.axes(unit, table, one, how.axes), how.probes)
            names = (names[:, :, None] * 2 * how.axes + more[:, None, :]).reshape(len(unit), -1)
            scores = (scores[:, :, None] + more_scores[:, None, :]).reshape(len(unit), -1)
        return _best(names, scores, how.probes)[0]


def _best(names: np.ndarray, scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-scores, axis=1, kind="stable")[:, :count]
    return np.take_along_axis(names, order, 1), np.take_along_axis(scores, order, 1)


def _hash(bands: dict[int, dict[int, tuple[int, Plan]]]):
    """Rows ``(size, table, bucket, query, vec_id, vector)`` for candidates (one bucket) or queries (probes in all bands).

    ``bands`` holds, by vector size and band, the band's number and plan; each band has tables of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, CrossPolytope] = {}
        for batch in batches:
            ids, flags = batch.column("vec_id").to_numpy(), batch.column("query").to_numpy()
            vectors, own = batch.column("vector").to_pylist(), batch.column("band").to_numpy(zero_copy_only=False)
            sizes = np.array([len(v) for v in vectors])

            def made(size, query, rows, blobs, table, bucket):
                n = len(rows)
                return pa.record_batch(
                    [pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, table, np.int32)),
                     pa.array(bucket.astype(np.int64)), pa.array(np.full(n, query, np.int32)), pa.array(ids[rows]), blobs],
                    names=[*_BUCKET, "query", "vec_id", "vector"],
                )

            for size in np.unique(sizes).tolist():
                hasher = hashers.setdefault(size, CrossPolytope(size))
                asked = np.flatnonzero((sizes == size) & (flags == 1))
                mine = [(1, asked, list(bands[size].values()))]
                for band, place in bands[size].items():
                    mine.append((0, np.flatnonzero((sizes == size) & (flags == 0) & (own == band)), [place]))
                for query, rows, places in mine:
                    if not len(rows):
                        continue
                    given = np.array([vectors[r] for r in rows], "<f8")
                    blobs = pa.array([v.tobytes() for v in given], pa.binary())
                    unit = given / np.linalg.norm(given, axis=1, keepdims=True)
                    for how in sorted({of for _, of in places}):
                        numbers = [number for number, of in places if of == how]
                        asking = how if query else how._replace(probes=1)
                        for table in range(how.tables):
                            for column in hasher.buckets(unit, table, asking).T:
                                for number in numbers:
                                    yield made(size, query, rows, blobs, number * _SPAN + table, column)

    return run


def _rank_cells(cells: DataFrame, count: int) -> DataFrame:
    """The best ``count`` candidates of each query in each cell: ``(query_id, vec_id, score)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, _CELL):
            query, ids = cell.column("query").to_numpy() == 1, cell.column("vec_id").to_numpy()
            if query.all() or not query.any():
                continue
            vectors = matrix(cell.column("vector"))
            asked, others = np.flatnonzero(query), np.flatnonzero(~query)
            for at in range(0, len(asked), 256):
                yield _rank(vectors, ids, asked[at : at + 256], others, count)

    return sorted_cells(cells, _CELL).mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def _rank(vectors: np.ndarray, ids: np.ndarray, asked: np.ndarray, others: np.ndarray, count: int) -> pa.RecordBatch:
    rough = vectors[asked] @ vectors[others].T
    rough[ids[asked][:, None] == ids[others][None, :]] = -np.inf
    if len(others) > count:
        edge = np.partition(rough, -count, axis=1)[:, -count]
    else:
        edge = rough.min(axis=1, where=np.isfinite(rough), initial=np.inf)
    # Rounding differs with the place in a matrix product: the exact sum decides near the edge.
    slack = np.where(np.isfinite(edge), 1e-9 * (1 + np.abs(edge)), 0.0)
    row, column = np.nonzero(np.isfinite(rough) & (rough >= (edge - slack)[:, None]))
    score = (vectors[asked[row]] * vectors[others[column]]).sum(axis=1)
    found = ids[others[column]]
    order = np.lexsort((found, -score, row))
    row, score, found = row[order], score[order], found[order]
    starts = np.searchsorted(row, row)
    kept = np.arange(len(row)) - starts < count
    return pa.record_batch(
        [pa.array(ids[asked[row[kept]]]), pa.array(found[kept]), pa.array(score[kept])], names=["query_id", "vec_id", "score"]
    )


def _in_cells(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Candidates of a hot bucket are dealt to chunks; queries go to all chunks of theirs, block by block."""
    chunks, query_chunks = F.coalesce("_chunks", F.lit(1)), F.coalesce("_query_chunks", F.lit(1))
    queries = hot.withColumnsRenamed({"_chunks": "_query_chunks"}).withColumnRenamed("query", "_of")
    both = rows.join(hot.where("query = 0").drop("query"), _BUCKET, "left").join(
        queries.where("_of = 1").drop("_of"), _BUCKET, "left"
    )
    mine = F.col("query") == 1
    return (
        both.withColumn("chunk", F.explode(F.when(mine, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(chunk_of(F.col("vec_id"), chunks)))))
        .withColumn("query_chunk", F.explode(F.when(mine, F.array(chunk_of(F.col("vec_id"), query_chunks))).otherwise(F.sequence(F.lit(0), query_chunks - 1))))
        .select(*_CELL, "query", "vec_id", "vector")
    )


def _best_per_query(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def nearest(
    embeddings: DataFrame, queries: DataFrame, count: int = 20, tables: int | None = None, hashes: int | None = None,
    probes: int | None = None,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest rows found for every query of ``(vec_id, embedding)``.

    What is given of tables (at most 64), hashes and probes takes the place of the planned number in every band.
    """

    def clean(frame: DataFrame) -> DataFrame:
        given = frame.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("vector"))
        return given.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).distinct()

    smallest = Window.partitionBy("vector").orderBy("vec_id")
    candidates = clean(embeddings).withColumn("_place", F.row_number().over(smallest)).where(
        F.col("_place") <= count + 1
    ).drop("_place")
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    # Rounded, so that unit vectors do not stand at an edge; squares too small for a number are a band of their own.
    band = F.coalesce(F.round(F.log(squares) / (2 * float(np.log(BAND)))).cast("int"), F.lit(-(1 << 20)))
    rows = materialise(
        candidates.withColumns({"query": F.lit(0), "band": band}).unionByName(
            clean(queries).withColumns({"query": F.lit(1), "band": F.lit(0)})
        ),
        "vectors",
    )
    counted = rows.where("query = 0").groupBy(F.size("vector").alias("size"), "band").agg(F.count("*").alias("rows"))
    wished = {n: v for n, v in (("tables", tables), ("hashes", hashes), ("probes", probes)) if v is not None}
    bands: dict[int, dict[int, tuple[int, Plan]]] = {}
    for r in counted.orderBy("size", "band").collect():  # one row per vector length and band
        of = bands.setdefault(r["size"], {})
        of[r["band"]] = (len(of), plan(r["rows"], width_of(r["size"]))._replace(**wished))
    known = rows.where(F.size("vector").isin([int(size) for size in bands]))

    schema = "size int, table int, bucket bigint, query int, vec_id bigint, vector binary"
    hashed = known.mapInArrow(_hash(bands), schema)
    hot = chunk_counts(hashed.drop("vector"), [*_BUCKET, "query"], CHUNK)
    found = materialise(_best_per_query(_rank_cells(_in_cells(hashed, hot), count), count), "nearest")

    # Too few found, though there are more: those queries meet all rows of their length, in blocks.
    reached = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("_found"))
    asked = known.where("query = 1").join(reached, "vec_id", "left")
    poor = materialise(asked.where(F.coalesce("_found", F.lit(0)) < count).select("vec_id", "vector", "query"), "poor")
    if not poor.isEmpty():
        # One bucket per vector length: the cells deal it to blocks.
        again = known.where("query = 0").select("vec_id", "vector", "query").unionByName(poor)
        flat = again.mapInArrow(_whole, schema)
        hot = chunk_counts(flat.drop("vector"), [*_BUCKET, "query"], CHUNK)
        more = _rank_cells(_in_cells(flat, hot), count)
        found = _best_per_query(found.select("query_id", "vec_id", "score").unionByName(more), count)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of one length in one bucket."""
    for batch in batches:
        vectors = [np.array(v, "<f8") for v in batch.column("vector").to_pylist()]
        n = batch.num_rows
        yield pa.record_batch(
            [pa.array([len(v) for v in vectors], pa.int32()), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64)),
             batch.column("query"), batch.column("vec_id"), pa.array([v.tobytes() for v in vectors], pa.binary())],
            names=[*_BUCKET, "query", "vec_id", "vector"],
        )
