"""Near-duplicate embeddings of one label by Euclidean p-stable hashing.

Vectors are scaled to length one and projected on Gaussian directions, shifted and quantised; several
such numbers make the bucket of one table, and several tables make it almost certain that a close pair
shares a bucket.  Inside a bucket all pairs are compared by exact cosine, block by block.  A pair that
several tables find counts in the first of them.  Only link counts per vector and links that tie
components leave a task, never all pairs.

Equal vectors of one label are one class with a weight, so copies never meet.  The number of
projections per table follows from the number of vectors, the number of tables from the wanted recall.

Defined cases: labels that are null, vectors that are null, empty, zero or hold null or non-finite
components, and vectors of different length link with nothing; such rows are their own component.
Repeated rows are vectors of their own.  A null id does not count as a component's smallest id while
there is another.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.cells import chunk_counts, chunk_of, matrix, runs, sorted_cells, usable
from clientele.operators.components import components
from clientele.sources.scratch import discard, materialise

THRESHOLD, WIDTH, RECALL, SEED = 0.93, 1.5, 0.9999, 7

#: Unrelated vectors that one bucket should hold about.
BUCKET = 128

_KEY = ["label", "table", "bucket", "chunk_a", "chunk_b"]


def collision(distance: float, width: float) -> float:
    """Probability that two vectors at this distance share one quantised projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(vectors: int, threshold: float = THRESHOLD, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """Projections per table and tables, for so many vectors of a label."""
    far, near = collision(math.sqrt(2), width), collision(math.sqrt(2 - 2 * threshold), width)
    projections = max(4, math.ceil(math.log(max(1.0, vectors / BUCKET)) / -math.log(far)))
    return projections, math.ceil(math.log(1 - recall) / math.log(1 - near**projections))


class PStable:
    """Bucket numbers of unit vectors in all tables."""

    def __init__(self, dimensions: int, projections: int, tables: int, width: float) -> None:
        random = np.random.default_rng([SEED, dimensions])
        self._directions = random.standard_normal((dimensions, tables * projections))
        self._shift = random.uniform(0, width, tables * projections)
        self._mix = random.integers(1, 1 << 63, projections, np.uint64) | np.uint64(1)
        self._shape, self._width = (tables, projections), width

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        cells = np.floor((unit @ self._directions + self._shift) / self._width).astype(np.int64)
        mixed = cells.reshape(len(unit), *self._shape).view(np.uint64) * self._mix
        folded = np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(29)), axis=2) * self._mix[0]
        return (folded ^ (folded >> np.uint64(32))).view(np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length."""
    blobs = column.to_pylist()
    sizes = np.array([len(b) for b in blobs])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer(b"".join(blobs[r] for r in rows), "<f8").reshape(len(rows), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as little-endian doubles."""
    for batch in batches:
        blobs = [np.array(v, "<f8").tobytes() for v in batch.column("vector").to_pylist()]
        names = [name for name in batch.schema.names if name != "vector"]
        yield pa.record_batch([*(batch.column(n) for n in names), pa.array(blobs, pa.binary())], names=[*names, "vector"])


def link_classes(
    classes: DataFrame, threshold: float = THRESHOLD, width: float = WIDTH, recall: float = RECALL
) -> DataFrame:
    """Links of classes ``(node, label, weight, vector)``, a written table with packed vectors.

    Returns rows ``(node, weight, root)``: weights of the linked classes to add up per node
    (root null), and ties of a node to a smaller one (weight null).
    """
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    projections, tables = plan(largest, threshold, width, recall)

    def keyed(with_vector: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashers: dict[int, PStable] = {}
            for batch in batches:
                for rows, vectors in _by_length(batch.column("vector")):
                    d = vectors.shape[1]
                    hasher = hashers.setdefault(d, PStable(d, projections, tables, width))
                    found = hasher.buckets(_unit(vectors)) ^ d
                    part = batch.take(pa.array(rows))
                    for table in range(tables):
                        columns = [part.column("label"), pa.array(np.full(len(rows), table, np.int32)), pa.array(found[:, table]), part.column("node")]
                        names = ["label", "table", "bucket", "node"]
                        if with_vector:
                            columns += [part.column("weight"), part.column("vector")]
                            names += ["weight", "vector"]
                        yield pa.record_batch(columns, names=names)

        return run

    key = "label int, table int, bucket bigint, node bigint"
    hot = chunk_counts(classes.mapInArrow(keyed(False), key), ["label", "table", "bucket"])
    rows = classes.mapInArrow(keyed(True), f"{key}, weight bigint, vector binary").join(
        hot, ["label", "table", "bucket"], "left"
    )
    chunks = F.coalesce("_chunks", F.lit(1))
    placed = rows.withColumn("chunk", chunk_of(F.col("node"), chunks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0), chunks - 1))
    )
    cells = placed.select(
        "label", "table", "bucket", F.least("chunk", "other").alias("chunk_a"),
        F.greatest("chunk", "other").alias("chunk_b"), "chunk", "node", "weight", "vector",
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, PStable] = {}
        for cell in runs(batches, _KEY):
            table, low, high = (cell.column(n)[0].as_py() for n in ("table", "chunk_a", "chunk_b"))
            node, weight = cell.column("node").to_numpy(), cell.column("weight").to_numpy()
            sizes = {len(b) for b in cell.column("vector").to_pylist()}
            if len(sizes) > 1:
                continue  # the length is part of the bucket; only a hash collision brings two together
            vectors = matrix(cell.column("vector"))
            chunk = cell.column("chunk").to_numpy()
            a = np.flatnonzero(chunk == low)
            b = a if low == high else np.flatnonzero(chunk == high)
            if not len(a) or not len(b):
                continue
            unit = _unit(vectors)
            near = np.argwhere(unit[a] @ unit[b].T >= threshold - 1e-9)
            left, right = a[near[:, 0]], b[near[:, 1]]
            if low == high:
                left, right = left[left < right], right[left < right]
            # The exact cosine decides, and the pair counts in the first table that brings it together.
            lengths = np.linalg.norm(vectors, axis=1)
            kept = np.zeros(len(left), bool)
            hasher = None
            for at in range(0, len(left), 1 << 15):
                part = slice(at, at + (1 << 15))
                x, y = left[part], right[part]
                close = (vectors[x] * vectors[y]).sum(axis=1) / (lengths[x] * lengths[y]) >= threshold
                if table and close.any():
                    if hasher is None:
                        d = vectors.shape[1]
                        hasher = hashers.setdefault(d, PStable(d, projections, tables, width))
                        before = hasher.buckets(unit)[:, :table]
                    close &= ~(before[x] == before[y]).any(axis=1)
                kept[part] = close
            left, right = left[kept], right[kept]
            if not len(left):
                continue
            total = np.zeros(len(node), np.int64)
            np.add.at(total, left, weight[right])
            np.add.at(total, right, weight[left])
            linked = np.flatnonzero(total)
            root = _roots(node, left, right)
            moved = np.flatnonzero(root != node)
            yield pa.record_batch(
                [pa.array(np.r_[node[linked], node[moved]]),
                 pa.array([*total[linked].tolist(), *[None] * len(moved)], pa.int64()),
                 pa.array([*[None] * len(linked), *root[moved].tolist()], pa.int64())],
                names=["node", "weight", "root"],
            )

    return sorted_cells(cells, _KEY).mapInArrow(compare, "node bigint, weight bigint, root bigint")


def _roots(node: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest node each node is tied to by the given pairs of places."""
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(node), np.int64)
    rank[order] = np.arange(len(node))
    root, a, b = np.arange(len(node)), rank[left], rank[right]
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return node[order][root[rank]]
        a, b = a[apart], b[apart]
        root[np.maximum(a, b)] = np.minimum(a, b)
        while not np.array_equal(root[root], root):
            root = root[root]


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, width: float = WIDTH, recall: float = RECALL
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``(vec_id, embedding, label)``."""
    given = embeddings.select(
        F.col("vec_id").cast("bigint"), F.col("label").cast("int"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    whole = F.col("label").isNotNull() & usable(F.col("vector"))
    grouped = given.where(whole).groupBy("label", "vector").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("weight")
    )
    numbered = materialise(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    packed = materialise(
        numbered.select("node", "label", "weight", "vector").mapInArrow(
            _pack, "node bigint, label int, weight bigint, vector binary"
        ),
        "vectors",
    )
    found = materialise(link_classes(packed, threshold, width, recall), "links")
    discard(packed)
    degrees = found.where(F.col("root").isNull()).groupBy("node").agg(F.sum("weight").alias("linked"))
    ties = found.where(F.col("root").isNotNull()).select(F.col("node").alias("high"), F.col("root").alias("low"))
    groups = components(ties.distinct()).select(F.col("high").alias("node"), F.col("low").alias("_root"))
    placed = materialise(
        numbered.join(degrees, "node", "left").join(groups, "node", "left").select(
            "label", "vector", "least", F.coalesce("_root", "node").alias("root"),
            (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        ),
        "placed",
    )
    smallest = materialise(placed.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    named = materialise(placed.join(smallest, "root").drop("root", "least"), "named")
    linked = given.where(whole).join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = given.where(~whole).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
