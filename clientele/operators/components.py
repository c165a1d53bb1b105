"""Connected components of a graph given as integer edges.

Every round ties a node's larger neighbours to the smallest of the node and its neighbours, then
the node and its smaller neighbours to the smallest of those, until the edges are stars.  The minima are
written before they are joined, so that both inputs of a join are plain shuffles and the adaptive
skew join can split a hub that holds a large share of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from clientele.sources.scratch import discard, materialise


def _smallest(edges: DataFrame) -> DataFrame:
    return materialise(edges.groupBy("high").agg(F.min("low").alias("_least")), "minima")


def _tie_larger(edges: DataFrame) -> tuple[DataFrame, tuple, int]:
    """Tie every larger neighbour of a node to the smallest of the node and its neighbours.

    Also the state of the new edges, and how many nodes have smaller neighbours.
    """
    seen = Observation()
    least = edges.groupBy("high").agg(F.min("low").alias("_least")).observe(seen, F.count(F.lit(1)).alias("nodes"))
    smallest = materialise(least, "minima")
    # A node without smaller neighbours is itself the smallest, and its edges stay.
    centre = edges.join(smallest.withColumnRenamed("high", "low"), "low", "left").select(
        "high", F.coalesce("_least", "low").alias("low")
    )
    tied, state = _written(centre.distinct())
    discard(smallest)
    return tied, state, seen.get["nodes"]


def _tie_smaller(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Tie a node and its smaller neighbours to the smallest of those; also the state of the new edges."""
    smallest = _smallest(edges)
    siblings = edges.join(smallest, "high").select(F.col("low").alias("high"), F.col("_least").alias("low"))
    parents = smallest.select("high", F.col("_least").alias("low"))
    tied, state = _written(parents.unionByName(siblings.where(F.col("high") != F.col("low"))).distinct())
    discard(smallest)
    return tied, state


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their state, taken in the same pass: their number and a digest free of order.

    Equal states mean that a step changed nothing.
    """
    seen = Observation()
    table = materialise(
        edges.observe(seen, F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("high", "low")).alias("digest")), "edges"
    )
    return table, (seen.get["rows"], seen.get["digest"])


def components(edges: DataFrame) -> DataFrame:
    """Smallest member of each node's component, for distinct integer edges ``high > low``.

    Returns ``(high, low)``: one row per node that is not itself the smallest.
    """
    current, state = _written(edges)
    while state[0]:
        larger, after, nodes = _tie_larger(current)
        if after == state and nodes == state[0]:  # every node has one smaller neighbour, and that one has none
            discard(larger)
            break
        discard(current)
        current, state = _tie_smaller(larger)
        discard(larger)
    return current
