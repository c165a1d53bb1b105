"""Identity resolution batch by batch: new links are merged into stored clusters.

Three tables hold what earlier batches found, and only ever grow: the root of every entity and of every
identifier as it was when they came, and for every root that has been absorbed since, the root that took
its place.  A root is the smallest entity of its cluster, so of several entries for one absorbed root the
smallest is the newest, and a batch that is merged twice changes nothing.

A batch looks up the entities and identifiers it names, replaces them by their roots, and finds
components of this contracted graph alone.  Clusters that no link of the batch touches are neither
rewritten nor shuffled: the batch's keys are written first, so their size is known, and the stored tables are
filtered by them where they lie as long as Spark finds the keys small enough to send around.

Defined cases: blank identifiers, unsure links and links without an entity or a type tie nothing, as in
``identity``; an entity or identifier that is known already is not added again; an empty batch changes
nothing; empty stored tables make the first batch a full resolution.  Links are only added: a raised
threshold or a withdrawn link needs a full resolution.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.operators.components import components
from clientele.operators.identity import DEFAULT_THRESHOLD, link_edges, unified_id
from clientele.operators.ranking import global_rank
from clientele.operators.rfm import CUSTOMER
from clientele.sources.schemas import TABLES, struct
from clientele.sources.scratch import materialise


class Clusters(NamedTuple):
    """Stored clusters, or what a batch adds to them.

    ``entities`` (entity_id, root_id), ``identifiers`` (node, identifier_type, identifier_value, root_id) and
    ``absorbed`` (absorbed_root, root_id).
    """

    entities: DataFrame
    identifiers: DataFrame
    absorbed: DataFrame

    def plus(self, added: "Clusters") -> "Clusters":
        return Clusters(*(old.unionByName(new) for old, new in zip(self, added, strict=True)))


#: The stored tables in the order of ``Clusters``.
CLUSTER_TABLES = ("entity_root", "identifier_root", "absorbed_root")


def no_clusters(spark: SparkSession) -> Clusters:
    return Clusters(*(spark.createDataFrame([], struct(TABLES[name])) for name in CLUSTER_TABLES))


def _replaced(absorbed: DataFrame) -> DataFrame:
    """The current root of every absorbed one."""
    return absorbed.groupBy("absorbed_root").agg(F.min("root_id").alias("_now"))


def with_current_root(rows: DataFrame, absorbed: DataFrame, column: str = "root_id") -> DataFrame:
    """Rows whose root, if it has been absorbed, is replaced by the current one."""
    now = _replaced(absorbed).withColumnRenamed("absorbed_root", column)
    return rows.join(now, column, "left").withColumn(column, F.coalesce("_now", column)).drop("_now").select(*rows.columns)


def stored_rows(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a stored table that the keys name; ``keys`` is a written table."""
    return table.join(keys, key, "left_semi")


def _known(table: DataFrame, keys: DataFrame, key: str, absorbed: DataFrame) -> DataFrame:
    """Stored rows that a batch names, with their current root."""
    found = materialise(stored_rows(table, keys, key), "known")
    roots = materialise(found.select(F.col("root_id").alias("absorbed_root")).distinct(), "roots")
    return materialise(with_current_root(found, stored_rows(absorbed, roots, "absorbed_root")), "known")


def merge_links(
    stored: Clusters, links: DataFrame, threshold: float = DEFAULT_THRESHOLD, entities: DataFrame | None = None
) -> Clusters:
    """What a batch of links, and of entities that may have none, adds to the stored clusters."""
    edges = materialise(link_edges(links, threshold), "edges")
    named = edges.select("entity_id")
    if entities is not None:
        named = named.unionByName(entities.select("entity_id")).where(F.col("entity_id").isNotNull())
    named = materialise(named.distinct(), "named")
    nodes = materialise(edges.select("node", "identifier_type", "identifier_value").distinct(), "nodes")
    old_entities = _known(stored.entities, named, "entity_id", stored.absorbed)
    old_nodes = _known(stored.identifiers, nodes.select("node"), "node", stored.absorbed)

    placed = materialise(
        named.join(old_entities, "entity_id", "left").select(
            "entity_id", F.coalesce("root_id", "entity_id").alias("root"), F.col("root_id").isNull().alias("new")
        ),
        "placed",
    )
    # The contracted graph: identifiers tie the roots of their entities, and the root they had.
    ends = edges.select("node", "entity_id").join(placed, "entity_id").select("node", "root")
    ends = materialise(ends.unionByName(old_nodes.select("node", F.col("root_id").alias("root"))).distinct(), "ends")
    smallest = materialise(ends.groupBy("node").agg(F.min("root").alias("low")), "minima")
    ties = ends.join(smallest, "node").where(F.col("root") > F.col("low")).select(F.col("root").alias("high"), "low").distinct()
    tied = components(ties)

    roots = tied.select(F.col("high").alias("root"), F.col("low").alias("_low"))
    joined = F.coalesce("_low", "root").alias("root_id")
    new_entities = placed.where("new").join(roots, "root", "left").select("entity_id", joined)
    new_nodes = (
        nodes.join(old_nodes.select("node"), "node", "left_anti")
        .join(smallest.withColumnRenamed("low", "root"), "node")
        .join(roots, "root", "left")
        .select("node", "identifier_type", "identifier_value", joined)
    )
    # Roots of new entities were stored nowhere, so only those of known ones are absorbed.
    had = old_entities.select("root_id").unionByName(old_nodes.select("root_id")).distinct()
    gone = materialise(
        roots.join(had, F.col("root") == F.col("root_id"), "left_semi").select(
            F.col("root").alias("absorbed_root"), F.col("_low").alias("root_id")
        ),
        "absorbed",
    )
    # What such a root had absorbed before now follows the new one.
    followers = stored.absorbed.join(
        gone.select(F.col("absorbed_root").alias("root_id"), F.col("root_id").alias("_now")), "root_id"
    ).select("absorbed_root", F.col("_now").alias("root_id"))
    return Clusters(
        materialise(new_entities, "entities"),
        materialise(new_nodes, "identifiers"),
        materialise(gone.unionByName(followers.distinct()), "absorbed"),
    )


def entity_roots(stored: Clusters) -> DataFrame:
    """``(entity_id, root_id)`` of all entities: the root is the cluster key."""
    return with_current_root(stored.entities, stored.absorbed)


def resolved(stored: Clusters) -> DataFrame:
    """The map that a full resolution of all links gives: a row per entity and identifier."""
    entities = materialise(entity_roots(stored), "entities")
    clusters = global_rank(entities.select("root_id").distinct(), ["root_id"], "_cluster").select(
        "root_id", unified_id(F.col("_cluster")).alias(CUSTOMER)
    )
    identifiers = with_current_root(stored.identifiers, stored.absorbed)
    rows = entities.select(
        F.col("entity_id").alias("raw_entity_id"), F.lit("entity").alias("node_type"), F.lit("entity_id").alias("identifier_type"),
        F.col("entity_id").alias("identifier_value"), "root_id",
    ).unionByName(
        identifiers.select(
            F.lit(None).cast("string").alias("raw_entity_id"), F.lit("identifier").alias("node_type"), "identifier_type",
            "identifier_value", "root_id",
        )
    )
    return rows.join(clusters, "root_id").select(
        CUSTOMER, "raw_entity_id", "node_type", "identifier_type", "identifier_value", F.col("root_id").alias("cluster_key")
    )
