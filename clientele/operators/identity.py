"""Identity resolution: identifier links to unified customers.

Entities that share an identifier belong together.  Each identifier's entities are first
tied to the smallest of them, which leaves a graph of entities only, whose components are
then found.  The smallest entity of each identifier is written before it is joined back,
so that an identifier with a large share of all links is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.functions.columns import phone_digits, stripped
from clientele.functions.privacy import mask_identifier, mask_profile
from clientele.operators.components import components
from clientele.operators.ranking import global_rank
from clientele.operators.rfm import CUSTOMER
from clientele.sources.scratch import materialise

DEFAULT_THRESHOLD = 0.70


def normalised(links: DataFrame, phones: bool = False) -> DataFrame:
    """Add the trimmed, lower-cased value and the node key; blank identifiers are no identifiers.

    ``phones`` reduces phone numbers to their last ten digits, so that spellings of one number tie.
    """
    cleaned = F.lower(stripped(F.col("identifier_value")))
    if phones:
        cleaned = F.when(F.col("identifier_type") == "phone", phone_digits(cleaned)).otherwise(cleaned)
    return (
        links.withColumn("identifier_value", cleaned)
        .where(F.col("identifier_value") != "")
        .withColumn("node", F.concat_ws(":", "identifier_type", "identifier_value"))  # cleaned once, above
    )


def confident(links: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Links at or above the threshold; without a confidence column every link counts."""
    if "confidence_score" not in links.columns:
        return links
    score = F.col("confidence_score")
    return links.where(~F.isnan(score) & (score >= threshold))


def link_edges(
    links: DataFrame, threshold: float = DEFAULT_THRESHOLD, phones: bool = False
) -> DataFrame:
    """Distinct identifier-entity edges with the identifier's type and value; links without a type are none."""
    return (
        normalised(confident(links, threshold), phones)
        .where(F.col("canonical_entity_id").isNotNull() & F.col("identifier_type").isNotNull())
        .select(
            "node", F.col("canonical_entity_id").alias("entity_id"), "identifier_type", "identifier_value"
        )
        .distinct()
    )


def entity_clusters(edges: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """``(entity_id, root_id, cluster)``: the smallest member and the running cluster number.

    ``entities`` adds entities that no link reached; each becomes a cluster of its own.
    """
    known = edges.select("entity_id")
    if entities is not None:
        known = known.unionByName(entities.select("entity_id"))
    known = known.where(F.col("entity_id").isNotNull()).distinct()
    numbered = global_rank(known, ["entity_id"], "idx")
    # Most identifiers have one entity and tie nobody, so only the others meet the running numbers.
    ends = edges.groupBy("node").agg(F.min("entity_id").alias("low"), F.max("entity_id").alias("_high"))
    smallest = materialise(ends.where(F.col("low") < F.col("_high")).select("node", "low"), "minima")
    named = edges.join(smallest, "node").where(F.col("entity_id") > F.col("low")).select("entity_id", "low").distinct()
    ties = (
        materialise(named, "ties")
        .join(numbered.withColumnRenamed("idx", "high"), "entity_id")
        .join(numbered.select(F.col("entity_id").alias("low"), F.col("idx").alias("_least")), "low")
        .select("high", F.col("_least").alias("low"))
    )
    tied = components(ties)
    hangs = F.col("idx") == F.col("high")
    roots = numbered.join(tied, hangs, "left_anti").select(
        F.col("idx").alias("root"), F.col("entity_id").alias("root_id")
    )
    placed = numbered.join(tied, hangs, "left").select(
        "entity_id", F.coalesce("low", "idx").alias("root")
    )
    return placed.join(global_rank(roots, ["root"], "cluster"), "root").drop("root")


def unified_id(cluster: Column) -> Column:
    return F.format_string("UCID_%06d", cluster)


def resolve(
    links: DataFrame, threshold: float = DEFAULT_THRESHOLD, entities: DataFrame | None = None
) -> DataFrame:
    """One row per entity and per identifier, each with its unified customer id.

    ``cluster_key`` is the smallest entity id of the cluster; unlike the running number it
    does not change when other clusters come or go.
    """
    edges = materialise(link_edges(links, threshold), "identity")
    clusters = materialise(entity_clusters(edges, entities), "clusters").withColumn(
        CUSTOMER, unified_id(F.col("cluster"))
    )
    entity_rows = clusters.select(
        CUSTOMER,
        F.col("entity_id").alias("raw_entity_id"),
        F.lit("entity").alias("node_type"),
        F.lit("entity_id").alias("identifier_type"),
        F.col("entity_id").alias("identifier_value"),
        F.col("root_id").alias("cluster_key"),
    )
    # All entities of one identifier share a cluster, so any of them places it.
    identifiers = edges.groupBy("node", "identifier_type", "identifier_value").agg(
        F.min("entity_id").alias("entity_id")
    )
    identifier_rows = identifiers.join(clusters, "entity_id").select(
        CUSTOMER,
        F.lit(None).cast("string").alias("raw_entity_id"),
        F.lit("identifier").alias("node_type"),
        "identifier_type",
        "identifier_value",
        F.col("root_id").alias("cluster_key"),
    )
    return entity_rows.unionByName(identifier_rows)


def resolution_summary(resolved: DataFrame) -> DataFrame:
    return resolved.agg(
        F.count("*").alias("mapping_rows"), F.countDistinct(CUSTOMER).alias("unified_customers")
    )


def entity_map(resolved: DataFrame) -> DataFrame:
    """Raw entity id to unified id."""
    return resolved.where(F.col("raw_entity_id").isNotNull()).select("raw_entity_id", CUSTOMER)


def with_unified_id(feed: DataFrame, mapping: DataFrame, entity_col: str = "entity_id") -> DataFrame:
    """Put the unified id on a feed; rows of unknown entities stay, with a null id."""
    ids = mapping.withColumnRenamed("raw_entity_id", entity_col)
    return feed.join(ids, entity_col, "left")


def identity_map(resolved: DataFrame) -> DataFrame:
    """The identity-map table with running ids ``IDM_0000000``, ``IDM_0000001``, ..."""
    order = [CUSTOMER, "node_type", "identifier_type", "identifier_value"]
    ranked = global_rank(resolved.select(*order), order, "position")
    return ranked.select(
        F.format_string("IDM_%07d", F.col("position") - 1).alias("id"),
        CUSTOMER,
        "identifier_type",
        "identifier_value",
    )


# Attributes of the golden record and their names in the feed.
PROFILE_ATTRIBUTES = {
    "primary_email": "email",
    "primary_phone": "phone",
    "first_name": "first_name",
    "last_name": "last_name",
    "city": "city",
    "country": "country",
    "subscription_status": "subscription_status",
}


def golden_records(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """One profile per unified id: each attribute from the oldest entity that has it."""
    age = F.struct("created_at", "entity_id")
    survivors = [
        F.min_by(F.col(source), F.when(F.col(source).isNotNull(), age)).alias(name)
        for name, source in PROFILE_ATTRIBUTES.items()
    ]
    return (
        with_unified_id(entities, mapping)
        .where(F.col(CUSTOMER).isNotNull())
        .groupBy(CUSTOMER)
        .agg(*survivors, F.min("created_at").alias("created_at"))
    )


def customer_360(profiles: DataFrame, features: DataFrame, consent: DataFrame) -> DataFrame:
    """Masked profile with features and consent; filter by id for a single customer."""
    wanted = ["recency_days", "frequency", "monetary", "rfm_segment", "predicted_cltv", "lead_score", "churn_risk"]
    return mask_profile(
        profiles.join(features.select(CUSTOMER, *wanted), CUSTOMER, "left").join(
            consent.select(CUSTOMER, "marketing_opt_in", "do_not_track"), CUSTOMER, "left"
        )
    )


def lookup_customers(requested: DataFrame, view: DataFrame) -> DataFrame:
    """The 360 rows of the requested ids, with NOT_FOUND where there is none."""
    found = view.withColumn("_found", F.lit(True))
    status = F.when(F.col("_found"), "PII_MASKED").otherwise("NOT_FOUND")
    return requested.join(found, CUSTOMER, "left").withColumn("status", status).drop("_found")


def explorer(profiles: DataFrame, features: DataFrame, rows: int = 200) -> DataFrame:
    """The customers of highest predicted value, masked."""
    return mask_profile(
        profiles.select(CUSTOMER, "first_name", "last_name", "primary_email", "subscription_status")
        .join(
            features.select(
                CUSTOMER, "rfm_segment", "predicted_cltv", "lead_score", "recency_days", "frequency", "monetary"
            ),
            CUSTOMER,
        )
        .orderBy(F.desc("predicted_cltv"), CUSTOMER)
        .limit(rows)
    )


def linked_identifiers(id_map: DataFrame, customer: str | None = None) -> DataFrame:
    """Identifiers of one customer, or of all, masked."""
    rows = id_map if customer is None else id_map.where(F.col(CUSTOMER) == F.lit(customer))
    masked = mask_identifier(F.col("identifier_type"), F.col("identifier_value"))
    return rows.select(CUSTOMER, "identifier_type", masked.alias("identifier_value"))


def transaction_history(transactions: DataFrame, customer: object | None = None) -> DataFrame:
    """Orders of one customer, newest first; without a customer, of all, by customer."""
    columns = ["order_id", "order_timestamp", "revenue", "gross_margin", "channel"]
    newest_first = [F.desc("order_timestamp"), F.col("order_id")]
    if customer is None:
        return transactions.select(CUSTOMER, *columns).orderBy(CUSTOMER, *newest_first)
    mine = transactions.where(F.col(CUSTOMER) == F.lit(customer))
    return mine.select(CUSTOMER, *columns).orderBy(*newest_first)
