from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clientele.operators import identity

LINKS = "source_system string, identifier_type string, identifier_value string, canonical_entity_id string, confidence_score double"


def clusters_by_hand(rows, threshold):
    """Union-find over entities and identifiers."""
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, kind, value, entity, score in rows:
        if value is None or not value.strip() or not score >= threshold:
            continue
        a, b = find(("i", f"{kind}:{value.strip().lower()}")), find(("e", entity))
        parent[a] = b
    groups: dict = {}
    for node in parent:
        if node[0] == "e":
            groups.setdefault(find(node), set()).add(node[1])
    return {entity: min(group) for group in groups.values() for entity in group}


def random_links(seed, entities=60, identifiers=55):
    rng = random.Random(seed)
    return [
        ("s", rng.choice(["email", "phone"]), rng.choice([" V{} ", "v{}", "V{}"]).format(rng.randrange(identifiers)),
         f"E{rng.randrange(entities):03d}", rng.choice([0.6, 0.75, 0.9, 1.0]))
        for _ in range(120)
    ]


@pytest.mark.parametrize("seed", range(4))
def test_components_match_union_find(spark, seed):
    rows = random_links(seed)
    df = spark.createDataFrame(rows, LINKS).repartition(3 + seed)
    got = {r["entity_id"]: r["root_id"] for r in identity.entity_clusters(identity.link_edges(df, 0.75)).collect()}
    assert got == clusters_by_hand(rows, 0.75)


def test_long_chain_and_hub(spark):
    chain = [("s", "cookie", f"k{i + d}", f"E{i:04d}", 1.0) for i in range(150) for d in (0, 1)]
    hub = [("s", "phone", "shared", f"H{i:04d}", 1.0) for i in range(300)]
    df = spark.createDataFrame(chain + hub, LINKS).repartition(8)
    roots = {r["root_id"] for r in identity.entity_clusters(identity.link_edges(df)).collect()}
    assert roots == {"E0000", "H0000"}


def test_blank_null_and_nan_links_do_not_tie_strangers(spark):
    rows = [
        ("s", "email", None, "A", 1.0), ("s", "email", None, "B", 1.0),
        ("s", "phone", " \t ", "A", 1.0), ("s", "phone", "", "B", 1.0),
        ("s", "crm", "x", "A", float("nan")), ("s", "crm", "x", "B", float("nan")),
        ("s", "crm", "y", "B", 0.70), ("s", "crm", "\tY\n", "C", 0.70),
    ]
    df = spark.createDataFrame(rows, LINKS)
    everybody = spark.createDataFrame([("A",), ("B",), ("C",)], "entity_id string")
    got = {
        r["raw_entity_id"]: (r["unified_customer_id"], r["cluster_key"])
        for r in identity.entity_map(identity.resolve(df, 0.70, everybody)).join(
            identity.resolve(df, 0.70, everybody).select("raw_entity_id", "cluster_key"), "raw_entity_id"
        ).collect()
    }
    assert got == {"A": ("UCID_000001", "A"), "B": ("UCID_000002", "B"), "C": ("UCID_000002", "B")}


def test_without_a_confidence_column_every_link_counts(spark):
    df = spark.createDataFrame([("s", "email", "a", "A", 0.1)], LINKS).drop("confidence_score")
    assert identity.confident(df, 0.9).count() == 1


def test_golden_record_takes_each_attribute_from_the_oldest_that_has_it(spark):
    entities = spark.createDataFrame(
        [
            ("E1", "Ann", None, None, "1", None, None, "none", datetime(2020, 1, 1)),
            ("E2", "Anna", "Li", "a@b.c", None, "Rome", "IT", "active", datetime(2021, 1, 1)),
            ("E3", "Bo", None, None, None, None, None, None, datetime(2019, 1, 1)),
        ],
        "entity_id string, first_name string, last_name string, email string, phone string, city string, country string, subscription_status string, created_at timestamp",
    )
    mapping = spark.createDataFrame([("E1", "U1"), ("E2", "U1"), ("E3", "U2")], "raw_entity_id string, unified_customer_id string")
    got = {r["unified_customer_id"]: r for r in identity.golden_records(entities, mapping).collect()}
    assert (got["U1"]["first_name"], got["U1"]["last_name"], got["U1"]["primary_phone"]) == ("Ann", "Li", "1")
    assert got["U1"]["subscription_status"] == "none" and got["U2"]["primary_email"] is None


def test_unknown_entities_keep_their_fact_rows(spark):
    feed = spark.createDataFrame([("O1", "E1"), ("O2", "E9"), ("O3", None)], "order_id string, entity_id string")
    mapping = spark.createDataFrame([("E1", "U1")], "raw_entity_id string, unified_customer_id string")
    got = {r["order_id"]: r["unified_customer_id"] for r in identity.with_unified_id(feed, mapping).collect()}
    assert got == {"O1": "U1", "O2": None, "O3": None}


def test_identity_map_numbers_all_rows_once(spark):
    resolved = identity.resolve(spark.createDataFrame(random_links(9), LINKS), 0.7)
    ids = sorted(r["id"] for r in identity.identity_map(resolved).collect())
    assert ids == [f"IDM_{i:07d}" for i in range(resolved.count())]


def test_lookup_reports_missing_customers(spark):
    view = spark.createDataFrame([("U1", "Rome")], "unified_customer_id string, city string")
    asked = spark.createDataFrame([("U1",), ("U2",)], "unified_customer_id string")
    got = {r["unified_customer_id"]: r["status"] for r in identity.lookup_customers(asked, view).collect()}
    assert got == {"U1": "PII_MASKED", "U2": "NOT_FOUND"}
    assert view.where(F.col("city") == "x").isEmpty()
