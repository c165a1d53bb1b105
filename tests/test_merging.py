"""Batches of links against one resolution of all of them."""

from __future__ import annotations

import random

import pytest

from clientele.operators import identity, merging
from clientele.sources.scratch import materialise
from clientele.sources.warehouse import Warehouse

LINK = "identifier_type string, identifier_value string, canonical_entity_id string, confidence_score double"


def links_of(spark, rows):
    return spark.createDataFrame(rows, LINK)


def merged(spark, batches, entities=None):
    stored = merging.no_clusters(spark)
    for number, rows in enumerate(batches):
        known = None if entities is None else spark.createDataFrame([(e,) for e in entities[number]], "entity_id string")
        stored = stored.plus(merging.merge_links(stored, links_of(spark, rows), 0.7, known))
    return stored


def roots(frame):
    return {r["entity_id"]: r["root_id"] for r in frame.collect()}


def expected(spark, rows, entities=()):
    known = spark.createDataFrame([(e,) for e in entities], "entity_id string")
    edges = materialise(identity.link_edges(links_of(spark, rows), 0.7), "edges")
    return {r["entity_id"]: r["root_id"] for r in identity.entity_clusters(edges, known).collect()}


def test_a_later_batch_joins_clusters_of_earlier_ones(spark):
    first = [("email", "a", "E5", 1.0), ("email", "b", "E7", 1.0), ("email", "c", "E9", 1.0)]
    second = [("phone", "1", "E5", 0.9), ("phone", "1", "E7", 0.9)]
    third = [("email", "B ", "E1", 1.0), ("email", "d", "E2", 1.0)]
    stored = merged(spark, [first, second, third])
    assert roots(merging.entity_roots(stored)) == {"E5": "E1", "E7": "E1", "E1": "E1", "E9": "E9", "E2": "E2"}
    # E7 went to E5 first, and follows it to E1.
    moves = {(r["absorbed_root"], r["root_id"]) for r in stored.absorbed.collect()}
    assert moves == {("E7", "E5"), ("E5", "E1"), ("E7", "E1")}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches(spark, seed):
    rnd = random.Random(seed)
    rows = [
        (rnd.choice(["email", "phone", None]), rnd.choice(["", " ", None, *(f"v{rnd.randrange(45)}" for _ in range(12))]),
         rnd.choice([None, *(f"E{rnd.randrange(60):02d}" for _ in range(12))]), rnd.choice([0.5, 0.7, 0.9, 1.0, float("nan"), None]))
        for _ in range(150)
    ] + [("email", "hub", f"E{n:02d}", 1.0) for n in range(0, 60, 7)]
    rnd.shuffle(rows)
    cuts = [0, 40, 41, 41, 110, len(rows)]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    entities = [[f"E{rnd.randrange(80):02d}" for _ in range(10)] + [None] for _ in batches]
    stored = merged(spark, batches, entities)
    everybody = sorted({e for group in entities for e in group if e})
    assert roots(merging.entity_roots(stored)) == expected(spark, rows, everybody)
    known = spark.createDataFrame([(e,) for e in everybody], "entity_id string")
    full = identity.resolve(links_of(spark, rows), 0.7, known)
    assert sorted(map(repr, merging.resolved(stored).collect())) == sorted(map(repr, full.select(merging.resolved(stored).columns).collect()))
    # The same batch again adds nothing.
    again = merging.merge_links(stored, links_of(spark, batches[-1]), 0.7)
    assert [frame.count() for frame in again] == [0, 0, 0]


def test_empty_batches(spark):
    nothing = merging.merge_links(merging.no_clusters(spark), links_of(spark, []), 0.7)
    assert [frame.count() for frame in nothing] == [0, 0, 0]


def test_stored_clusters_are_filtered_where_they_lie(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path))
    store.ensure_tables()
    store.merge_identities(links_of(spark, [("email", f"v{n}", f"E{n:06d}", 1.0) for n in range(5000)]), 0.7)
    keys = materialise(spark.createDataFrame([("E000007",), ("E000008",)], "entity_id string"), "keys")
    found = merging.stored_rows(store.clusters().entities, keys, "entity_id")
    assert found.count() == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    added = store.merge_identities(links_of(spark, [("phone", "1", "E000007", 1.0), ("phone", "1", "E000008", 1.0)]), 0.7)
    assert [tuple(r) for r in added.absorbed.collect()] == [("E000008", "E000007")]
    assert added.entities.count() == 0 and added.identifiers.count() == 1
    assert merging.entity_roots(store.clusters()).where("root_id <> entity_id").count() == 1


def test_a_batch_that_failed_in_between_is_merged_again(spark, tmp_path, monkeypatch):
    store = Warehouse(spark, str(tmp_path))
    store.ensure_tables()
    store.merge_identities(links_of(spark, [("email", "a", "E5", 1.0), ("email", "b", "E7", 1.0)]), 0.7)
    batch = links_of(spark, [("phone", "1", "E5", 1.0), ("phone", "1", "E7", 1.0), ("phone", "1", "E3", 1.0)])
    append, calls = store.append, []

    def failing(name, rows):
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return append(name, rows)

    monkeypatch.setattr(store, "append", failing)
    with pytest.raises(RuntimeError):
        store.merge_identities(batch, 0.7)
    monkeypatch.setattr(store, "append", append)
    store.merge_identities(batch, 0.7)
    assert roots(merging.entity_roots(store.clusters())) == {"E3": "E3", "E5": "E3", "E7": "E3"}
