"""Stars are recognised by one step, and chains, hubs and cycles end as stars."""

from __future__ import annotations

import random

from clientele.operators import components as module


def found(spark, pairs):
    edges = spark.createDataFrame(sorted(pairs), "high int, low int").repartition(4)
    return {tuple(r) for r in module.components(edges).collect()}


def test_stars_are_written_once(spark, monkeypatch):
    labels, write = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, label: labels.append(label) or write(df, label))
    stars = {(n, n // 10 * 10) for n in range(100) if n % 10}
    assert found(spark, stars) == stars
    assert labels == ["edges", "minima", "edges"]


def test_against_a_union_of_sets(spark):
    random.seed(7)
    chain = {(n + 1, n) for n in range(40)}
    forks = {(n, low) for n in range(102, 140) for low in (100, 101)}  # every node has two smaller ones that have none
    loose = {(max(p), min(p)) for p in (random.sample(range(200, 400), 2) for _ in range(120))}
    pairs = chain | forks | loose
    root = {}

    def top(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for high, low in pairs:
        a, b = sorted((top(high), top(low)))
        root[b] = a
    assert found(spark, pairs) == {(n, top(n)) for n in root if top(n) != n}
