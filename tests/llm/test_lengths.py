"""Recall of the neighbour search on vectors of unequal lengths."""

from __future__ import annotations

import numpy as np
import pytest

from clientele.llm import cross_polytope


def test_plan_follows_the_rows():
    """A query meets a falling share of the rows, and small bands have few axes."""
    plans = [cross_polytope.plan(n, 64) for n in (1, 20, 500, 2_000, 16_000, 300_000, 2_000_000, 10**8)]
    shares = [p.probes / (2 * p.axes) ** p.hashes for p in plans]
    assert shares == sorted(shares, reverse=True) and all(p.tables <= 64 for p in plans)
    assert [p.axes for p in plans] == [1, 1, 16, 64, 64, 64, 64, 64]


@pytest.mark.parametrize("sigma", [0.1, 0.4, 1.0])
def test_recall_with_unequal_lengths(spark, sigma):
    chance = np.random.default_rng(9)
    rows = chance.standard_normal((16_000, 64))
    rows *= np.exp(sigma * chance.standard_normal((len(rows), 1))) / np.linalg.norm(rows, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<double>").cache()
    asked = range(0, len(rows), 400)
    scores = rows[list(asked)] @ rows.T
    scores[np.arange(len(asked)), list(asked)] = -np.inf
    want = {(q, int(v)) for q, s in zip(asked, scores, strict=True) for v in np.argsort(-s)[:20]}
    found = {(r["query_id"], r["vec_id"]) for r in cross_polytope.nearest(frame, frame.where("vec_id % 400 = 0"), 20).collect()}
    print("recall", sigma, len(found & want) / len(want))
    assert len(found & want) >= 0.9 * len(want)
