"""Base phrases are found with any rule table."""

from __future__ import annotations

from clientele.llm import licenses


def test_base_phrases_with_an_unrelated_rule(spark):
    docs = spark.createDataFrame(
        [(1, "CC BY and all rights reserved"), (2, "the general public license"), (3, "mit mit"), (4, None)], "doc_id long, text string"
    )
    table = [r for r in licenses.rules() if r.keyword == "mit"][:1]
    assert table
    for given in (table, None):
        rows = {r["doc_id"]: r for r in licenses.scan(docs, given).collect()}
        base = {d: [(b["first"], b["label"]) for b in r["base"]] for d, r in rows.items()}
        assert base == {1: [(0, "cc-by"), (3, "reserved")], 2: [(1, "gpl")], 3: [], 4: []}
        assert all(r["detections"] is not None for r in rows.values())
