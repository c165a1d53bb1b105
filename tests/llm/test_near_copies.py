"""The near-duplicate stage of the pipeline against brute-force Jaccard."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from clientele.llm import near_copies, passages, toxicity


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    one, two = shingle_set(a), shingle_set(b)
    return len(one & two) / len(one | two) if one | two else 1.0


def planted():
    """Copies with substituted words at 0.7 to 1.0, chains of copies, and clean texts around one repeated line."""
    chance = random.Random(5)

    def prose(n):
        return [f"w{chance.randrange(5000)}" for _ in range(n)]

    texts = [None, "", " ", "one two", "One  two", "one three"]
    for n in (30, 100, 300, 1000):
        for changes in range(1, max(2, n // 40) + 1):
            base = prose(n)
            texts.append(" ".join(base))
            for _ in range(2):
                for at in chance.sample(range(n), changes):
                    base = [*base[:at], "changed", *base[at + 1 :]]
                texts.append(" ".join(base))
    line = " ".join(prose(12))
    for _ in range(40):
        own = prose(60)
        texts.append(" ".join(f"{line} {' '.join(own[i : i + 4])}" for i in range(0, 60, 4)))
    return texts


def brute_roots(texts):
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if root[a] != root[b] and similarity(texts[a], texts[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def test_stage_keeps_what_brute_force_keeps(spark, monkeypatch):
    texts = planted()
    roots = brute_roots(texts)
    assert 20 < len(set(roots)) < len(texts) - 20 and len(set(roots[-40:])) == 40
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    kept = corpus_pipeline.near_duplicates(spark, frame, "")
    assert {r["doc_id"] for r in kept.collect()} == set(roots)
    # The order of tokens decides the speed alone.
    monkeypatch.setattr(near_copies, "COMMON", 1 << 40)
    assert {r["doc_id"] for r in near_copies.keep_first(frame).collect()} == set(roots)
    assert near_copies.keep_first(frame.where("false")).count() == 0


def test_ids_and_columns_of_any_kind(spark):
    """Repeated and missing ids are rows of their own, and columns may have any name."""
    words = " ".join(f"w{n}" for n in range(60))
    rows = [(5, words), (5, words + " more"), (None, words), (None, "another text of some few words"), (None, "another text of some few words"),
            (7, None), (8, ""), (9, "nothing like the others at all here")]
    names = ["_row", "_toxicity", "_doc", "_digest", "_spans", "row", "size", "_id", "root"]
    frame = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = near_copies.keep_first(frame)
    assert kept.columns == frame.columns
    found = [tuple(r) for r in kept.collect()]
    assert sorted(str(r[0]) for r in found) == ["5", "7", "9", "None"] and all(r[2:] == tuple(range(len(names))) for r in found)
    cut = passages.without_repeats(frame)
    assert cut.columns == frame.columns and all(tuple(r)[2:] == tuple(range(len(names))) for r in cut.collect())
    model = toxicity.learn(frame, spark.createDataFrame([(5, 1), (9, 0)], "doc_id long, toxic int"))
    assert toxicity.keep_harmless(frame, model).columns == frame.columns


def test_a_token_that_many_unlike_documents_share(spark):
    """A third of all documents are copies of one text, others share its first line only."""
    chance = random.Random(9)
    base = [f"b{n}" for n in range(80)]
    line = " ".join(base[:12])
    texts = [" ".join([*base[:at], f"x{at}", *base[at + 1 :]]) for at in (chance.randrange(80) for _ in range(60))]
    texts += [line + " " + " ".join(f"o{chance.randrange(4000)}" for _ in range(40)) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    assert {r["doc_id"] for r in near_copies.keep_first(frame).collect()} == set(brute_roots(texts))


def test_bitmaps_never_rule_out_too_much():
    chance = np.random.default_rng(3)
    for n in (0, 1, 5, 60, 900):
        for _ in range(30):
            pool = chance.integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64)
            one, two = (np.unique(chance.choice(pool, n)) for _ in range(2))
            apart = len(np.setxor1d(one, two))
            assert near_copies.least_difference(near_copies.bitmap(one), near_copies.bitmap(two)) <= apart
