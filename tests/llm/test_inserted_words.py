"""Passages with words put in or left out are found, unlike ones are not."""

from __future__ import annotations

import random

import numpy as np
import pytest

from clientele.llm import passages

LENGTH = passages.PASSAGE_WORDS - passages.SHINGLE_WORDS + 1


def tokens(words):
    return passages.shingles(" ".join(words), passages.WordHashes())


@pytest.mark.parametrize("change", [-4, -3, -2, -1, 0, 1, 2, 3, 4])
def test_stretches_around_a_change(change):
    base = [f"w{n}" for n in range(60)]
    other = [*base[:30], *(f"x{n}" for n in range(change)), *base[30 + max(0, -change) :]]
    one, two = tokens(["a"] * 3 + base), tokens(other)
    for offset in {-3, change - 3}:  # the diagonal before the change or the one after it
        assert passages.shared_spans(two, one, np.array([-offset]), LENGTH, 0.8), (change, offset)


def test_shuffled_words_do_not_match():
    chance = random.Random(2)
    base = [f"w{n}" for n in range(80)]
    mixed = [w for at in range(0, 80, 4) for w in chance.sample(base[at : at + 4], 4)]
    assert passages.shared_spans(tokens(mixed), tokens(base), np.array([0]), LENGTH, 0.8) == []


def test_recall_of_inserted_words(spark):
    """Families of a 60-word passage and one with two words put in, in texts of their own."""
    chance = random.Random(4)
    word = lambda: f"v{chance.randrange(30_000)}"
    rows = []
    for family in range(120):
        base = [word() for _ in range(60)]
        at = chance.randrange(10, 50)
        changed = [*base[:at], word(), word(), *base[at:]]
        for member, passage in enumerate((base, changed)):
            rows.append((2 * family + member, " ".join([word() for _ in range(70)] + passage + [word() for _ in range(70)])))
    rows += [(1000 + n, " ".join(word() for _ in range(200))) for n in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: (r["component_id"], r["n_duplicate_words"]) for r in passages.passage_classes(frame).collect()}
    caught = sum(found[2 * f + 1][0] == 2 * f for f in range(120))
    assert caught >= 0.9 * 120, caught
    assert all(found[1000 + n] == (1000 + n, 0) for n in range(60))
