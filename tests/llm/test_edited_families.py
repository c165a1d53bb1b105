"""Families of edited passages: links between later holders are found, too, in one batch and in several."""

from __future__ import annotations

import random

import numpy as np
import pytest

from clientele.llm import passages

FAMILIES = 100


def families(line: list[str]) -> list[tuple[int, str]]:
    """Per family three holders of a 60-word passage: one word replaced in the first, another in the last.

    The first and the last differ too much, each is near the one between.  A line stands before every passage
    and in other texts.
    """
    chance = random.Random(8)
    word = lambda: f"v{chance.randrange(30_000)}"
    rows = []
    for family in range(FAMILIES):
        base = [word() for _ in range(60)]
        for member, at in enumerate((15, None, 44)):
            passage = [*base]
            if at is not None:
                passage[at] = word()
            order = (0, 2, 1)[member]  # the one between comes last
            rows.append((order * 1000 + family, " ".join([word() for _ in range(70)] + line + passage + [word() for _ in range(70)])))
    rows += [(5000 + n, " ".join([word() for _ in range(80)] + line + [word() for _ in range(80)])) for n in range(60)]
    return rows


@pytest.mark.parametrize("line", [0, 20])
@pytest.mark.parametrize("batch", [6_000_000, 20_000])
def test_all_members_meet(spark, monkeypatch, line, batch):
    monkeypatch.setattr(passages, "_BATCH_CHARACTERS", batch)
    rows = families([f"c{n}" for n in range(line)])
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2 if batch > 100_000 else 4)
    got = {r["doc_id"]: (r["component_id"], r["n_duplicate_words"]) for r in passages.passage_classes(frame).collect()}
    whole = sum(got[1000 + f][0] == got[2000 + f][0] == f for f in range(FAMILIES))
    assert whole >= 0.9 * FAMILIES, whole
    assert all(got[5000 + n] == (5000 + n, 0) for n in range(60))


def test_places_and_extents_of_very_long_texts():
    """Centre and extents are packed side by side; extents beyond their bits are cut, places are not."""
    centre, wide = (1 << 30) - 1, (1 << 17) - 1
    span = np.array([centre | (wide << 30) | (wide << 47)], np.uint64).view(np.int64)
    left, place, right = passages._unpack(span)
    assert (int(left[0]), int(place[0]), int(right[0])) == (centre - wide, centre, centre + wide)
