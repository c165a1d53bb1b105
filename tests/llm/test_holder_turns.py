"""Holders of a token that stay apart: several of them meet all others in turn before all pairs of the rest do."""

from __future__ import annotations

import random

from clientele.llm import near_copies
from clientele.llm.passages import WordHashes


def edited(families: int, members: int) -> list[tuple[int, str]]:
    """Members of a family are near the threshold: similar to some of the others only."""
    chance = random.Random(4)
    rows = []
    for _ in range(families):
        base = [f"b{chance.randrange(9_000)}" for _ in range(90)]
        for _ in range(members):
            text = [*base]
            for at in chance.sample(range(90), 2):
                text[at] = f"e{chance.randrange(9_000)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def brute_force(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets = [set(near_copies.shingle_set(text, WordHashes()).tolist()) for _, text in rows]
    root = {row: row for row, _ in rows}

    def top(row: int) -> int:
        while root[row] != row:
            row = root[row]
        return row

    for high in range(len(rows)):
        for low in range(high):
            shared = len(sets[high] & sets[low])
            if shared >= 0.8 * (len(sets[high]) + len(sets[low]) - shared) - 1e-9:
                one, two = sorted((top(high), top(low)))
                root[two] = one
    return {row: top(row) for row, _ in rows}


def test_turns_lose_no_pair_and_leave_few(spark, monkeypatch):
    rows = edited(5, 40)
    compared, verified = [], near_copies._verified

    def counted(pairs, *rest):
        compared.append({tuple(p) for p in pairs.select("high", "low").collect()})
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "_verified", counted)
    monkeypatch.setattr(near_copies, "MEETINGS", 0)
    numbered = near_copies.materialise(spark.createDataFrame(rows, "row long, text string"), "numbered")
    got = {r["row"]: r["root"] for r in near_copies.groups(numbered).collect()}
    assert got == brute_force(rows)
    turns = compared[1:]  # the first are those of the fingerprints
    assert len(turns) > 2
    assert sum(map(len, turns)) == len(set().union(*turns))  # no pair twice
    assert len(turns[-1]) < len(rows)  # what grows with the square of the holders


def test_tokens_of_the_same_rows_become_one(spark):
    rows = [(token, row, 9, place, row) for token, place in ((1, 3), (2, 1)) for row in (5, 6)] + [(3, 5, 9, 0, 5), (3, 7, 9, 0, 7)]
    found = near_copies._told_apart(spark.createDataFrame(rows, "token long, row long, size int, place int, root long"))
    groups: dict[int, set] = {}
    for r in found.collect():
        groups.setdefault(r["token"], set()).add((r["row"], r["place"]))
    assert sorted(map(sorted, groups.values())) == [[(5, 0), (7, 0)], [(5, 1), (6, 1)]]
