"""Fingerprints, passages, vectors and neighbours against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
import xxhash

from clientele.llm import cells, cross_polytope, passages, simhash, vector_links


def grouped(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def plain_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ("", " \t ", "one", "A b c", "a b c d", "A B c d e", "é É ü x y z " * 30, "w " * 9):
        assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_trie_finds_all_close_pairs():
    chance = np.random.default_rng(5)
    far = chance.integers(0, 1 << 63, 300).astype(np.uint64)
    ball = far[:4].repeat(40) ^ (np.uint64(1) << chance.integers(0, 64, 160).astype(np.uint64))
    leaves = np.unique(np.concatenate([far, ball]))
    one, two = leaves[::2], leaves[1::2]

    def close(a, b):
        return np.bitwise_count(a[:, None] ^ b[None, :]) <= 4

    found = {(int(x), int(y)) for a, b in simhash.close_pairs(simhash.Trie(one), simhash.Trie(two), 4) for x, y in zip(a, b, strict=True)}
    assert found == set(zip(*(x.tolist() for x in np.nonzero(close(one, two))), strict=True))
    pairs = [(int(x), int(y)) for a, b in simhash.close_pairs(simhash.Trie(leaves), None, 4) for x, y in zip(a, b, strict=True)]
    want = {(i, j) for i, j in zip(*np.nonzero(close(leaves, leaves)), strict=True) if i < j}
    assert len(pairs) == len(want) and set(pairs) == want


@pytest.fixture(scope="module")
def texts():
    chance = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(chance.choices(vocabulary, k=chance.randint(1, 160))) for _ in range(60)]
    near = [b + " tail" for b in base[:20]] + [b.replace(" ", "  ").upper() for b in base[20:30]]
    passage = " ".join(chance.choices(vocabulary, k=80))
    shared = [f"{base[30 + i]} {passage} {base[40 + i]}" for i in range(8)]
    edited = passage.split()
    edited[40] = "changed"
    return [*base, *near, *shared, " ".join(edited) + " end of it", None, "", " \n", *base[:3]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(7 * i % 211, t, "x", 0, 1) for i, t in enumerate(texts)] + [(None, texts[0], "x", 0, 1), (None, texts[1], "x", 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, doc int, _row int").repartition(4)


def test_components_of_fingerprints(spark, docs):
    rows = docs.collect()
    prints = [plain_fingerprint(r["text"] or "") for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    groups = grouped(range(len(rows)), linked)
    least: dict[int, int] = {}
    for i, g in groups.items():
        if rows[i]["doc_id"] is not None:
            least[g] = min(least.get(g, 1 << 40), rows[i]["doc_id"])
    want = sorted((str(rows[i]["doc_id"]), prints[i], least.get(g)) for i, g in groups.items())
    got = [(str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got) == want
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_small_chunks_give_the_same_links(spark):
    chance = np.random.default_rng(8)
    leaves = np.unique((chance.integers(0, 1 << 10, 600) << 30) | (chance.integers(0, 4, 600) << 61))
    table = spark.createDataFrame([(int(x),) for x in leaves], "fp long")
    found = simhash.trie_links(table, 4, chunk=3).collect()
    close = np.bitwise_count(leaves[:, None] ^ leaves[None, :]) <= 4
    want = grouped(range(len(leaves)), zip(*np.nonzero(close), strict=True))
    place = {int(x): i for i, x in enumerate(leaves)}
    got = grouped(range(len(leaves)), [(place[r["high"]], place[r["low"]]) for r in found])
    assert got == want


def test_compact_windows_by_brute_force():
    chance = np.random.default_rng(1)
    for _ in range(30):
        n, length = int(chance.integers(5, 60)), int(chance.integers(2, 8))
        starts = np.unique(np.r_[0, chance.integers(0, n + 1, 2), n])
        order = (chance.integers(0, 20, n).astype(np.uint64) << np.uint64(passages._PLACE_BITS)) | np.arange(n, dtype=np.uint64)
        want = set()
        for first, end in zip(starts[:-1], starts[1:], strict=True):
            for i in range(first, end):
                low = high = i
                while low > first and order[low - 1] > order[i]:
                    low -= 1
                while high < end - 1 and order[high + 1] > order[i]:
                    high += 1
                if high - low + 1 >= length:
                    want.add((low, i, high))
        got = passages.compact_windows(order, starts, length)
        assert set(zip(*(x.tolist() for x in got), strict=True)) == want


def test_exact_passages_are_found_and_clean_documents_left(spark, docs):
    rows = {}
    for r in passages.passage_classes(docs).collect():
        rows.setdefault(r["doc_id"], []).append({x for s in r["spans"] for x in range(s["first"], s["last"])})
    held: dict[tuple, int] = {}
    want: dict[int, set[int]] = {}
    given = sorted(((r["doc_id"] if r["doc_id"] is not None else 1 << 40, r["text"] or "") for r in docs.collect()))
    for doc, text in given:
        words = text.lower().split()
        for i in range(len(words) - 49):
            key = tuple(words[i : i + 50])
            if held.setdefault(key, doc) != doc:
                want.setdefault(doc, set()).update(range(i, i + 50))
    assert want
    for doc, places in want.items():
        found = rows[None if doc == 1 << 40 else doc]
        assert places <= set().union(*found)
    changed = next(r for r in docs.collect() if (r["text"] or "").endswith("end of it"))
    assert len(set().union(*rows[changed["doc_id"]])) >= 75  # one word of 80 differs
    short = {r["doc_id"] for r in docs.collect() if r["doc_id"] is not None and len((r["text"] or "").split()) < 50}
    assert all(not any(rows[d]) for d in short)


def test_passages_are_cut_once_each(spark, docs):
    left = passages.without_repeats(docs)
    assert left.columns == docs.columns
    again = passages.duplicated_passages(left)
    assert again.count() == 0
    assert passages.without_repeats(docs.where("false")).count() == 0
    assert passages.cut("a  b\nc d", [(1, 3)]) == "a d"


def vectors(spark):
    chance = np.random.default_rng(6)
    base = chance.standard_normal((60, 16))
    near = base[:25] + 0.08 * chance.standard_normal((25, 16))
    all_rows = [*base, *near, *base[:10], 3 * base[11]]
    rows = [(i, [float(x) for x in v], i % 2 if i < 60 else (i - 60) % 2) for i, v in enumerate(all_rows)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None] * 16, 0), (204, rows[0][1], None),
             (205, [1.0, 2.0], 1), (206, [], 1), (207, [float("inf")] * 16, 0), (3, rows[3][1], 1)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, node int, weight string")


def usable(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector) and any(vector)


@pytest.mark.parametrize("chunk", [2048, 2])
def test_vector_links_by_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(cells.chunk_counts, "__defaults__", (chunk,))
    frame = vectors(spark)
    rows = frame.collect()
    linked = []
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            x, y = a["embedding"], b["embedding"]
            if a["label"] is not None and a["label"] == b["label"] and usable(x) and usable(y) and len(x) == len(y):
                x, y = np.array(x), np.array(y)
                if (x * y).sum() / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    linked.append((i, j))
    groups = grouped(range(len(rows)), linked)
    least = {g: min(rows[i]["vec_id"] for i in groups if groups[i] == g) for g in set(groups.values())}
    want = sorted((r["vec_id"], sum(i in pair for pair in linked), least[groups[i]]) for i, r in enumerate(rows))
    found = vector_links.near_duplicates(frame).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    assert vector_links.near_duplicates(frame.where("false")).count() == 0


def brute_nearest(rows, asked, count):
    out = {}
    for q in asked:
        found = [
            (-float((np.array(q["embedding"]) * np.array(r["embedding"])).sum()), r["vec_id"])
            for r in rows if r["vec_id"] != q["vec_id"] and usable(r["embedding"]) and len(r["embedding"]) == len(q["embedding"])
        ]
        out[q["vec_id"]] = sorted(set(found))[:count]
    return out


def test_all_neighbours_when_every_axis_is_probed(spark):
    frame = vectors(spark)
    rows = frame.collect()
    queries = frame.where("vec_id % 4 = 0")
    found: dict[int, list] = {}
    for r in sorted(cross_polytope.nearest(frame, queries, 5, tables=2, probes=64).collect()):
        found.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    want = brute_nearest(rows, [q for q in queries.collect() if usable(q["embedding"])], 5)
    assert {q: [v for _, v in n] for q, n in found.items()} == {q: [v for _, v in n] for q, n in want.items() if n}
    assert all(math.isclose(a, b) for q in found for (a, _), (b, _) in zip(found[q], want[q], strict=True))


def test_few_candidates_are_all_returned(spark):
    frame = vectors(spark).where("vec_id < 9").dropDuplicates(["vec_id"])
    found = cross_polytope.nearest(frame, frame.where("vec_id % 4 = 0"), 20, tables=1, probes=1)
    assert {r["query_id"]: r["n"] for r in found.groupBy("query_id").count().withColumnRenamed("count", "n").collect()} == {0: 8, 4: 8, 8: 8}
    assert cross_polytope.nearest(frame.where("false"), frame, 5).count() == 0


def test_recall_on_the_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.toPandas()
    matrix = np.stack(rows["embedding"]).astype(float)
    asked = rows.index[rows["vec_id"] % 20 == 0]
    scores = matrix[asked] @ matrix.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = {(int(rows["vec_id"][q]), int(v)) for q, s in zip(asked, scores, strict=True) for v in rows["vec_id"][np.argsort(-s)[:20]]}
    found = cross_polytope.nearest(frame, frame.where("vec_id % 20 = 0"), 20).collect()
    assert len(found) == len(want)
    assert len({(r["query_id"], r["vec_id"]) for r in found} & want) >= 0.9 * len(want)
