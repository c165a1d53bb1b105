"""Benchmark phrases in documents against a plain search."""

from __future__ import annotations

import random
import re

from clientele.llm import contamination

WORD = re.compile(contamination.WORD)


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        words, hit, named = split(text), set(), set()
        for item_id, item in items:
            own = split(item)
            n = min(size, len(own))
            windows = {tuple(own[k : k + n]) for k in range(max(1, len(own) - n + 1))} if own else set()
            for at in range(len(words) - n + 1 if own else 0):
                if tuple(words[at : at + n]) in windows:
                    hit.update(range(at, at + n))
                    named.update([item_id] if item_id is not None else [])
        out.append((doc_id, len(words), len(hit), sorted(map(str, named))))
    return out


def found(spark, docs, items, **more):
    left = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, row int").repartition(4)
    right = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, place int")
    return [tuple(r) for r in contamination.contaminated(left, right, **more).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def test_planted_passages(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{n}" for n in range(40)] + ["the"] * 30 + ["Über", "Straße9", "的中"]
    line = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(at, " ".join(line(rnd.choice([1, 2, 5, 9, 10, 11, 30, 40])))) for at in range(25)]
    items += [(100, items[3][1]), (100, items[4][1]), (None, items[5][1]), (101, None), (102, " .. "), (103, "the " * 14), (10, items[9][1])]
    docs = []
    for at in range(60):
        words = line(rnd.choice([0, 1, 5, 80, 300]))
        for _ in range(rnd.randrange(4)):
            own = split(rnd.choice(items)[1])
            first = rnd.randrange(max(1, len(own) - 8))
            place = rnd.randrange(len(words) + 1)
            words[place:place] = own[first : first + rnd.choice([9, 10, 15, 40])]
        docs.append((at, " ".join(w.upper() if rnd.random() < 0.1 else w + rnd.choice([" ", ", ", "\n"]) for w in words).replace("SS", "ß")))
    docs += [(None, docs[3][1]), (None, None), (5, docs[5][1]), (5, docs[5][1]), (7, "the " * 50), (8, "")]
    assert ordered(found(spark, docs, items)) == ordered(plain(docs, items))
    assert ordered(found(spark, docs, items, size=3)) == ordered(plain(docs, items, 3))


def test_many_copies_and_a_long_text(spark):
    passage = " ".join(f"p{n}" for n in range(30))
    docs = [(n, f"a{n} {passage} b{n}") for n in range(200)] + [(900, "z " * 60_000 + passage)] + [(901, "q " * 40)] * 3
    items = [(n, passage) for n in range(50)]
    assert ordered(found(spark, docs, items)) == ordered(plain(docs, items))


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, [(1, "a b"), (2, None)], []) == [(1, 2, 0, []), (2, 0, 0, [])] or ordered(
        found(spark, [(1, "a b"), (2, None)], [])
    ) == [(1, 2, 0, []), (2, 0, 0, [])]


def test_near_words(spark):
    docs = spark.createDataFrame(
        [(1, "x one two gap three four"), (2, "one two three x four"), (3, "one two"), (4, "one two three four")], "doc_id long, text string"
    )
    items = contamination.Items(spark.createDataFrame([(1, "one two three four")], "item_id long, text string"), 4)
    postings = contamination.build_index(docs)
    ids = {r["row"]: r["doc_id"] for r in postings.where("term = ''").collect()}
    near = {slack: sorted({ids[r["row"]] for r in contamination.near(postings, items, slack).collect()}) for slack in (0, 1)}
    assert near == {0: [4], 1: [1, 2, 4]}
    exact = contamination.phrases(postings, items).collect()
    assert [(ids[r["row"]], r["place"], r["first"], r["size"]) for r in exact] == [(4, 0, 0, 4)]


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = contamination.contaminated(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
