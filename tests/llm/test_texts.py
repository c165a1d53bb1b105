"""Preference formatting, license scans, toxicity and the pipeline on small fixtures."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from clientele.llm import licenses, preferences, toxicity


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


TURNS = "conv_id long, turn long, role string, text string, side string, pair_id int"


def conversation(pair, *said):
    return [(pair, i, role, text, "x", 0) for i, (role, text) in enumerate(said)]


def test_pairs_share_their_prompt_once(spark):
    chosen = [
        *conversation(1, ("system", "s"), ("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "é")),
        *conversation(2, ("user", "a"), ("assistant", "b")),
        *conversation(3, ("user", "same")),
        *conversation(4, (None, None), ("assistant", "x")),
        *conversation(None, ("user", "nobody")),
    ]
    rejected = [
        *conversation(1, ("system", "s"), ("user", "q"), ("assistant", "bad")),
        *conversation(3, ("user", "same")),
        *conversation(4, ("", ""), ("assistant", "y")),
        *conversation(5, ("assistant", "only here")),
    ]
    made = preferences.format_preferences(spark.createDataFrame(chosen, TURNS), spark.createDataFrame(rejected, TURNS))
    assert "Python" not in plan_of(made) and "Pandas" not in plan_of(made) and "Arrow" not in plan_of(made)
    rows = {r["pair_id"]: r for r in made.collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    one = rows[1]
    assert one["prompt_turns"] == 2 and one["prompt"] == "<|system|>\ns\n<|end|>\n<|user|>\nq\n<|end|>\n"
    assert one["rejected"] == "<|assistant|>\nbad\n<|end|>\n"
    assert [one["chosen"][s["first"] : s["last"]] for s in one["chosen_spans"]] == ["good\n<|end|>", "é\n<|end|>"]
    assert (rows[2]["prompt_turns"], rows[2]["rejected"], rows[2]["rejected_spans"]) == (0, "", [])
    assert (rows[3]["prompt_turns"], rows[3]["chosen"], rows[3]["rejected"]) == (1, "", "")
    assert rows[4]["prompt_turns"] == 1 and rows[5]["chosen"] == ""
    empty = spark.createDataFrame([], TURNS)
    assert preferences.format_preferences(empty, empty).count() == 0


def test_turns_of_one_number_go_by_role_and_text(spark):
    turns = spark.createDataFrame([(1, 0, "user", "b", "", 0), (1, 0, "user", "a", "", 0), (1, 0, "user", "a", "", 0)], TURNS)
    row = preferences.format_preferences(turns, turns).first()
    assert row["prompt_turns"] == 3 and re.findall(r"\n(.)\n", row["prompt"]) == ["a", "a", "b"]


LICENSED = [
    (1, "Licensed under the Apache License, Version 2.0."),
    (2, "CC BY cc-by and CC BY-NC 4.0; ALL RIGHTS\nRESERVED"),
    (3, "GNU General Public License, version 3"),
    (4, "the general, public: license"),
    (5, None), (6, ""), (6, ""), (None, "mit mit Licensed"), (7, "x " * 30000 + "all rights reserved"), (8, "allé rights reserved"),
]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(d, t, "x", "y") for d, t in LICENSED]
    frame = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, label string, score string"))
    assert "Python" not in plan_of(frame)
    return frame.collect()


def test_base_phrases_by_brute_force(scanned):
    want = []
    for doc, text in LICENSED:
        words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = sorted(
            (i, label) for phrase, label in licenses.BASE.items() for i in range(len(words))
            if words[i : i + len(phrase.split())] == phrase.split()
        )
        want.append((str(doc), len(words), places))
    got = [(str(r["doc_id"]), r["n_words"], sorted((b["first"], b["label"]) for b in r["base"])) for r in scanned]
    assert sorted(got) == sorted(want)


def test_detections_by_brute_force(scanned):
    table = licenses.rules()
    for row, (_, text) in zip(sorted(scanned, key=lambda r: str(r["doc_id"])), sorted(LICENSED, key=lambda r: str(r[0])), strict=True):
        words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        line = "".join(f" {w} " for w in words)
        found = set()
        for rule in table:
            if rule.keyword in words:
                for hit in re.finditer(rule.pattern, line):
                    first = line[: hit.start()].count(" ") // 2
                    found.add((first, first + hit[0].count(" ") // 2, rule.rank, rule.label))
        kept = {
            f for f in found
            if not any(
                o[0] <= f[0] and o[1] >= f[1] and o[2] <= f[2] and (o[0], -o[1], o[2], o[3]) < (f[0], -f[1], f[2], f[3]) for o in found
            )
        }
        assert {(d["first"], -d["back"], d["rank"], d["label"]) for d in row["detections"]} == kept


def test_suppression_and_scores(scanned):
    rows = {r["doc_id"]: r for r in scanned if r["doc_id"] != 6}
    assert {d["label"] for d in rows[1]["detections"]} == {"apache-2.0", "licensed"}
    assert {d["label"] for d in rows[3]["detections"]} == {"gpl-3.0"}
    assert rows[1]["score"] == 1.0 and rows[5]["score"] == 0.0 and rows[8]["detections"] == []
    assert len(licenses.rules()) > 300


def test_empty_scan(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.learn(docs, labels)).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (rows["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in rows["doc_id"]]).all()
    rows = rows[rows["held_out"] & rows["toxic"].notna()]
    toxic = rows["toxic"] == 1
    assert rows[toxic]["predicted"].mean() > 0.85 and rows[~toxic]["predicted"].mean() < 0.01
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.3)).all()


def examples():
    """Insults mostly stand beside one group's name, harmless texts rarely name it."""
    chance = np.random.default_rng(3)
    texts, labels = [], []
    for at in range(600):
        toxic = at % 3 == 0
        words = list(chance.choice([f"word{i}" for i in range(60)], 12))
        if chance.random() < (0.8 if toxic else 0.05):
            words.append("muslims")
        if toxic and chance.random() < 0.8:
            words.append("scum")
        texts.append(" ".join(words))
        labels.append(int(toxic))
    known = toxicity._Features()
    return [np.array(sorted(known.of(t)), "<i4") for t in texts], np.array(labels)


def test_swapped_names_change_little():
    rows, labels = examples()
    plain, fair = (toxicity.fit(rows, labels, fairness=f).scorer() for f in (0.0, toxicity.FAIRNESS))
    swap = [abs(score("we are muslims here") - score("we are christians here")) for score in (plain, fair)]
    assert swap[1] < 0.35 * swap[0]
    assert fair("we are muslims here") < plain("we are muslims here")
    assert fair("you are scum") >= toxicity.THRESHOLD


def test_toxicity_edges(spark):
    docs = spark.createDataFrame(
        [(1, "a b", "x"), (2, None, "x"), (None, "idiot", "x"), (2, "", "x"), (4, "w " * 50000, "x")], "doc_id long, text string, score string"
    )
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, none)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 5 and all(r["score"] == 0.0 and r["predicted"] == 0 for r in rows)
    one = toxicity.learn(docs, spark.createDataFrame([(1, 1), (4, None), (None, 0)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, one).collect()} == {1.0}
    assert toxicity.score(docs.where("false"), model).count() == 0
    assert toxicity.keep_harmless(docs, model).columns == docs.columns


def test_pipeline_stages_work_on_what_is_left(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.dtypes == docs.dtypes
        docs = spark.createDataFrame(kept.toPandas(), kept.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    assert set(last["doc_id"]) == {r["doc_id"] for r in docs.collect()}
    assert last.groupby("sequence_id")["length"].sum().max() <= 2048
    whole = corpus_pipeline.run(spark, folder).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[key].to_numpy().tolist())) == sorted(map(tuple, last[key].to_numpy().tolist()))
