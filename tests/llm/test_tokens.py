"""Encoding, token files and packing against the tokenizers library and plain recomputation."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clientele.llm import bpe, packing, token_store, tokens
from clientele.llm.tokens import StretchEncoder
from clientele.sources.scratch import materialise, scratch_path

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "  ", "\n", "'s", "'", "<|endoftext|>", "é", "é", "́", "Σ", " ", "\x1c", "12",
         "漢", "🙂", "!", "\t", "The", "İ", "ß", "<|startoftext|>", " a", "aaaaaaa", "word, "]


def odd_texts(count: int) -> list[str]:
    chance = random.Random(4)
    return ["".join(chance.choice(PARTS) for _ in range(chance.randint(0, 14))) for _ in range(count)]


def expected(path: str, texts: list[str]) -> list[bytes]:
    found = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    return [np.array(x.ids, "<u4").tobytes() for x in found]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(5, "one two  three\nfour"), (3, None), (3, "again"), (None, "no id"), (9, ""), (9, ""), (7, "x " * 9000), (1, "zz top, " * 40)]
    return spark.createDataFrame(
        [(d, t, "x", i, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, ids string, row int, _group int"
    ).repartition(3)


@pytest.mark.parametrize(("path", "blank"), [(BYTE, True), (WORD, False)])
def test_stretches_encode_like_whole_texts(path, blank):
    texts = odd_texts(4000)
    assert StretchEncoder(path, blank).encode(texts) == expected(path, texts)


def test_numpy_merges_equal_the_library():
    texts = [*odd_texts(4000), "ab" * 3000, " " * 50]
    coder = bpe.NumpyBpe(BYTE)
    ids = coder.encode(texts)
    assert ids == expected(BYTE, texts)
    back = Tokenizer.from_file(BYTE).decode_batch([np.frombuffer(i, "<u4").tolist() for i in ids], skip_special_tokens=False)
    assert [coder.decode(i) for i in ids] == back


def test_bytes_that_are_no_text_decode_to_the_replacement_character():
    coder = bpe.NumpyBpe(BYTE)
    half = coder.encode(["漢"])[0][:4]
    assert "�" in coder.decode(half)


def test_encoded_documents_keep_every_row(spark, docs):
    rows = bpe.encode_documents(docs, BYTE).collect()
    assert sorted((r["doc_id"] or -1, r["decoded"]) for r in rows) == sorted(
        (r["doc_id"] or -1, r["text"] or "") for r in docs.collect()
    )
    assert bpe.encode_documents(docs.where("false"), BYTE).count() == 0


def test_token_store_round_trip(spark, docs):
    folder = scratch_path(spark, "store")
    manifest = token_store.write_store(docs, folder, BYTE, end_id=2, shards=3)
    rows = sorted(token_store.read_store(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    given = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    ids = [np.append(np.frombuffer(i, "<u4"), 2).astype("<u4") for i in expected(BYTE, [t for _, t in given])]
    assert [(r["doc_id"], r["ids"]) for r in rows] == [(d, i.tolist()) for (d, _), i in zip(given, ids, strict=True)]
    assert [r["start"] for r in rows] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(i.tobytes()) for i in ids]
    assert [r["n_tokens"] for r in rows] == [len(i) for i in ids]
    assert sum(s["documents"] for s in manifest["shards"]) == len(given)
    assert sorted(r.doc_id for r in token_store.fetch(folder, [3, 7])) == [3, 3, 7]


def test_token_store_refuses_another_dictionary(spark, docs):
    folder = scratch_path(spark, "store")
    manifest = token_store.write_store(docs, folder, BYTE, end_id=2, shards=2)
    with pytest.raises(ValueError, match="dictionary"):
        token_store.Shard(folder, manifest["shards"][0]["file"], b"another")


def test_empty_token_store(spark, docs):
    folder = scratch_path(spark, "store")
    token_store.write_store(docs.where("false"), folder, BYTE, end_id=2)
    assert token_store.read_store(spark, folder).count() == 0


def test_sum_of_squares_by_brute_force():
    chance = np.random.default_rng(3)
    for capacity in (7, 20):
        lengths = chance.integers(1, capacity + 1, 60)
        sequence, offset = packing.place(lengths, capacity)
        gaps: dict[int, int] = {}
        for item in np.argsort(-lengths, kind="stable").tolist():
            size, of = int(lengths[item]), int(sequence[item])
            fitting = {g for g in gaps.values() if g >= size}

            def squares(changed):
                found = np.bincount([g for g in changed.values() if g], minlength=capacity + 1)
                return int((found**2).sum())

            best = min((squares({**gaps, next(b for b, g in gaps.items() if g == f): f - size}) for f in fitting), default=None)
            assert (of in gaps) == bool(fitting)
            assert int(offset[item]) == capacity - gaps.get(of, capacity)
            gaps[of] = gaps.get(of, capacity) - size
            assert gaps[of] >= 0
            assert best is None or squares(gaps) == best
        assert len(gaps) <= int(np.ceil(lengths.sum() / capacity)) * 1.25 + 1


def test_packed_documents(spark, docs):
    parts = materialise(packing.pieces(docs, WORD, 0, 100, with_ids=True), "pieces")
    packed = materialise(packing.pack(parts, 100, group_pieces=40), "packed")
    rows = packed.toPandas()
    assert len(rows) == parts.count()
    for _, one in rows.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert one["offset"].tolist() == [0, *one["length"].cumsum().tolist()[:-1]]
        assert one["length"].sum() <= 100
    whole = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(packed, parts, 100).collect()}
    assert whole == rows.groupby("sequence_id")["length"].sum().to_dict()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] in (1, 5, 7)}
    for doc, text in texts.items():
        ids = expected(WORD, [text])[0] + bytes(4)
        mine = rows[rows["doc_id"] == doc].sort_values("piece")
        assert mine["start"].tolist() == list(range(0, len(ids) // 4, 100))
        assert mine["ids_crc32"].tolist() == [zlib.crc32(ids[4 * s : 4 * s + 400]) for s in mine["start"]]
    assert packing.pack_documents(docs.where("false"), WORD, 0).count() == 0


def test_pieces_are_the_same_however_little_a_worker_remembers(spark, docs, monkeypatch):
    """Packing has its own, smaller memory; results do not depend on it."""
    assert packing.REMEMBERED < tokens.REMEMBERED

    def rows():
        return sorted(map(tuple, packing.pieces(docs, WORD, 0, 100).drop("row").collect()), key=str)

    want = rows()
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    monkeypatch.setattr(packing, "BATCH_CHARACTERS", 500)
    assert rows() == want
