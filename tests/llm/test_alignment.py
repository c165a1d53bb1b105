"""Token alignment against the two libraries and a plain loop."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from clientele.llm import alignment
from clientele.llm.tokens import PieceEncoder, StretchEncoder

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", " a", "a ", "don't stop", "<|endoftext|> x <s> </s>", "x<|endoftext|>", "tab\tnew\nline  two",
    "0 10 2.5 ", "ﬁ é é İ,", "中国 🙂 👩🏽", "a▁b", "▁ a b", "\x00 \x07", "w " * 400, "Straße, straße. STRASSE!",
]


def odd_texts(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    letters = "abcXYZ 0059 \n\t éßñİ́ﬁ①中国🙂👩🏽 .,!'\"-_  ▁​\x00  "
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(50))) for _ in range(n)]


@pytest.mark.parametrize("file,blank,before,plain", [
    ("byte_bpe_50k.json", True, "", False), ("word_bpe_49k.json", False, "", False), ("byte_bpe_50k.json", True, " ", True),
])
def test_stretches_equal_the_library(file, blank, before, plain):
    library = Tokenizer.from_file(public_tokenizers.path(file))
    library.encode_special_tokens = plain
    encoder = StretchEncoder(public_tokenizers.path(file), blank, before, plain)
    for texts in (ODD, odd_texts(400, 1), ODD + odd_texts(100, 1), []):
        want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch([before + t for t in texts], add_special_tokens=False)]
        assert encoder.encode(texts) == want


def test_pieces_equal_the_library():
    encoder = PieceEncoder(PIECE)
    for texts in (ODD, odd_texts(400, 2), ODD):
        assert encoder.encode(texts) == [np.array(x, "<u4").tobytes() for x in encoder.model.encode(texts)]


def plain(texts):
    """Counts and results by the definition."""
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    one, two = alignment.byte_level_tokens(BYTE), alignment.piece_tokens(PIECE)
    every = []
    for text in texts:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or b"".join(one[i] for i in a) != want or b"".join(two[i] for i in b) != want:
            a, b = [], []
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((one, a), (two, b))]
        both = sorted(set(ends[0]) & set(ends[1]))
        parts, last, links = [], 0, []
        for end in both:
            mine = [i for i, e in zip(a, ends[0]) if last < e <= end]
            theirs = [i for i, e in zip(b, ends[1]) if last < e <= end]
            parts.append(",".join(map(str, mine)) + "|" + ",".join(map(str, theirs)))
            links.append((mine[-1], theirs[-1]))
            last = end
        every.append((len(a), len(b), parts, links))
    count = Counter(link for row in every for link in row[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return count, [
        (n_a, n_b, len(parts), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
         hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else "")
        for n_a, n_b, parts, links in every
    ]


def test_documents(spark):
    texts = [*ODD, None, *odd_texts(120, 3), "the same words again", "the same words again"]
    rows = [(at if at % 7 else None, text, "x", at) for at, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a string, pair int").repartition(5)
    got = alignment.align_documents(docs, BYTE, PIECE).collect()
    count, want = plain(texts)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(
        (at if at % 7 else -1, *w) for at, w in enumerate(want)
    )
    pairs = {(r["a"], r["b"]): r["n"] for r in alignment.pair_counts(docs, BYTE, PIECE).collect()}
    assert pairs == dict(count)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(docs, BYTE, PIECE).collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in alignment.align_documents(only, BYTE, PIECE).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_perfect_hash():
    rnd = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rnd.integers(-(1 << 62), 1 << 62, n))
        hashed = alignment.PerfectHash(keys)
        assert sorted(hashed.numbers(keys).tolist()) == list(range(len(keys)))
        assert (hashed.numbers(np.setdiff1d(rnd.integers(0, 1 << 62, 1000), keys)) == -1).all()


def test_pairs_are_bounded_by_the_vocabularies():
    assert alignment.most_pairs((b"ab", b"b", b""), (b"b", b"cab", b"b")) == 2 + 2 + 1 + 1  # ab-b twice, b-b twice, ab-cab, b-cab
    assert 250_000 < alignment.most_pairs(alignment.byte_level_tokens(BYTE), alignment.piece_tokens(PIECE)) < 400_000


def test_tree_sum(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)
    rows = [(part, piece, np.full(3, part + piece, "<i8").tobytes()) for part in range(5) for piece in range(2)]
    vectors = spark.createDataFrame(rows, "part int, piece int, counts binary")
    assert alignment.tree_sum(vectors).tolist() == [10] * 3 + [15] * 3
