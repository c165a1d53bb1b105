"""Byte-level byte-pair encoding and decoding by batched numpy merge rounds.

The words of many texts are encoded together.  Their symbols stand in one flat array; a round looks
up the rank of every neighbouring pair by binary search over the sorted pair keys, finds the lowest
rank of each word, and merges that pair wherever it stands in the word, from the left.  Rounds go on
until no word holds a pair with a rank.  A worker keeps the words it has met, so a round only sees
words that are new.

Defined cases: null counts as empty and gives no ids; repeated rows give repeated results; an empty
table gives an empty result; extra columns stay out of the result.  Texts of special tokens become
their ids, as the tokenizers library does, and decode to their texts.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.tokens import slices, texts_of

# The public byte-level pattern that parts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words a worker remembers; beyond it the memory starts anew, results stay the same.
REMEMBERED = 400_000

_NO_RANK = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, all others for characters from 256 on.
    """
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class NumpyBpe:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary: dict[str, int] = content["model"]["vocab"]
        characters = byte_characters()
        self._byte_ids = np.array([vocabulary[c] for c in characters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in content["model"]["merges"]]
        self._size = max(vocabulary.values()) + 1
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        keys = left * self._size + right
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self._merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self._special = {t["content"]: t["id"] for t in content["added_tokens"]}
        back = {c: b for b, c in enumerate(characters)}
        self._bytes: dict[int, bytes] = {i: bytes(map(back.__getitem__, t)) for t, i in vocabulary.items() if t not in self._special}
        self._bytes |= {i: t.encode() for t, i in self._special.items()}
        special = "|".join(regex.escape(t) for t in sorted(self._special, key=len, reverse=True))
        self._cut = regex.compile(f"({special})") if special else None
        self._words = regex.compile(WORDS)
        self._known: dict[str, bytes] = {}

    def merge(self, words: Sequence[str]) -> list[bytes]:
        """The ids of each non-empty word, little-endian unsigned 32-bit."""
        encoded = [word.encode() for word in words]
        sizes = np.array([len(b) for b in encoded], np.int64)
        symbols = self._byte_ids[np.frombuffer(b"".join(encoded), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        while len(symbols):
            ranks = self._pair_ranks(symbols, word)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(ranks, starts)
            per_symbol = np.repeat(lowest, np.diff(np.r_[starts, len(word)]))
            settled = per_symbol == _NO_RANK
            done_symbols.append(symbols[settled])
            done_words.append(word[settled])
            at = self._leftmost(np.flatnonzero((ranks == per_symbol) & ~settled))
            symbols[at] = self._merged[ranks[at]]
            keep = ~settled
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        flat = np.concatenate(done_symbols) if done_symbols else symbols
        owner = np.concatenate(done_words) if done_words else word
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(len(words)), "right") * 4
        data, first, out = flat[order].astype("<u4").tobytes(), 0, []
        for end in ends.tolist():
            out.append(data[first:end])
            first = end
        return out

    def _pair_ranks(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each symbol; pairs across words have none."""
        ranks = np.full(len(symbols), _NO_RANK, np.int64)
        wanted = symbols[:-1] * self._size + symbols[1:]
        at = np.minimum(np.searchsorted(self._keys, wanted), len(self._keys) - 1)
        hit = np.flatnonzero((self._keys[at] == wanted) & (word[:-1] == word[1:]))
        ranks[hit] = self._ranks[at[hit]]
        return ranks

    @staticmethod
    def _leftmost(at: np.ndarray) -> np.ndarray:
        """Of overlapping occurrences, as in a run of one symbol, every second from the left."""
        if not len(at):
            return at
        first = np.r_[True, np.diff(at) != 1]
        run = np.flatnonzero(first)
        inside = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        return at[inside % 2 == 0]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        if len(self._known) > REMEMBERED:
            self._known.clear()
        split = [self._parts(text) for text in texts]
        fresh = list({w for words in split for w in words if w.__class__ is str}.difference(self._known))
        self._known.update(zip(fresh, self.merge(fresh), strict=True))
        known = self._known
        return [b"".join([known[w] if w.__class__ is str else w for w in words]) for words in split]

    def _parts(self, text: str) -> list[str | bytes]:
        """The words of a text, and the ids of special tokens between them."""
        if self._cut is None or not any(t in text for t in self._special):
            return self._words.findall(text)
        parts: list[str | bytes] = []
        for piece in self._cut.split(text):
            if piece in self._special:
                parts.append(np.uint32(self._special[piece]).astype("<u4").tobytes())
            else:
                parts += self._words.findall(piece)
        return parts

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


@functools.lru_cache(maxsize=2)
def numpy_bpe(path: str) -> NumpyBpe:
    """The coder of this worker, with the words it has met in earlier tasks."""
    return NumpyBpe(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids, decoded)``: ids as little-endian unsigned 32-bit binary, and their decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = numpy_bpe(path)
        for batch in slices(batches, "text"):
            ids = coder.encode(texts_of(batch))
            decoded = [coder.decode(x) for x in ids]
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, ids binary, decoded string")
