"""How two tokenizers cut the same texts: groups of tokens that end together, and how often each pair does.

Both encodings of a text spell the same bytes.  Offsets at which a token of each ends cut the tokens
into groups, and the two tokens that end there are linked.  The distinct linked pairs of ids get a
minimal perfect hash; every task adds up its links in one dense vector indexed by that hash, vectors are
summed in a tree, and a second pass aligns the documents again and looks the counts up, with the pair
itself kept beside each count to tell whether it is known.

Two linked tokens end at the same byte, so one's bytes end with all of the other's.  The pairs are hence at
most as many as two vocabularies have of that kind (``most_pairs``; 324,299 for the public byte-level and piece
vocabularies), whatever the corpus: hash, keys and counts are of bounded size, and are broadcast.

Encoded documents are written once, as 16-bit or 32-bit ids, and both passes read them.

Defined cases: null and empty texts, and those whose tokens do not spell a blank and the text, have no
tokens: zeros and an empty digest.  Repeated rows count as documents of their own; null ids stay; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.tokens import forget, piece_encoder, ragged, slices, stretch_encoder, texts_of
from clientele.sources.scratch import discard, materialise

#: Counts in one piece of a vector, and vectors summed by one task of the tree.
PIECE, FAN = 1 << 16, 16
#: Stretches each of the two encoders of a worker keeps.
REMEMBERED = 300_000

_BYTES_AT_ONCE = 1_500_000


@functools.lru_cache(maxsize=2)
def byte_level_tokens(path: str) -> tuple[bytes, ...]:
    """The bytes of every id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    value = {chr(b): b for b in shown} | {chr(256 + at): b for at, b in enumerate(hidden)}
    pieces = {at: piece for piece, at in given["model"]["vocab"].items()}
    special = {token["id"]: token["content"].encode() for token in given.get("added_tokens", [])}
    size = max([*pieces, *special]) + 1
    return tuple(special[at] if at in special else bytes(value[c] for c in pieces.get(at, "")) for at in range(size))


@functools.lru_cache(maxsize=2)
def piece_tokens(path: str) -> tuple[bytes, ...]:
    """The bytes of every id of a piece model."""
    model = piece_encoder(path, REMEMBERED).model
    return tuple(
        bytes([int(model.id_to_piece(at)[3:-1], 16)]) if model.is_byte(at)
        else b"" if model.is_control(at) or model.is_unknown(at)
        else model.id_to_piece(at).replace("▁", " ").encode()
        for at in range(model.get_piece_size())
    )


def most_pairs(one: tuple[bytes, ...], two: tuple[bytes, ...]) -> int:
    """Pairs of ids of which one's bytes end with the other's: no others can be linked."""
    ones, twos = Counter(filter(None, one)), Counter(filter(None, two))
    longer = sum(n * ones[b[at:]] for b, n in twos.items() for at in range(len(b)))
    return longer + sum(n * twos[a[at:]] for a, n in ones.items() for at in range(1, len(a)))


class Spelling:
    """The bytes of ids, end to end."""

    def __init__(self, tokens: tuple[bytes, ...]) -> None:
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self._starts = np.cumsum(self.sizes) - self.sizes
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def text(self, ids: np.ndarray) -> np.ndarray:
        return self._bytes[ragged(self._starts[ids], self.sizes[ids])]


def _spelled(spelling: Spelling, ids: np.ndarray, starts: np.ndarray, want: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which texts the ids spell: the bytes of all texts are end to end in ``want``."""
    total = np.r_[0, np.cumsum(spelling.sizes[ids])]
    size, given = np.diff(total[starts]), np.diff(ends)
    right = size == given
    if right.all():
        wrong = np.flatnonzero(spelling.text(ids) != want)
        right[np.searchsorted(ends, wrong, "right") - 1] = False
        return right
    for at in np.flatnonzero(right).tolist():
        right[at] = np.array_equal(spelling.text(ids[starts[at] : starts[at + 1]]), want[ends[at] : ends[at + 1]])
    return right


def _encoded(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """``(doc_id, a, b)``: ids of each document under both, empty where they do not spell it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = stretch_encoder(byte_level, True, " ", True, REMEMBERED), piece_encoder(pieces, REMEMBERED)
        tokens = byte_level_tokens(byte_level), piece_tokens(pieces)
        spellings = [Spelling(t) for t in tokens]
        for batch in slices(batches, "text", _BYTES_AT_ONCE):
            texts = texts_of(batch)
            given = [b" " + text.encode() for text in texts]
            ends = np.cumsum([0, *map(len, given)])
            want = np.frombuffer(b"".join(given), np.uint8)
            right = np.array([len(text) > 0 for text in texts])
            coded = [encoder.flat(texts) for encoder in (one, two)]
            for spelling, (ids, starts) in zip(spellings, coded, strict=True):
                right &= _spelled(spelling, ids, starts, want, ends)
            columns = [batch.column("doc_id")]
            for own, (ids, starts) in zip(tokens, coded, strict=True):
                kind = _kind(own)
                joined, at = ids.astype(kind).tobytes(), (np.dtype(kind).itemsize * starts).tolist()
                columns.append(pa.array([joined[x:y] if ok else b"" for x, y, ok in zip(at, at[1:], right.tolist(), strict=False)], pa.binary()))
            yield pa.record_batch(columns, names=["doc_id", "a", "b"])

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id bigint, a binary, b binary")


def _kind(tokens: tuple[bytes, ...]) -> str:
    return "<u2" if len(tokens) <= 1 << 16 else "<u4"


class Aligned:
    """Groups and links of a batch of encoded documents."""

    def __init__(self, batch: pa.RecordBatch, kinds: tuple[str, str], sizes: tuple[np.ndarray, np.ndarray]) -> None:
        self.doc_id = batch.column("doc_id") if "doc_id" in batch.schema.names else None
        sides = []
        for name, kind, size in zip("ab", kinds, sizes, strict=True):
            column = batch.column(name)
            lengths = np.array([len(x) for x in column.to_pylist()], np.int64) // np.dtype(kind).itemsize
            ids = np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64)
            sides.append((ids, np.r_[0, np.cumsum(lengths)], np.cumsum(size[ids])))
        (self.a, self.a_starts, a_ends), (self.b, self.b_starts, b_ends) = sides
        # Documents spell the same bytes on both sides, so ends may be compared across all of them.
        marks = np.zeros(int(a_ends[-1]) + 1 if len(a_ends) else 1, np.int8)
        marks[a_ends] += 1
        marks[b_ends] += 2
        self.a_last, self.b_last = marks[a_ends] == 3, marks[b_ends] == 3
        self.pairs = (self.a[self.a_last] << 32) | self.b[self.b_last]
        self.link_starts = np.r_[0, np.cumsum(self.a_last)][self.a_starts]

    def per_document(self, of_link: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(of_link)][self.link_starts])

    def groups(self, shown: "Shown") -> list[bytes]:
        """The groups of each document as text, without a last semicolon."""
        a_group, b_group = (np.r_[0, np.cumsum(last)][:-1] for last in (self.a_last, self.b_last))
        n = len(self.pairs)
        a_before, b_before = (np.r_[0, np.cumsum(np.bincount(g, minlength=n))] for g in (a_group, b_group))
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + b_before[a_group]] = shown.first(self.a, self.a_last)
        codes[np.arange(len(self.b)) + a_before[b_group + 1]] = shown.second(self.b, self.b_last)
        starts = (self.a_starts + self.b_starts).tolist()
        return [shown.text(codes[x:y])[:-1] for x, y in zip(starts, starts[1:], strict=False)]


class Shown:
    """Ids in decimal with the mark that follows them."""

    def __init__(self, ids: int) -> None:
        self._ids = ids
        width = len(str(ids)) + 1
        self._texts = np.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(ids)], f"S{width}")

    def first(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        return ids + np.where(last, self._ids, 0)

    def second(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        return ids + np.where(last, 2 * self._ids, 0)

    def text(self, codes: np.ndarray) -> bytes:
        return self._texts[codes].tobytes().translate(None, b"\0")


def _mixed(values: np.ndarray, level: int) -> np.ndarray:
    values = values + np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % (1 << 64))
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys: on every level, keys that have a bit to themselves keep it.

    ``keys`` holds the key of each number, so that a key that was not given is told.
    """

    def __init__(self, keys: np.ndarray) -> None:
        left = np.unique(keys.astype(np.int64)).view(np.uint64)
        self._levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        total = 0
        while len(left):
            width = 64 * (-(-2 * len(left) // 64))
            place = (_mixed(left, len(self._levels)) % np.uint64(width)).astype(np.int64)
            alone = np.bincount(place, minlength=width) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            counts = np.bitwise_count(words).astype(np.int64)
            self._levels.append((width, words, total + np.cumsum(counts) - counts))
            total += int(counts.sum())
            left = left[~alone[place]]
        self.keys = np.zeros(total, np.int64)
        every = np.unique(keys.astype(np.int64))
        self.keys[self._number(every)] = every

    def _number(self, keys: np.ndarray) -> np.ndarray:
        found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (width, words, before) in enumerate(self._levels):
            place = _mixed(keys[left].view(np.uint64), level) % np.uint64(width)
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            held = words[word]
            own = (held >> bit) & np.uint64(1) == 1
            below = held & ((np.uint64(1) << bit) - np.uint64(1))
            found[left[own]] = before[word[own]] + np.bitwise_count(below[own])
            left = left[~own]
            if not len(left):
                break
        return found

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1 for one that was not given."""
        found = self._number(keys)
        known = (found >= 0) & (self.keys[found] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        return np.where(known, found, -1)


def _distinct_pairs(encoded: DataFrame, align) -> DataFrame:
    """The distinct linked pairs, once per task that meets them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        met = np.zeros(0, np.int64)
        for aligned in align(batches):
            new = np.setdiff1d(aligned.pairs, met)
            met = np.union1d(met, new)
            yield pa.record_batch([pa.array(new)], names=["pair"])

    return encoded.select("a", "b").mapInArrow(run, "pair bigint").distinct()


def _vectors(encoded: DataFrame, align, hashed) -> DataFrame:
    """``(part, piece, counts)``: one dense vector per task, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(hashed.value.keys)
        counts = np.zeros(size, np.int64)
        for aligned in align(batches):
            counts += np.bincount(hashed.value.numbers(aligned.pairs), minlength=size)
        starts = range(0, size, PIECE)
        part = TaskContext.get().partitionId()
        yield pa.record_batch(
            [pa.array([part] * len(starts), pa.int32()), pa.array(range(len(starts)), pa.int32()),
             pa.array([counts[at : at + PIECE].astype("<i8").tobytes() for at in starts], pa.binary())],
            names=["part", "piece", "counts"],
        )

    return encoded.select("a", "b").mapInArrow(run, "part int, piece int, counts binary")


def tree_sum(vectors: DataFrame) -> np.ndarray:
    """Sum vectors piece by piece, so many at once, until one of each piece is left."""

    def add(batches: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in batches.column("counts").to_pylist())
        return pa.table(
            [batches.column("part").slice(0, 1), batches.column("piece").slice(0, 1), pa.array([total.astype("<i8").tobytes()], pa.binary())],
            names=["part", "piece", "counts"],
        )

    left = (vectors.agg(F.max("part").alias("m")).first()["m"] or 0) + 1
    while left > 1:
        above = vectors.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part", "piece")
        vectors = materialise(above.applyInArrow(add, "part int, piece int, counts binary"), "sums")
        left = -(-left // FAN)
    rows = vectors.orderBy("piece").select("counts").collect()  # as many counts as there are pairs
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], "<i8") for r in rows)])


class _Counted:
    """Encoded documents, and the counts of their linked pairs by the number of the pair."""

    def __init__(self, docs: DataFrame, byte_level: str, pieces: str) -> None:
        one, two = byte_level_tokens(byte_level), piece_tokens(pieces)
        kinds = _kind(one), _kind(two)
        sizes = tuple(np.array([len(t) for t in tokens], np.int64) for tokens in (one, two))

        def align(batches: Iterator[pa.RecordBatch]) -> Iterator[Aligned]:
            for batch in slices(batches, "a", _BYTES_AT_ONCE // 2):
                yield Aligned(batch, kinds, sizes)

        self.align, self.ids = align, (len(one), len(two))
        self.encoded = materialise(_encoded(docs, byte_level, pieces), "encoded")
        pairs = _distinct_pairs(self.encoded, align).toPandas()["pair"].to_numpy(np.int64)
        if len(pairs) > most_pairs(one, two):
            raise AssertionError("more pairs than the vocabularies have")
        self.hashed = docs.sparkSession.sparkContext.broadcast(PerfectHash(pairs))
        vectors = materialise(_vectors(self.encoded, align, self.hashed), "vectors")
        self.counts = tree_sum(vectors)
        discard(vectors)


_RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align_documents(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Per document: tokens of both, groups, links, how many have their piece id's highest count, and the sum of counts.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.  ``byte_level`` is a tokenizers
    file, ``pieces`` a sentencepiece model.
    """
    counted = _Counted(docs, byte_level, pieces)
    align, hashed, counts = counted.align, counted.hashed, counted.counts
    second = hashed.value.keys & 0xFFFFFFFF
    best = np.zeros(counted.ids[1], np.int64)
    np.maximum.at(best, second, counts)
    known = docs.sparkSession.sparkContext.broadcast((counts, counts == best[second]))
    ids = max(counted.ids)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        count, top = known.value
        shown = Shown(ids)
        for aligned in align(batches):
            at = hashed.value.numbers(aligned.pairs)
            links = np.diff(aligned.link_starts)
            columns = [
                np.diff(aligned.a_starts), np.diff(aligned.b_starts), links, links,
                aligned.per_document(top[at]), aligned.per_document(count[at]),
            ]
            digests = [hashlib.sha256(text).hexdigest() if text else "" for text in aligned.groups(shown)]
            yield pa.record_batch(
                [aligned.doc_id, *(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string())],
                names=["doc_id", *_RESULT, "groups_sha256"],
            )

    schema = "doc_id bigint, " + ", ".join(f"{name} bigint" for name in _RESULT) + ", groups_sha256 string"
    return counted.encoded.mapInArrow(look_up, schema)


def pair_counts(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """``(a, b, n)``: how many links of the documents hold each pair of ids; at most ``most_pairs`` rows."""
    counted = _Counted(docs, byte_level, pieces)
    keys = counted.hashed.value.keys
    return docs.sparkSession.createDataFrame(
        pa.table([keys >> 32, keys & 0xFFFFFFFF, counted.counts], names=["a", "b", "n"])
    )
