"""Encoding of whole texts by public vocabularies, each distinct stretch of text once per worker.

No vocabulary used here joins characters across a blank that stands between two characters
that are no white space: the blank always opens a new word.  A text may therefore be cut at
these blanks, and each stretch encoded alone, or many new ones at once as a text of their own.  Stretches
repeat, texts rarely do, so a worker numbers the stretches it meets and keeps their ids end to end in one
array; the ids of a batch of texts are gathered from it.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stretches a worker remembers; beyond it only those met more than once stay, results stay the same.
REMEMBERED = 700_000

#: New stretches encoded as one text, parted by a stretch that is one id; those that hold it are encoded alone.
_TOGETHER, _PART = 50, "0"
#: Marks that open a word of their own after a letter.
_MARKS = ".,;:!?"
#: What a piece model writes for a blank; in a text it is a character that pieces may join to any other.
_BLANK = "\u2581"
_CUT = re.compile(r"(?<=\S) (?=\S)")


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i] ... starts[i] + sizes[i] - 1`` of all i, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def with_end(ids: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put ``end_id`` after every text."""
    return np.insert(ids, starts[1:], end_id), starts + np.arange(len(starts))


class _Stretches:
    """Ids of whole texts from the ids of their stretches, of which at most about ``remembered`` are kept."""

    def __init__(self, remembered: int = REMEMBERED) -> None:
        self._remembered = remembered
        self._number: dict[str, int] = {}
        self._starts = np.zeros(1, np.int64)  # of the ids of each stretch, and the end
        self._ids = np.zeros(1 << 16, np.uint32)
        self._met = np.zeros(0, np.int32)  # how many batches met each stretch

    def _count(self, numbers: np.ndarray) -> None:
        """Count a meeting of each of these stretches."""
        if len(self._met) < len(self._number):
            self._met = np.concatenate([self._met, np.zeros(len(self._number), np.int32)])
        np.add.at(self._met, numbers, 1)

    def _forget(self) -> None:
        """Keep the stretches met more than once, half of what is remembered at most; the rest has to be learned again."""
        self._count(np.zeros(0, np.int64))
        known = len(self._number)
        often = np.argsort(-self._met[:known], kind="stable")[: self._remembered // 2]
        kept = np.zeros(known, bool)
        kept[often[self._met[often] > 1]] = True
        starts, sizes = self._starts[:known][kept], np.diff(self._starts[: known + 1])[kept]
        ids = self._ids[ragged(starts, sizes)]
        self._number = {stretch: at for at, stretch in enumerate(compress(self._number, kept.tolist()))}
        self._starts = np.r_[0, np.cumsum(sizes)]
        self._ids[: len(ids)] = ids
        self._met = np.ones(len(sizes), np.int32)

    def _heads(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, end to end, and their number for stretches that open a text."""
        raise NotImplementedError

    def _fresh(self, stretches: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for stretches after a blank."""
        raise NotImplementedError

    def _whole(self, texts: Sequence[str]) -> list[int]:
        """Texts that may not be cut at every blank between two other characters."""
        return []

    def _learn(self, stretches: Sequence[str]) -> None:
        self._add(stretches, *self._fresh(stretches))

    def _add(self, stretches: Sequence[str], ids: np.ndarray, counts: np.ndarray) -> None:
        known = len(self._number)
        self._number.update(zip(stretches, range(known, known + len(stretches)), strict=True))
        end = self._put(ids)
        self._starts = np.concatenate([self._starts[: known + 1], self._starts[known] + np.cumsum(counts)])
        assert self._starts[-1] == end

    def _put(self, ids: np.ndarray) -> int:
        """Write ids after those of all stretches; they last if the starts say so."""
        first = int(self._starts[-1])
        if first + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(max(len(self._ids), len(ids)), np.uint32)])
        self._ids[first : first + len(ids)] = ids
        return first + len(ids)

    def flat(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, unsigned 32-bit, and where each text begins, with the end."""
        if len(self._number) > self._remembered:
            self._forget()
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        begin = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.dictionary_encode()
        where = coded.indices.to_numpy()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.array([self._number.get(p, -1) for p in distinct], np.int64)
        missing = np.flatnonzero(number < 0).tolist()
        # A cut must stand between two characters that are no white space.
        new = [at for at in missing if distinct[at] and distinct[at] == distinct[at].strip()]
        if new:
            self._learn([distinct[at] for at in new])
            number[new] = [self._number[distinct[at]] for at in new]
        self._count(number[number >= 0])
        number = number[where]
        heads = [text[: text.find(" ")] if " " in text else text for text in texts]
        whole = number >= 0
        whole[begin[:-1]] = [head[-1:].strip() != "" for head in heads]
        odd = np.flatnonzero(np.logical_and.reduceat(whole, begin[:-1]) == 0).tolist()
        odd = sorted({*odd, *self._whole(texts)})
        if odd:
            number, begin = self._odd(texts, number, begin, heads, odd)
        ids, counts = self._heads(heads)
        self._put(ids)
        starts, sizes = self._starts[number], self._starts[number + 1] - self._starts[number]
        first = begin[:-1]
        starts[first], sizes[first] = self._starts[-1] + np.cumsum(counts) - counts, counts
        ends = np.r_[0, np.cumsum(sizes)]
        return self._ids[ragged(starts, sizes)], ends[begin]

    def _cut(self, text: str) -> list[str]:
        """A text at all blanks where a cut may stand."""
        return _CUT.split(text)

    def _odd(self, texts, number, begin, heads, odd):
        """Texts with other white space beside a blank are cut where a cut may stand, and nowhere else."""
        cut = {at: self._cut(texts[at]) for at in odd}
        new = {p for parts in cut.values() for p in parts[1:]}.difference(self._number)
        if new:
            self._learn(list(new))
        rows, last = [], 0
        sizes = np.diff(begin)
        for at, parts in cut.items():
            heads[at] = parts[0]
            rows.append(number[last : begin[at]])
            rows.append(np.array([-1, *map(self._number.__getitem__, parts[1:])], np.int64))
            last, sizes[at] = begin[at + 1], len(parts)
        rows.append(number[last:])
        return np.concatenate(rows), np.r_[0, np.cumsum(sizes)]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, starts = self.flat(texts)
        joined, at = ids.astype("<u4").tobytes(), (4 * starts).tolist()
        return [joined[a:b] for a, b in zip(at, at[1:], strict=False)]


class StretchEncoder(_Stretches):
    """Encodes as ``encode(text, add_special_tokens=False)`` of the tokenizers library.

    ``leading_blank`` tells that the vocabulary keeps a blank as part of the word after it; ``before`` is put
    before every text.  With ``plain`` the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, leading_blank: bool, before: str = "", plain: bool = False, remembered: int = REMEMBERED) -> None:
        super().__init__(remembered)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        if plain:
            self._tokenizer.encode_special_tokens = True
        self._prefix, self._before = " " if leading_blank else "", before
        pieces = self._tokenizer.get_vocab(with_added_tokens=True)
        self._edge = np.zeros(max(pieces.values()) + 1, bool)  # ids that begin with a blank, or end a word
        for piece, at in pieces.items():
            self._edge[at] = piece.startswith("\u0120") if leading_blank else piece.endswith("</w>")
        (self._part,) = self._tokenizer.encode(self._prefix + _PART, add_special_tokens=False).ids

    def _heads(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._tokenizer.encode_batch_fast([self._before + text for text in texts], add_special_tokens=False)
        rows = [x.ids for x in found]
        return np.array([i for ids in rows for i in ids], np.uint32), np.array([len(ids) for ids in rows], np.int64)

    def _learn(self, stretches: Sequence[str]) -> None:
        """Marks after a word are encoded once, the word itself with or without them too."""
        plain: dict[str, None] = {}
        ended = []
        for stretch in stretches:
            core = stretch.rstrip(_MARKS)
            if core != stretch and core[-1:].lower().isalpha():
                ended.append((stretch, core))
                if core not in self._number:
                    plain[core] = None
            else:
                plain[stretch] = None
        super()._learn(list(plain))
        if not ended:
            return
        core = np.array([self._number[c] for _, c in ended])
        self._count(core)
        tails = [stretch[len(c) :] for stretch, c in ended]
        marks = {tail: at for at, tail in enumerate(dict.fromkeys(tails))}
        found = [np.array(x.ids, np.uint32) for x in self._tokenizer.encode_batch_fast(list(marks), add_special_tokens=False)]
        mark = np.array([marks[tail] for tail in tails])
        lengths = np.array([len(ids) for ids in found])
        both = np.stack([self._starts[core + 1] - self._starts[core], lengths[mark]], 1)
        first = int(self._starts[-1])
        self._put(np.concatenate(found))
        starts = np.stack([self._starts[core], first + (np.cumsum(lengths) - lengths)[mark]], 1)
        ids = self._ids[ragged(starts.ravel(), both.ravel())]
        self._add([stretch for stretch, _ in ended], ids, both.sum(axis=1))

    def _fresh(self, stretches: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        if not stretches:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        kind = np.fromiter(map(self._kind, stretches), np.int8, len(stretches))
        order = np.argsort(kind, kind="stable")
        groups = [[stretches[at] for at in order[kind[order] == k].tolist()] for k in range(3)]
        found = [self._marked(groups[0]), self._parted(groups[1]), self._encoded([self._prefix + s for s in groups[2]])]
        ids, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        ends, back = np.cumsum(counts), np.argsort(order)
        return ids[ragged((ends - counts)[back], counts[back])], counts[back]

    def _kind(self, stretch: str) -> int:
        """How to find the ids of a stretch among others: by an edge in the ids, by a part between, or alone."""
        if " " not in stretch if self._prefix else stretch.lower().isalpha():
            return 0
        return 2 if _PART in stretch else 1

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.array(x.ids, np.uint32) for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *rows]), np.array([len(row) for row in rows], np.int64)

    def _together(self, stretches: list[str], between: str, last: str = "") -> np.ndarray:
        groups = [stretches[at : at + _TOGETHER] for at in range(0, len(stretches), _TOGETHER)]
        return self._encoded([self._prefix + between.join(group) + last for group in groups])[0]

    def _marked(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Stretches of one word each, or without a blank, side by side: ids tell where a word begins or ends."""
        ids = self._together(stretches, " ")
        edges = np.flatnonzero(self._edge[ids])
        return ids, np.diff(np.r_[edges, len(ids)] if self._prefix else np.r_[-1, edges])

    def _parted(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat = self._together(stretches, f" {_PART} ", f" {_PART}")
        part = flat == self._part
        return flat[~part], np.diff(np.r_[-1, np.flatnonzero(part)]) - 1


class PieceEncoder(_Stretches):
    """Encodes as ``encode(text)`` of a sentencepiece model none of whose pieces holds a blank after another character."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        super().__init__(remembered)
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def _heads(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = self.model.encode(list(texts), num_threads=1)
        return np.array([i for ids in rows for i in ids], np.uint32), np.array([len(ids) for ids in rows], np.int64)

    _fresh = _heads  # the model puts the blank before a text itself

    def _whole(self, texts: Sequence[str]) -> list[int]:
        return [at for at, text in enumerate(texts) if _BLANK in text]

    def _cut(self, text: str) -> list[str]:
        return [text] if _BLANK in text else super()._cut(text)


@functools.lru_cache(maxsize=2)
def stretch_encoder(
    path: str, leading_blank: bool, before: str = "", plain: bool = False, remembered: int = REMEMBERED
) -> StretchEncoder:
    """The encoder of this worker, with what it has met in earlier tasks."""
    return StretchEncoder(path, leading_blank, before, plain, remembered)


@functools.lru_cache(maxsize=1)
def piece_encoder(path: str, remembered: int = REMEMBERED) -> PieceEncoder:
    return PieceEncoder(path, remembered)


def forget() -> None:
    """Drop the encoders: a worker serves many stages, and what one remembers is memory the next one lacks."""
    stretch_encoder.cache_clear()
    piece_encoder.cache_clear()


def slices(batches: Iterator[pa.RecordBatch], text: str, characters: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches into pieces of about so many bytes of text, so that memory stays bounded."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        first = total = 0
        for row, size in enumerate(sizes):
            if total and total + size > characters:
                yield batch.slice(first, row - first)
                first, total = row, 0
            total += size + 64
        if first < len(sizes):
            yield batch.slice(first)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [text or "" for text in batch.column(name).to_pylist()]
