"""Near-duplicate passages across documents by compact windows.

Words are runs of anything but ASCII white space, lower-cased; the tokens of a text are its five-word
shingles.  For each of several hash functions, a compact window (l, c, r) stands for all subsequences
between l and r that hold c: the token at c has the smallest hash of them all.  Windows come from the
Cartesian tree over the hashes; only those long enough to hold a passage are kept, about two per
passage length.  Subsequences of two documents share a signature when they lie in windows of the
same hash value.

Windows of one value are tied to the one of the earliest document, first inside a batch of
documents and then across batches, so that a value that a third of all documents share sends one row
per batch.  Windows that no verified passage covers after that are tied once more, to further holders
of their value that also agree in the smallest hash of another function beside the centre: so holders
of a line that many texts share meet those that share more than the line.  The window pairs of two documents are joined by interval: where the windows of enough hash
functions overlap in both, the passage is a candidate, and both texts are compared there: stretches of a
passage's length, aligned up to the shift that inserted words cause, count as near-duplicates when the
similarity of their shingles, repeats included, is high enough.  An exactly repeated passage shares its smallest hash under every function.

What is found in a document is what an earlier document holds too: the first holder keeps it.

Defined cases: null and short texts hold no passage; repeats inside one document do not count, nor do
those between rows with one id; null ids count as one id after all others.  An empty table gives an
empty result; extra columns are ignored, or kept where documents are returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.tokens import forget, slices, texts_of
from clientele.operators.components import components
from clientele.operators.keyed import free_name
from clientele.sources.scratch import discard, materialise

SHINGLE_WORDS, PASSAGE_WORDS, SIMILARITY = 5, 50, 0.8
#: Hash functions, and how many of them have to meet.
HASHES, ENOUGH, SEED = 5, 2, 3

_LAST = (1 << 63) - 1
_PLACE_BITS = 30  # a text of at most 2 GB holds fewer words
_EXTENT = 17
_PLACE = (1 << _PLACE_BITS) - 1
_BATCH_CHARACTERS = 6_000_000
_ROWS = 16_384  # tokens compared with their neighbours at once
_WORD = re.compile(r"[^\x09-\x0d ]+")


class WordHashes(dict):
    """Hashes of words met so far."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def shingles(text: str, known: WordHashes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the word shingles of a whole text; fewer words than a shingle give none."""
    parts = text.lower().encode().split()
    if len(parts) < words:
        return np.zeros(0, np.uint64)
    single = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    count = len(parts) - words + 1
    total = np.zeros(count, np.uint64)
    for at in range(words):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + single[at : at + count])
    return total


def _under(tokens: np.ndarray, function: int) -> np.ndarray:
    """Token hashes under one hash function."""
    return _mixed(tokens + np.uint64((0x632BE59BD9B4E019 * (2 * function + 1)) % (1 << 64)))


def _least(values: np.ndarray, length: int) -> np.ndarray:
    """The smallest of each ``length`` neighbours."""
    width = 1
    while 2 * width <= length:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = length - width
    return np.minimum(values[: len(values) - rest], values[rest:])


def compact_windows(order: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (l, c, r) of at least ``length`` tokens over several texts laid end to end.

    ``order`` holds distinct ranks of the tokens, ``starts`` the first token of each text and the end.
    The smallest token of any ``length`` neighbours is the centre of such a window, and so are its
    nearest smaller tokens on both sides, if there are any: the tree needs the centres alone.
    """
    total = len(order)
    if total < length:
        return (np.zeros(0, np.int64),) * 3
    least = _least(order, length)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = text[: total - length + 1] == text[length - 1 :]
    centres = np.unique((least[inside] & np.uint64(_PLACE)).astype(np.int64))
    return _extents(centres, order[centres], text[centres], starts)


def _extents(
    centres: np.ndarray, ranks: np.ndarray, text: np.ndarray, starts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walk the Cartesian tree of each text along its right spine: nearest smaller centres on both sides."""
    left, right = starts[text].copy(), starts[text + 1] - 1
    spine: list[int] = []
    last = -1
    for at, (place, rank, of) in enumerate(zip(centres.tolist(), ranks.tolist(), text.tolist(), strict=True)):
        if of != last:
            spine, last = [], of
        while spine and spine[-1][1] > rank:
            right[spine.pop()[0]] = place - 1
        if spine:
            left[at] = spine[-1][2] + 1
        spine.append((at, rank, place))
    return left, centres, right


def _batch_windows(texts: list[str], known: WordHashes, hashes: int, length: int, words: int):
    """For every hash function: value, text, span (centre, left and right extent) and context of the windows of a batch.

    The context holds two times 16 bits: of the smallest hash of the next function left and right of the centre,
    each over half a passage, so that one of both sides lies in a shared passage as a whole.
    """
    half = (length + 1) // 2
    tokens = [shingles(text, known, words) for text in texts]
    for group in _groups([len(t) for t in tokens]):
        starts = np.cumsum([0, *(len(tokens[g]) for g in group)])
        flat = np.concatenate([tokens[g] for g in group]) if group else np.zeros(0, np.uint64)
        places = np.arange(len(flat), dtype=np.uint64)
        high = ~np.uint64(_PLACE)
        following = _under(flat, 0)
        for function in range(hashes):
            value, following = following, _under(flat, (function + 1) % hashes)
            left, centre, right = compact_windows((value & high) | places, starts, length)
            row = np.searchsorted(starts, centre, "right") - 1
            first = starts[row]
            wide = (1 << _EXTENT) - 1
            span = (
                (centre - first)
                | (np.minimum(centre - left, wide) << _PLACE_BITS)
                | (np.minimum(right - centre, wide) << (_PLACE_BITS + _EXTENT))
            )
            context = np.zeros(len(centre), np.uint32)
            if len(centre):
                beside, last = _least(following, half), starts[row + 1] - half
                for shift, begin in ((0, centre - half + 1), (16, centre)):
                    low = beside[np.clip(begin, first, last)] & np.uint64(0xFFFF)
                    context |= low.astype(np.uint32) << np.uint32(shift)
            yield function, value[centre].view(np.int64), np.array(group, np.int64)[row], span, context.view(np.int32)


def _groups(sizes: list[int]) -> Iterator[list[int]]:
    """Texts laid end to end as far as places can number their tokens."""
    group: list[int] = []
    total = 0
    for at, size in enumerate(sizes):
        if group and total + size >= 1 << _PLACE_BITS:
            yield group
            group, total = [], 0
        group.append(at)
        total += size
    if group:
        yield group


def _unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left end, centre and right end of packed windows."""
    wide = (1 << _EXTENT) - 1
    centre = span & _PLACE
    return centre - ((span >> _PLACE_BITS) & wide), centre, centre + ((span >> (_PLACE_BITS + _EXTENT)) & wide)


_WINDOWS = (
    "local boolean, linked boolean, function int, key bigint, value bigint, doc bigint, span bigint, context int,"
    " first_doc bigint, first_span bigint, first_context int"
)


def windows(docs: DataFrame, hashes: int, length: int, words: int) -> DataFrame:
    """Windows of all documents: one per value and batch, and links to it from later documents of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = WordHashes()
        for batch in slices(batches, "text", _BATCH_CHARACTERS):
            ids = batch.column("doc").to_numpy()
            for function, value, row, span, context in _batch_windows(texts_of(batch), known, hashes, length, words):
                doc = ids[row]
                order = np.lexsort((span & _PLACE, doc, value))
                value, doc, span, context = value[order], doc[order], span[order], context[order]
                if not len(value):
                    continue
                head = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
                first = np.repeat(head, np.diff(np.r_[head, len(value)]))
                leads = first == np.arange(len(value))
                kept = leads | (doc != doc[first])  # more of the first document is no link
                linked = np.add.reduceat(kept, head, dtype=np.int64)[np.cumsum(leads) - 1] > 1
                n = int(kept.sum())
                value, doc_kept, span_kept, leads = value[kept], doc[kept], span[kept], leads[kept]
                yield pa.record_batch(
                    [pa.array(~leads), pa.array(linked[kept]), pa.array(np.full(n, function, np.int32)),
                     # Links are dealt by document: they need no meeting any more.
                     pa.array(np.where(leads, value, doc_kept)), pa.array(value, mask=leads),
                     pa.array(doc_kept), pa.array(span_kept), pa.array(context[kept]),
                     pa.array(doc[first][kept], mask=leads), pa.array(span[first][kept], mask=leads),
                     pa.array(context[first][kept], mask=leads)],
                    names=["local", "linked", "function", "key", "value", "doc", "span", "context", "first_doc", "first_span", "first_context"],
                )

    return docs.mapInArrow(run, _WINDOWS)


def _centre(span: str = "span") -> Column:
    return F.col(span).bitwiseAND(F.lit(_PLACE))


def _tied(found: DataFrame) -> DataFrame:
    """Windows of a value, but those of its first holder, each with a window of an earlier holder.

    ``more`` is false where the two are all holders of the value.
    """
    whole = Window.partitionBy("local", "function", "key")
    same = whole.orderBy("doc", _centre())
    return found.select(
        (F.max("linked").over(whole) | (F.count("*").over(whole) > 2)).alias("more"),
        "function", F.coalesce("value", "key").alias("value"), "doc", "span", "context",
        F.coalesce("first_doc", F.first("doc").over(same)).alias("first_doc"),
        F.coalesce("first_span", F.first("span").over(same)).alias("first_span"),
        F.coalesce("first_context", F.first("context").over(same)).alias("first_context"),
    ).where(F.col("doc") != F.col("first_doc"))


def _candidates(tied: DataFrame, enough: int, length: int) -> DataFrame:
    """``(doc, first_doc, offsets)``: documents whose windows meet under enough hash functions, and at which offsets."""
    pairs = tied.groupBy("doc", "first_doc").agg(
        F.collect_list("span").alias("spans"), F.collect_list("first_span").alias("first_spans"),
        F.collect_list("function").alias("functions"),
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(n) for n in ("functions", "spans", "first_spans")]
            cuts = lists[0].offsets.to_numpy().tolist()
            flat = [column.values.to_numpy() for column in lists]
            found, rows = [], []
            for row, (first, last) in enumerate(zip(cuts, cuts[1:], strict=False)):
                offsets = meeting_diagonals(*(x[first:last] for x in flat), enough, length)
                if len(offsets):
                    rows.append(row)
                    found.append(offsets)
            if rows:
                kept = batch.select(["doc", "first_doc"]).take(pa.array(rows))
                yield pa.record_batch(
                    [*kept.columns, pa.array(found, pa.list_(pa.int64()))], names=["doc", "first_doc", "offsets"]
                )

    return pairs.where(F.size(F.array_distinct("functions")) >= enough).mapInArrow(
        meet, "doc bigint, first_doc bigint, offsets array<bigint>"
    )


def _tied_again(tied: DataFrame, found: DataFrame, words: int) -> DataFrame:
    """Further ties of windows that no verified span covers: to holders that agree in a context, too.

    Each is tied to the last such open window and to the last covered one, so the rows stay in proportion to the
    windows however many texts share a value.
    """
    spans = found.groupBy("doc").agg(merged(F.flatten(F.collect_list("spans"))).alias("spans"))
    covered = F.exists("spans", lambda s: (s["first"] <= _centre()) & (_centre() < s["last"] - (words - 1)))
    sides = F.array(F.col("context").bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned("context", 16) + F.lit(1 << 16))
    left_open = ~F.coalesce(covered, F.lit(False))
    # A pair that holds a value alone has been compared.
    holders = materialise(
        tied.where("more").join(spans, "doc", "left").withColumn("open", left_open).drop("spans", "more"), "holders"
    )
    # The first holder of an open window was compared with its followers alone, which may have met others.
    heads = holders.where("open").select(
        "function", "value", F.col("first_doc").alias("doc"), F.col("first_span").alias("span"), F.col("first_context").alias("context")
    ).distinct().join(spans, "doc", "left").withColumn("open", left_open)
    columns = ["function", "value", "doc", "span", "context", "open"]
    marked = holders.select(*columns).unionByName(heads.select(*columns)).withColumn(
        "side", F.explode(F.array_distinct(sides))
    ).drop("context")
    key = ["function", "value", "side"]
    marked = materialise(marked, "marked")
    discard(holders)
    met = marked.groupBy(*key).agg(F.min("doc").alias("_low"), F.max("doc").alias("_high"), F.max("open").alias("_any"))
    keys = materialise(met.where("_any and _low < _high").select(*key), "contexts")
    again = materialise(marked.join(keys, key, "left_semi"), "open_windows")
    discard(marked)
    discard(keys)
    place = F.struct("doc", _centre().alias("centre"), "span")
    heads = materialise(
        again.groupBy(*key).agg(
            F.max(F.when(F.col("open"), place)).alias("one"), F.max(F.when(~F.col("open"), place)).alias("two")
        ).select(*key, F.explode(F.array_compact(F.array("one", "two"))).alias("head")),
        "heads",
    )
    other, own = F.struct(F.col("head.doc").alias("doc"), F.col("head.span").alias("span")), F.struct("doc", "span")
    low, high = F.least(own, other), F.greatest(own, other)
    return again.where("open").join(heads, key).where(F.col("doc") != F.col("head.doc")).select(
        "function", high["doc"].alias("doc"), high["span"].alias("span"),
        low["doc"].alias("first_doc"), low["span"].alias("first_span"),
    ).distinct()


def meeting_diagonals(
    functions: np.ndarray, spans: np.ndarray, first_spans: np.ndarray, enough: int, length: int
) -> np.ndarray:
    """Interval join of the window pairs of two documents: offsets at which enough functions meet.

    Two pairs meet when some subsequence of ``length`` tokens lies in both windows, in each document.
    """
    one, two = _unpack(spans), _unpack(first_spans)
    order = np.lexsort((functions, one[1]))
    functions, one, two = functions[order], [x[order] for x in one], [x[order] for x in two]
    offsets = two[1] - one[1]
    met = np.zeros((len(functions), int(functions.max()) + 1), bool)
    met[np.arange(len(functions)), functions] = True
    for step in range(1, len(functions)):
        near = one[1][step:] - one[1][:-step] < length  # a subsequence holds both centres
        if not near.any():
            break
        a = np.flatnonzero(near)
        b = a + step
        joint = np.ones(len(a), bool)
        for left, centre, right in (one, two):
            low, high = np.maximum(left[a], left[b]), np.minimum(right[a], right[b])
            joint &= (low <= np.minimum(centre[a], centre[b])) & (np.maximum(centre[a], centre[b]) <= high)
            joint &= high - low + 1 >= length
        a, b = a[joint], b[joint]
        met[a, functions[b]] = True
        met[b, functions[a]] = True
    return np.unique(offsets[met.sum(axis=1) >= enough])


def _among(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which tokens of the one stand in the other."""
    if not len(two):
        return np.zeros(len(one), bool)
    ordered = np.sort(two)
    return ordered[np.minimum(np.searchsorted(ordered, one), len(two) - 1)] == one


def _reaches(match: np.ndarray, length: int, needed: int) -> np.ndarray:
    """Where stretches of ``length`` that hold so many matches begin; empty if there is none."""
    sums = np.r_[0, np.cumsum(match)]
    return np.flatnonzero(sums[length:] - sums[:-length] >= needed)


def _runs(match: np.ndarray, length: int, needed: int) -> list[tuple[int, int]]:
    """Where stretches of ``length`` hold so many matches, joined where they overlap."""
    good = _reaches(match, length, needed)
    if not len(good):
        return []
    cover = np.zeros(len(match) + 1, np.int64)
    np.add.at(cover, good, 1)
    np.add.at(cover, good + length, -1)
    edges = np.flatnonzero(np.diff(np.r_[False, np.cumsum(cover[:-1]) > 0, False]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _nearest(one: np.ndarray, two: np.ndarray, begin: int, end: int, offset: int, reach: int) -> np.ndarray:
    """For the tokens ``begin`` to ``end`` of the one: the place in the other, nearest to the offset, that holds the same; or -1."""
    shifts = np.array(sorted(range(-reach, reach + 1), key=abs))
    out = np.full(end - begin, -1)
    for first in range(begin, end, _ROWS):
        place = np.arange(first, min(first + _ROWS, end))[:, None] + (offset + shifts)
        inside = (place >= 0) & (place < len(two))
        equal = inside & (two[np.where(inside, place, 0)] == one[first : first + len(place), None])
        best = equal.argmax(axis=1)
        rows = np.arange(len(place))
        out[first - begin : first - begin + len(place)] = np.where(equal[rows, best], place[rows, best], -1)
    return out


def shared_spans(one: np.ndarray, two: np.ndarray, offsets: np.ndarray, length: int, similarity: float) -> list[tuple[int, int]]:
    """Token spans of ``one`` that stand, near enough, at one of the offsets in ``two`` as well.

    A stretch of ``length`` tokens of either text counts when so many of them match that the similarity to as
    long a stretch of the other, matches over all, is reached.  Words put in or left out shift what follows, by no
    more places than a stretch may have of its own at that similarity; matches on all those neighbouring
    diagonals count.  Spans begin and end with a match.
    """
    needed = int(np.ceil(2 * length * similarity / (1 + similarity) - 1e-9))
    reach = int(np.ceil(length * (1 - similarity)))
    # Stretches lie where enough tokens stand anywhere in the other text; most candidates have none.
    mine, theirs = _runs(_among(one, two), length, needed), _runs(_among(two, one), length, needed)
    if not mine and not theirs:
        return []
    covered = np.zeros(len(one) + 1, np.int64)
    possible = (mine, theirs)
    seen: tuple[set, set] = (set(), set())
    for offset in offsets.tolist():
        lows = [first for first, _ in mine[:1]] + [first - offset - reach for first, _ in theirs[:1]]
        highs = [last for _, last in mine[-1:]] + [last - offset + reach for _, last in theirs[-1:]]
        begin = max(0, -offset - reach, min(lows))
        end = min(len(one), len(two) - offset + reach, max(highs))
        if end - begin < length - reach:
            continue
        match = _nearest(one, two, begin, end, offset, reach) >= 0
        start = max(0, begin + offset - reach)
        partner = _nearest(two, one, start, max(start, min(len(two), end + offset + reach)), -offset, reach)
        partner[(partner < begin) | (partner >= end)] = -1
        found = _runs(match, length, needed), _runs(partner >= 0, length, needed)
        for first, last in found[0]:
            hits = np.flatnonzero(match[first:last]) + begin + first
            covered[hits[0]] += 1
            covered[hits[-1] + 1] -= 1
        for first, last in found[1]:
            hits = partner[first:last]
            hits = hits[hits >= 0]
            covered[hits.min()] += 1
            covered[hits.max() + 1] -= 1
        for known, runs, at in zip(seen, found, (begin, start), strict=True):
            known.update((first + at, last + at) for first, last in runs)
        if all(known.issuperset(runs) for known, runs in zip(seen, possible, strict=True)):
            break  # all that any offset can give
    edges = np.flatnonzero(np.diff(np.r_[False, np.cumsum(covered[:-1]) > 0, False]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _known_doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST))


def duplicated_passages(
    docs: DataFrame, similarity: float = SIMILARITY, passage_words: int = PASSAGE_WORDS,
    hashes: int = HASHES, enough: int = ENOUGH, words: int = SHINGLE_WORDS,
) -> DataFrame:
    """``(doc, digest, first_doc, spans)``: word spans of a document that an earlier one holds too.

    ``doc`` is the id, or the largest number for null; ``digest`` is the XXH64 of the text and tells
    rows with one id apart; ``spans`` are half-open word places.
    """
    length = passage_words - words + 1
    source = docs.select(_known_doc().alias("doc"), F.col("text").cast("string").alias("text"))
    tied = materialise(_tied(windows(source, hashes, length, words)), "tied")
    pairs = materialise(_candidates(tied, enough, length), "candidates")
    found = materialise(_verified(source, pairs, similarity, length, words), "passages")
    # Pairs not compared yet, with all that ties them, now or before.
    pair = ["doc", "first_doc"]
    again = _tied_again(tied, found, words).join(pairs.select(*pair), pair, "left_anti")
    again = materialise(again, "tied_again")
    before = tied.select(*again.columns).join(again.select(*pair).distinct(), pair, "left_semi")
    more = materialise(_candidates(again.unionByName(before), enough, length), "candidates")
    discard(tied)
    return found.unionByName(_verified(source, more, similarity, length, words))


def _verified(source: DataFrame, pairs: DataFrame, similarity: float, length: int, words: int) -> DataFrame:
    """The candidate pairs whose texts share a passage, with its spans in ``doc``."""
    involved = pairs.select("doc").unionByName(pairs.select(F.col("first_doc").alias("doc"))).distinct()
    texts = materialise(
        source.join(involved, "doc", "left_semi").withColumn("digest", F.xxhash64("text")), "texts"
    )
    both = pairs.join(texts, "doc").join(
        texts.select(F.col("doc").alias("first_doc"), F.col("text").alias("first_text")), "first_doc"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = WordHashes()
        last_text, last = None, np.zeros(0, np.uint64)
        for whole in batches:
            for batch in slices(iter([whole]), "text"):
                rows = []
                for row in range(batch.num_rows):
                    text, first_text = batch.column("text")[row].as_py() or "", batch.column("first_text")[row].as_py() or ""
                    if text == first_text:  # a copy: it has windows, so it holds a passage
                        spans = [(0, len(text.encode().split()) - words + 1)]
                    else:
                        offsets = batch.column("offsets")[row].values.to_numpy()
                        if first_text != last_text:  # rows of one first document mostly follow each other
                            last_text, last = first_text, shingles(first_text, known, words)
                        spans = shared_spans(shingles(text, known, words), last, offsets, length, similarity)
                    if spans:
                        rows.append(
                            {n: batch.column(n)[row].as_py() for n in ("doc", "digest", "first_doc")}
                            | {"spans": [{"first": a, "last": b + words - 1} for a, b in spans]}
                        )
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _FOUND)

    columns = ["doc", "digest", "first_doc", "offsets", "text", "first_text"]
    return both.select(*columns).mapInArrow(
        verify, "doc bigint, digest bigint, first_doc bigint, spans array<struct<first:int,last:int>>"
    )


_FOUND = pa.schema(
    [("doc", pa.int64()), ("digest", pa.int64()), ("first_doc", pa.int64()),
     ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]
)


def merged(spans: Column) -> Column:
    """Join spans that overlap or touch, in order."""
    ordered = F.sort_array(spans)
    start = F.array().cast("array<struct<first:int,last:int>>")

    def add(done, span):
        last = F.element_at(done, -1)
        grown = F.struct(last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last"))
        return F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= span["first"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown)),
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(ordered, start, add)


def _per_document(found: DataFrame) -> DataFrame:
    """All spans of a document, and the earlier documents they stand in."""
    return found.groupBy("doc", "digest").agg(
        F.flatten(F.collect_list("spans")).alias("_all"), F.sort_array(F.collect_set("first_doc")).alias("sources")
    ).select("doc", "digest", merged(F.col("_all")).alias("spans"), "sources")


def passage_classes(docs: DataFrame, **parameters) -> DataFrame:
    """One row per document: its duplicated spans, where they stand first, and its class.

    Returns ``(doc_id, n_words, spans, n_duplicate_words, sources, component_id)``; the class is the
    smallest id that shared passages reach.
    """
    found = materialise(duplicated_passages(docs, **parameters), "passages")
    ties = found.select(F.col("doc").alias("high"), F.col("first_doc").alias("low")).distinct()
    groups = components(ties).select(F.col("high").alias("doc"), F.col("low").alias("_root"))
    placed = materialise(_per_document(found), "spans")
    rows = docs.select(
        F.col("doc_id").cast("bigint"), _known_doc().alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("digest"),
        F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x09-\x0d ]+"), lambda w: w != "")).alias("n_words"),
    )
    none = F.array().cast("array<struct<first:int,last:int>>")
    return rows.join(placed, ["doc", "digest"], "left").join(groups, "doc", "left").select(
        "doc_id", "n_words", F.coalesce("spans", none).alias("spans"),
        F.aggregate(F.coalesce("spans", none), F.lit(0), lambda n, s: n + s["last"] - s["first"]).alias("n_duplicate_words"),
        F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"),
        F.when(F.col("_root").isNotNull(), F.col("_root")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; white space before a cut word goes with it."""
    out, last = [], 0
    edges = iter(sorted(spans))
    first, end = next(edges, (None, None))
    for place, word in enumerate(_WORD.finditer(text)):
        while first is not None and place >= end:
            first, end = next(edges, (None, None))
        if first is not None and first <= place:
            last = word.end()
            continue
        out.append(text[last : word.end()])
        last = word.end()
    return "".join(out) + text[last:]


def without_repeats(docs: DataFrame, **parameters) -> DataFrame:
    """The documents without the passages an earlier one holds; columns stay as they are.

    ``n_chars``, if there is one, follows the text.  A document of which nothing is left goes.
    """
    spans = materialise(_per_document(duplicated_passages(docs, **parameters)).drop("sources"), "spans")
    doc, digest, cuts = (free_name(docs, name) for name in ("_doc", "_digest", "_spans"))
    marked = docs.withColumns({doc: _known_doc(), digest: F.xxhash64(F.col("text").cast("string"))}).join(
        spans.select(F.col("doc").alias(doc), F.col("digest").alias(digest), F.col("spans").alias(cuts)), [doc, digest], "left"
    )

    @F.pandas_udf("string")
    def cut_texts(texts, found):
        return texts.combine(found, lambda t, s: cut(t, [(x["first"], x["last"]) for x in s]))

    touched = marked.where(F.col(cuts).isNotNull()).withColumn("text", cut_texts("text", cuts))
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    left = touched.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return marked.where(F.col(cuts).isNull()).unionByName(left).select(*docs.columns)
