"""Near-duplicate documents: a fingerprint trie proposes, exact Jaccard similarity of word shingles decides.

Majority fingerprints of the shingles meet in the binary trie of ``simhash``, and its links are verified: they
tie most copies together at little cost.  Fingerprints alone would miss pairs at the edge, so an exact join
completes them: two sets as similar as asked for share a token among the first few of each (their prefixes) in any
order of all tokens, so documents meet on prefix tokens and no pair is lost.  Tokens that many documents
of a sample hold come last in that order, which keeps them out of most prefixes; the sample decides
the speed alone.

Pairs that sizes and places rule out are left out, and so are those whose bitmaps differ too much: every set
has a bitmap with a bit for the hash of each token, and bits that only one of two bitmaps has count at most the
tokens that only one set has.  Texts travel only for the pairs that are left, which are hardly more than the true ones.

Documents with equal sets count once.  Holders of a token are first compared with the smallest of
them, then with others in turn; tokens whose holders that has tied together need no further pairs, so a large
group of copies is not squared.  What is still apart after the turns meets in all pairs.

Defined cases: words are runs of anything but ASCII white space, lower-cased as UTF-8 text; texts of
fewer words than a shingle are one token; null and wordless texts are one group.  Repeated rows and
ids, and rows without an id, are rows of their own; an empty table gives an empty result; columns of
any name stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.passages import WordHashes, shingles
from clientele.llm.simhash import BUDGET, trie_links
from clientele.llm.tokens import forget, slices, texts_of
from clientele.operators.components import components
from clientele.operators.keyed import free_name
from clientele.sources.scratch import discard, materialise

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Documents of the sample, how many of them make a token common, and common tokens at most.
SAMPLE, COMMON, COMMON_MOST = 20_000, 8, 1 << 16

#: How often every holder of a token meets one of them, before all pairs of the rest meet; fewer turns are
#: taken if those pairs are at most so many times the rows that share a token.
TURNS, MEETINGS = 8, 0.25

_SLACK = 1e-9
_HOLDER = ("row", "size", "place", "root")


def shingle_set(text: str, known: WordHashes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct tokens of a whole text."""
    found = shingles(text, known, words)
    if not len(found):
        parts = text.lower().encode().split()
        found = np.array([xxhash.xxh64_intdigest(b" ".join(parts))] if parts else [], np.uint64)
    return np.unique(found)


def _common(numbered: DataFrame, words: int) -> np.ndarray:
    """Tokens that many sampled documents hold, most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = WordHashes()
        for batch in slices(batches, "text"):
            for text in texts_of(batch):
                yield pa.record_batch([pa.array(shingle_set(text, known, words).view(np.int64))], names=["token"])

    share = min(1.0, SAMPLE / max(1, numbered.count()))
    sampled = numbered.select("text").sample(share, 1).mapInArrow(run, "token bigint")
    counted = sampled.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    rows = counted.orderBy(F.desc("n"), "token").limit(COMMON_MOST).collect()
    return np.array([r["token"] for r in reversed(rows)], np.int64).view(np.uint64)


def majority(tokens: np.ndarray) -> int:
    """The bits that more than half of the tokens set, as a signed number."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(tokens), 1 << 16):
        bits = np.unpackbits(tokens[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(tokens), bitorder="little").view("<i8")[0])


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bit for the hash of each token, at least two bits a token; the width is a power of two of at least 64."""
    width = max(64, 1 << int(2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    bits = np.zeros(width, np.uint8)
    bits[(tokens >> np.uint64(7)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def least_difference(one: np.ndarray, two: np.ndarray) -> int:
    """At least so many tokens are in only one of the sets; the wider bitmap is folded to the width of the other."""
    while len(one) > len(two):
        one = one[: len(one) // 2] | one[len(one) // 2 :]
    while len(two) > len(one):
        two = two[: len(two) // 2] | two[len(two) // 2 :]
    return int(np.bitwise_count(one ^ two).sum())


_SET = "row bigint, digest bigint, size int, fp bigint, bits binary, prefix array<bigint>"


def _sets(numbered: DataFrame, common: np.ndarray, similarity: float, words: int) -> DataFrame:
    """Of each set its digest, size, fingerprint and bitmap, and its first tokens in the common order."""
    by_value = np.argsort(common)
    ordered = common[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = WordHashes()
        for batch in slices(batches, "text"):
            digests, sizes, marks, bits, prefixes = [], [], [], [], []
            for text in texts_of(batch):
                found = shingle_set(text, known, words)
                digests.append(xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63))
                sizes.append(len(found))
                marks.append(majority(found))
                bits.append(bitmap(found).tobytes())
                if len(ordered):
                    at = np.minimum(np.searchsorted(ordered, found), len(ordered) - 1)
                    late = np.where(ordered[at] == found, by_value[at] + 1, 0)
                    found = found[np.argsort(late, kind="stable")]
                first = len(found) - int(np.ceil(similarity * len(found) - _SLACK)) + 1
                prefixes.append(found[: first if len(found) else 0].view(np.int64))
            flat = np.concatenate(prefixes)
            ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
            yield pa.record_batch(
                [batch.column("row"), pa.array(digests, pa.int64()), pa.array(sizes, pa.int32()), pa.array(marks, pa.int64()),
                 pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["row", "digest", "size", "fp", "bits", "prefix"],
            )

    return numbered.select("row", "text").mapInArrow(run, _SET)


def _may_reach(one: str, two: str, similarity: float):
    """Whether sizes and places of a shared token leave room for the similarity."""
    a, b = F.col(f"{one}size"), F.col(f"{two}size")
    rest = F.least(a - F.col(f"{one}place"), b - F.col(f"{two}place"))
    share = similarity / (1 + similarity)
    return (F.least(a, b) >= similarity * F.greatest(a, b) - _SLACK) & (rest >= share * (a + b) - _SLACK)


def _close(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs that bitmaps leave possible; ``marks`` holds size and bitmap of each row."""
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("size", "bits", "low_size", "low_bits")]
            kept = [
                least_difference(np.frombuffer(bits, "<u8"), np.frombuffer(low_bits, "<u8")) <= share * (size + low_size) + _SLACK
                for size, bits, low_size, low_bits in zip(*columns, strict=True)
            ]
            yield batch.select(["high", "low"]).filter(pa.array(kept, pa.bool_()))

    both = pairs.join(marks.withColumnRenamed("row", "high"), "high").join(
        marks.select(F.col("row").alias("low"), F.col("size").alias("low_size"), F.col("bits").alias("low_bits")), "low"
    )
    return both.select("high", "low", "size", "bits", "low_size", "low_bits").mapInArrow(run, "high bigint, low bigint")


def _verified(pairs: DataFrame, marks: DataFrame, numbered: DataFrame, similarity: float, words: int) -> DataFrame:
    """``(high, low)``: those of the pairs whose texts are similar enough, as a written table."""
    close = materialise(_close(pairs, marks, similarity), "close")
    rows = materialise(close.select(F.explode(F.array("high", "low")).alias("row")).distinct(), "rows")
    texts = materialise(numbered.select("row", "text").join(rows, "row", "left_semi"), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = WordHashes()
        last_text, last = None, np.zeros(0, np.uint64)
        for batch in (piece for whole in batches for piece in slices(iter([whole]), "text")):
            kept = []
            for text, low_text in zip(texts_of(batch), texts_of(batch, "low_text"), strict=True):
                if low_text != last_text:  # rows of one document mostly follow each other
                    last_text, last = low_text, shingle_set(low_text, known, words)
                mine = shingle_set(text, known, words)
                shared = len(np.intersect1d(mine, last, assume_unique=True))
                kept.append(shared >= similarity * (len(mine) + len(last) - shared) - _SLACK)
            yield batch.select(["high", "low"]).filter(pa.array(kept, pa.bool_()))

    both = close.join(texts.withColumnRenamed("row", "high"), "high").join(
        texts.select(F.col("row").alias("low"), F.col("text").alias("low_text")), "low"
    )
    found = materialise(both.select("high", "low", "text", "low_text").mapInArrow(run, "high bigint, low bigint"), "links")
    for table in (close, rows, texts):
        discard(table)
    return found


def _proposed(single: DataFrame, budget: int) -> DataFrame:
    """Pairs of documents whose fingerprints the trie ties; of those with one fingerprint each with the smallest."""
    of = materialise(single.select("row", "fp"), "fingerprints")
    least = materialise(of.groupBy("fp").agg(F.min("row").alias("least")), "least")
    equal = of.join(least, "fp").where(F.col("row") > F.col("least")).select(F.col("row").alias("high"), F.col("least").alias("low"))
    links = trie_links(least.select("fp"), budget).distinct()
    named = links.join(least.select(F.col("fp").alias("high"), F.col("least").alias("one")), "high").join(
        least.select(F.col("fp").alias("low"), F.col("least").alias("two")), "low"
    )
    found = materialise(equal.unionByName(named.select(*_ordered("one", "two"))), "proposed")
    discard(of)
    discard(least)
    return found


def _ordered(one: str, two: str):
    return F.greatest(one, two).alias("high"), F.least(one, two).alias("low")


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the smallest row that links reach, itself if none."""
    roots = components(links).select(F.col("high").alias("row"), F.col("low").alias("root"))
    return rows.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))


def _apart(rooted: DataFrame) -> DataFrame:
    """The rows of tokens whose holders are not one group yet."""
    tokens = rooted.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("token")
    return rooted.join(materialise(tokens, "apart"), "token", "left_semi")


def _meetings(holders: DataFrame) -> float:
    """Pairs of holders of one token from different groups."""
    per_group = holders.groupBy("token", "root").agg(F.count("*").cast("double").alias("n"))
    per_token = per_group.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    return per_token.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()[0] or 0.0


def _told_apart(holders: DataFrame) -> DataFrame:
    """Tokens that the same rows hold become one, at the smallest of their places: it lets no fewer pairs meet.

    Tokens whose holders only hash alike become one as well, which loses no pair either.
    """
    own = F.xxhash64("row")
    same = holders.groupBy("token").agg(
        F.xxhash64(F.count("*"), F.bit_xor(own), F.bit_xor(F.xxhash64(own))).alias("held")
    )
    named = holders.join(materialise(same, "held"), "token")
    return named.groupBy(F.col("held").alias("token"), "row", "size", "root").agg(F.min("place").alias("place"))


def _not_compared(pairs: DataFrame, compared: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The pairs that no turn has compared, as a written table, and all that are compared with them."""
    if compared is not None:
        pairs = pairs.join(compared, ["high", "low"], "left_anti")
    pairs = materialise(pairs, "pairs")
    return pairs, pairs if compared is None else compared.unionByName(pairs)


def groups(
    numbered: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS, budget: int = BUDGET
) -> DataFrame:
    """``(row, root)`` for every ``row``: the smallest row that pairs of similar texts reach.

    ``numbered`` is a written table ``(row, text)`` with unique rows.
    """
    sets = materialise(_sets(numbered, _common(numbered, words), similarity, words), "sets")
    members = materialise(sets.select("row", "digest"), "members")
    distinct = materialise(members.groupBy("digest").agg(F.min("row").alias("least")), "distinct")
    single = materialise(sets.join(distinct.select(F.col("least").alias("row")), "row", "left_semi").drop("digest"), "single")
    discard(sets)
    marks = single.select("row", "size", "bits")
    proposed = _proposed(single, budget)
    tied = _verified(proposed, marks, numbered, similarity, words)
    discard(proposed)

    postings = single.select("row", "size", F.posexplode("prefix").alias("place", "token"))
    beside = Window.partitionBy("token").orderBy("size", "row")
    shared = postings.withColumns({"_before": F.lag("row").over(beside), "_after": F.lead("row").over(beside)})
    shared = materialise(
        shared.where(F.col("_before").isNotNull() | F.col("_after").isNotNull()).select("token", "row", "size", "place"), "shared"
    )

    # First every holder of a token with one of them, where they are still apart.  That one is done with then: it has
    # met all others, so it leaves the token, and the next turn takes another.
    open_ = materialise(_apart(materialise(_rooted(shared, tied), "rooted")), "open")
    compared, most = None, MEETINGS * shared.count()
    spent = [shared, tied]
    for turn in range(TURNS):
        order = F.xxhash64("row", F.lit(turn)) if turn else F.col("size")
        head = open_.groupBy("token").agg(F.min(F.struct(order.alias("order"), "row", "size", "place", "root")).alias("head"))
        with_head = open_.join(materialise(head, "heads"), "token").where(F.col("row") != F.col("head.row"))
        met = materialise(
            with_head.select("token", "row", "size", "place", "root", *[F.col(f"head.{n}").alias(f"head_{n}") for n in _HOLDER]), "met"
        )
        possible = met.where((F.col("root") != F.col("head_root")) & _may_reach("", "head_", similarity))
        pairs, compared = _not_compared(possible.select(*_ordered("row", "head_row")).distinct(), compared)
        found = _verified(pairs, marks, numbered, similarity, words)
        tied = materialise(tied.unionByName(found), "tied")
        rooted = materialise(_rooted(met.select("token", "row", "size", "place"), tied), "rooted")
        spent += [open_, met, pairs, found, tied, rooted]
        open_ = materialise(_apart(rooted) if turn else _told_apart(_apart(rooted)), "open")
        if _meetings(open_) <= most:
            break

    # Then all pairs of different groups among the holders of tokens that are still apart.
    others = open_.select("token", *[F.col(n).alias(f"other_{n}") for n in _HOLDER])
    met = open_.join(others, "token").where(
        (F.col("row") < F.col("other_row")) & (F.col("root") != F.col("other_root")) & _may_reach("", "other_", similarity)
    )
    rest, _ = _not_compared(met.select(*_ordered("row", "other_row")).distinct(), compared)
    more = _verified(rest, marks, numbered, similarity, words)
    ends = components(tied.unionByName(more)).select(F.col("high").alias("least"), F.col("low").alias("root"))
    found = materialise(
        members.join(distinct, "digest").join(ends, "least", "left").select("row", F.coalesce("root", "least").alias("root")),
        "groups",
    )
    for table in (members, distinct, single, *spent, open_, compared, rest, more):
        discard(table)
    return found


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each group: the smallest id, of repeats of an id any one; columns stay as they are.

    A group of null ids alone keeps one row as well.
    """
    number = free_name(docs, "_row")
    numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(number).alias("row"), F.col("text").cast("string").alias("text"))
    found = groups(texts, similarity, words)
    members = found.join(numbered.select(F.col(number).alias("row"), F.col("doc_id").alias("_id")), "row")
    order = F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("row").alias("c"))
    kept = members.groupBy("root").agg(F.min(order).alias("_first")).select(F.col("_first.c").alias(number))
    return numbered.join(kept, number, "left_semi").select(*docs.columns)
