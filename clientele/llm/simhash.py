"""Near-duplicate documents by 64-bit majority fingerprints and a binary trie self-join.

A fingerprint's bit is set when more than half of the document's word-shingle hashes set it.
Distinct fingerprints are the leaves of a binary trie.  The trie is split by its topmost bits into
blocks, large blocks into chunks, and every two chunks whose prefixes differ in few enough bits meet
in one task, which walks both subtries together, counts differing bits on the way and gives up a
pair of nodes as soon as the count exceeds the budget.  A task returns one link per node
it ties to another, never all pairs of a group; connected components do the rest.

Defined cases: words are runs of anything but ASCII white space; texts of fewer words than a shingle
hash as one sequence; null and wordless texts have fingerprint zero and link like any other.  Repeated
rows each get a row; null ids stay, and count in a component only when it has no other id.  An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.tokens import forget, slices, texts_of
from clientele.operators.components import components
from clientele.operators.ranking import range_partitions
from clientele.sources.scratch import discard, materialise

SHINGLE_WORDS, BUDGET, SEED = 4, 4, 42

#: Expected fingerprints of a chunk; a task holds two chunks.
CHUNK = 1 << 17
#: Fewest prefix bits, so that small tables are spread too.
LEAST_PREFIX = 4

_HASHED_AT_ONCE = 1 << 16
_PAIRS_AT_ONCE = 1 << 19
_DIRECT = 8


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """Majority bits of the shingles' XXH64 as a signed 64-bit number."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = max(1, len(parts) - words + 1)
    firsts, lasts = starts[:last].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    count, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, last, _HASHED_AT_ONCE):
        here = zip(firsts[at : at + _HASHED_AT_ONCE], lasts[at : at + _HASHED_AT_ONCE], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in here], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > last, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)`` of whole texts, one row per input row; ``fp`` is a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, "text"):
            found = [fingerprint(text, words) for text in texts_of(batch)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id bigint, fp bigint")


class Trie:
    """A binary trie over sorted distinct 64-bit numbers, by levels that are built when asked for.

    A node is its number on its level; ``first`` holds the place of its first leaf.
    """

    def __init__(self, leaves: np.ndarray) -> None:
        self.leaves = leaves
        self._first = [np.zeros(1, np.int32)]
        self._children: list[np.ndarray] = []

    def first(self, depth: int) -> np.ndarray:
        while len(self._first) <= depth:
            self._grow()
        return self._first[depth]

    def children(self, depth: int) -> np.ndarray:
        """Two columns: the node below with bit zero and with bit one, or -1."""
        self.first(depth + 1)
        return self._children[depth]

    def sizes(self, depth: int) -> np.ndarray:
        first = self.first(depth)
        return np.diff(np.append(first, np.int32(len(self.leaves))))

    def _grow(self) -> None:
        depth = len(self._first) - 1
        prefix = self.leaves >> np.uint64(63 - depth)
        first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]).astype(np.int32)
        parent = np.searchsorted(self._first[depth], first, "right") - 1
        children = np.full((len(self._first[depth]), 2), -1, np.int32)
        children[parent, (prefix[first] & np.uint64(1)).astype(np.int64)] = np.arange(len(first), dtype=np.int32)
        self._first.append(first)
        self._children.append(children)


def close_pairs(one: Trie, two: Trie | None, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves of two tries, or of one with itself, that differ in at most ``budget`` bits, in batches."""
    other = one if two is None else two
    zero = np.zeros(1, np.int32)
    waiting = [(0, zero, zero, np.zeros(1, np.int8))]
    while waiting:
        depth, a, b, used = waiting.pop()
        many = one.sizes(depth)[a] * other.sizes(depth)[b].astype(np.int64)
        direct = (many <= _DIRECT) if depth < 64 else np.ones(len(a), bool)
        if direct.any():
            yield from _compare(one, other, depth, a[direct], b[direct], budget, two is None)
        a, b, used = a[~direct], b[~direct], used[~direct]
        if not len(a):
            continue
        left, right = one.children(depth)[a], other.children(depth)[b]
        next_a, next_b, next_used = [], [], []
        for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
            here = (left[:, x] >= 0) & (right[:, y] >= 0)
            if x != y:
                here &= used < budget
            if (x, y) == (1, 0) and two is None:
                here &= a != b  # of a node with itself, (zero, one) has been taken
            next_a.append(left[here, x])
            next_b.append(right[here, y])
            next_used.append(used[here] + np.int8(x != y))
        a, b, used = np.concatenate(next_a), np.concatenate(next_b), np.concatenate(next_used)
        for at in range(0, len(a), _PAIRS_AT_ONCE):
            part = slice(at, at + _PAIRS_AT_ONCE)
            waiting.append((depth + 1, a[part], b[part], used[part]))


def _compare(
    one: Trie, other: Trie, depth: int, a: np.ndarray, b: np.ndarray, budget: int, same: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compare all leaves below small pairs of nodes."""
    from_a, from_b = one.first(depth)[a].astype(np.int64), other.first(depth)[b].astype(np.int64)
    size_a, size_b = one.sizes(depth)[a].astype(np.int64), other.sizes(depth)[b].astype(np.int64)
    shapes = size_a * (len(other.leaves) + 1) + size_b
    for shape in np.unique(shapes).tolist():
        rows = np.flatnonzero(shapes == shape)
        n, m = divmod(shape, len(other.leaves) + 1)
        for i in range(n):
            for j in range(m):
                left, right = from_a[rows] + i, from_b[rows] + j
                close = np.bitwise_count(one.leaves[left] ^ other.leaves[right]) <= budget
                if same:
                    close &= left < right
                if close.any():
                    yield left[close], right[close]


def tied(one: np.ndarray, two: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie together what close pairs tie together: each member and the root of its group."""
    trie = Trie(one)
    second = None if two is None else Trie(two)
    leaves = one if two is None else np.concatenate([one, two])
    shift = 0 if two is None else len(one)
    root = np.arange(len(leaves))
    for left, right in close_pairs(trie, second, budget):
        right = right + shift
        while True:
            left, right = root[left], root[right]
            apart = left != right
            if not apart.any():
                break
            left, right = left[apart], right[apart]
            root[np.maximum(left, right)] = np.minimum(left, right)
            while True:  # every node points to its root
                above = root[root]
                if np.array_equal(above, root):
                    break
                root = above
    moved = np.flatnonzero(root != np.arange(len(leaves)))
    return leaves[moved], leaves[root[moved]]


def _prefix(bits: int):
    return F.shiftrightunsigned("fp", 64 - bits)


def _chunk_pairs(sizes: DataFrame, bits: int, budget: int) -> DataFrame:
    """Pairs of chunks whose prefixes differ in at most ``budget`` bits; each unordered pair once."""
    masks = [sum(1 << b for b in c) for n in range(min(budget, bits) + 1) for c in combinations(range(bits), n)]
    near = sizes.select(
        "block", "chunks", F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("mask")
    ).select("block", "chunks", F.col("block").bitwiseXOR(F.col("mask")).alias("other"))
    partners = sizes.select(F.col("block").alias("other"), F.col("chunks").alias("other_chunks"))
    pairs = near.where(F.col("block") <= F.col("other")).join(partners, "other")
    both = pairs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn(
        "other_chunk", F.explode(F.sequence(F.lit(0), F.col("other_chunks") - 1))
    )
    ordered = (F.col("block") < F.col("other")) | (F.col("chunk") <= F.col("other_chunk"))
    return both.where(ordered).select("block", "chunk", "other", "other_chunk")


def trie_links(distinct: DataFrame, budget: int = BUDGET, chunk: int = CHUNK) -> DataFrame:
    """``(high, low)`` links between distinct fingerprints that connect what close pairs connect.

    ``distinct`` is a written table with a column ``fp``.
    """
    rows, bits = distinct.count(), LEAST_PREFIX
    while rows > chunk << bits:
        bits += 1
    blocks = distinct.select("fp", _prefix(bits).alias("block"))
    sizes = materialise(
        blocks.groupBy("block").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), "blocks"
    )
    chunks = materialise(
        blocks.join(sizes, "block")
        .groupBy("block", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("chunk"))
        .agg(F.collect_list("fp").alias("fps")),
        "chunks",
    )
    mine = chunks.withColumnRenamed("fps", "mine")
    theirs = chunks.select(
        F.col("block").alias("other"), F.col("chunk").alias("other_chunk"), F.col("fps").alias("theirs")
    )
    # Dealt anew, so that the few large rows of a small table are walked by all cores.
    pairs = _chunk_pairs(sizes, bits, budget).join(mine, ["block", "chunk"]).join(theirs, ["other", "other_chunk"])
    same = (F.col("block") == F.col("other")) & (F.col("chunk") == F.col("other_chunk"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("mine").alias("fps")),
        F.struct(F.lit(1).alias("side"), F.when(same, F.array().cast("array<bigint>")).otherwise(F.col("theirs")).alias("fps")),
    )
    flat = (
        pairs.repartition(4 * range_partitions(distinct.sparkSession), "block", "chunk", "other", "other_chunk")
        .withColumn("cell", F.monotonically_increasing_id())  # before, not beside, the explode: one per pair
        .select("cell", F.explode(sides).alias("s"))
        .select("cell", "s.side", F.explode("s.fps").alias("fp"))
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches):
            one, two = (np.sort(cell["fp"][cell["side"] == side].view(np.uint64)) for side in (0, 1))
            high, low = tied(one, two if len(two) else None, budget)
            if len(high):
                high, low = high.view(np.int64), low.view(np.int64)
                yield pa.record_batch([np.maximum(high, low), np.minimum(high, low)], names=["high", "low"])

    return flat.mapInArrow(walk, "high bigint, low bigint")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Gather the rows of each cell, which follow one another."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        columns = {name: batch.column(name).to_numpy() for name in ("cell", "side", "fp")}
        cells = columns["cell"]
        cuts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]).tolist() + [len(cells)]
        for first, end in zip(cuts, cuts[1:], strict=False):
            part = {name: column[first:end] for name, column in columns.items()}
            if held and held[0]["cell"][0] != part["cell"][0]:
                yield {name: np.concatenate([h[name] for h in held]) for name in part}
                held = []
            held.append(part)
    if held:
        yield {name: np.concatenate([h[name] for h in held]) for name in held[0]}


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, budget: int = BUDGET) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row: the smallest id that links of fingerprints reach."""
    marked = materialise(fingerprints(docs, words), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = materialise(trie_links(distinct, budget).distinct(), "links")
    groups = components(links)
    discard(links)
    placed = distinct.join(
        groups.select(F.col("high").alias("fp"), F.col("low").alias("_root")), "fp", "left"
    ).select("fp", "least", F.coalesce("_root", "fp").alias("root"))
    smallest = materialise(placed.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = materialise(placed.join(smallest, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
