"""Sum-of-squares packing of tokenized documents into sequences of fixed capacity.

Documents longer than a sequence are cut into whole-sequence pieces and a rest.  Rests are placed
longest first: each goes where the sum over all residual gaps of the squared number of open
sequences with that gap becomes smallest, and a new sequence is opened only when no open one has
room.  Pieces are dealt to groups of bounded expected size by a hash of their place; a group
is packed by one task from lengths alone, and wastes less than about one sequence.

Defined cases: null texts count as empty, so such a document is just the end id; repeated rows and
repeated or null ids are packed as separate documents; an empty table gives an empty result; extra
columns are ignored.  Ties go to the smallest gap, then to the sequence that came to this gap last.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.tokens import slices, stretch_encoder, texts_of, with_end
from clientele.sources.scratch import materialise

CAPACITY = 2048
#: Expected pieces of a group; a task holds the lengths of one group.
GROUP_PIECES = 20_000
#: Stretches a worker remembers, and characters it encodes at once: fewer than elsewhere, as the pipeline packs
#: in workers and executors that earlier stages have filled.
REMEMBERED, BATCH_CHARACTERS = 250_000, 2_000_000

_PIECES = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY,
    leading_blank: bool = False, with_ids: bool = False,
) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: document, place in it, length and crc32.

    ``with_ids`` adds the ids themselves, little-endian unsigned 32-bit.  ``row`` tells documents with
    the same id apart.
    """

    remembered, characters = REMEMBERED, BATCH_CHARACTERS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = stretch_encoder(tokenizer, leading_blank, remembered=remembered)
        for batch in slices(batches, "text", characters):
            ids, starts = with_end(*encoder.flat(texts_of(batch)), end_id)
            sizes = np.diff(starts)
            count = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), count)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            begin = number * capacity
            length = np.minimum(sizes[doc] - begin, capacity)
            joined, at = memoryview(ids.astype("<u4").tobytes()), 4 * (starts[doc] + begin)
            parts = [joined[a:b] for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            columns = [
                batch.column("doc_id").take(pa.array(doc)), batch.column("row").take(pa.array(doc)), pa.array(number, pa.int32()),
                pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(part) for part in parts], pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([bytes(part) for part in parts], pa.binary()))
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.record_batch(columns, names=names[: len(columns)])

    source = docs.select(
        F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string")
    )
    return source.mapInArrow(cut, _PIECES + (", ids binary" if with_ids else ""))


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, all below or equal to the capacity."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_with: dict[int, list[int]] = defaultdict(list)  # sequences by residual gap
    count = np.zeros(capacity + 1, np.int64)
    opened = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        room = count[size:]
        # Change of the sum of squares when a sequence of gap size, size + 1, ... takes the item.
        change = 2 * (count[: capacity + 1 - size] - room) + 2
        change[0] = 1 - 2 * room[0]
        change[room == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        if room[best]:
            gap = size + best
            taken = open_with[gap].pop()
            count[gap] -= 1
        else:
            gap, taken = capacity, opened
            opened += 1
        sequence[item], offset[item] = taken, capacity - gap
        if gap > size:
            open_with[gap - size].append(taken)
            count[gap - size] += 1
    return sequence, offset


def pack(parts: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces; ``parts`` must be a written table.

    Every piece of full length is a sequence of its own; all others are packed group by group.
    """
    groups = -(-parts.where(F.col("length") < capacity).count() // group_pieces) or 1
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("int"))
    schema = parts.drop("ids").schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")

    def one_group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "piece"], ignore_index=True)
        group = int(frame.pop("_group").iloc[0])
        sequence, offset = place(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=sequence * groups + group, offset=offset)

    packed = (
        dealt.where(F.col("length") < capacity)
        .drop("ids")
        .groupBy("_group")
        .applyInPandas(one_group, f"{schema}, sequence_id bigint, offset bigint")
    )
    # Numbers below zero are free for the full ones: (row, piece) is unique, and so is its number.
    full = parts.drop("ids").where(F.col("length") >= capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")}
    )
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack: one row per piece with its sequence and its place there."""
    return pack(materialise(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def sequences(packed: DataFrame, parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The ids of each sequence: ``(sequence_id, ids)``, pieces in the order of their offsets.

    ``parts`` are the pieces written with their ids; a sequence holds at most ``capacity`` pieces.
    """
    placed = packed.select("row", "piece", "sequence_id", "offset").join(
        parts.select("row", "piece", "ids"), ["row", "piece"]
    )
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = placed.groupBy("sequence_id").agg(inside.alias("parts"))
    return joined.select(
        "sequence_id", F.aggregate("parts.ids", F.lit(b""), lambda done, part: F.concat(done, part)).alias("ids")
    )
