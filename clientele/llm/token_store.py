"""Token ids on disk: one zstandard frame per document behind a shared trained dictionary.

A store is a folder of a dictionary, shard files and a manifest.  Shards hold the documents in
ascending id order, repeats by text, ids that are null first.  A shard file is, little-endian:

    magic "TOKZ0001", SHA-256 of the dictionary (32 bytes), bytes per id (1 byte)
    one zstandard frame per document, of its ids as unsigned integers of that width
    per document 29 bytes: id present (1), id (8), offset (8), frame bytes (4), ids before it in the shard (8)
    offset of that index (8), documents (8), ids (8)

The index gives access to one short document without reading its neighbours.  A file is written
under a temporary name and then renamed, so a repeated task leaves one whole file.

Defined cases: a null text is a document of the end id alone; repeated rows are stored once each; an
empty table makes a store without shards, which reads as an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from clientele.llm.tokens import StretchEncoder, forget, slices, stretch_encoder, texts_of, with_end
from clientele.operators.ranking import range_partitions
from clientele.sources.scratch import discard, materialise

#: The dictionary is trained on at most so many documents of at most so many characters, those of
#: the smallest id hash: short documents are what it is for.
SAMPLE_DOCUMENTS, SAMPLE_CHARACTERS, DICTIONARY_BYTES = 2_000, 16_384, 65_536
#: Bytes of ids a shard is meant for; a store has at least as many shards as a shuffle has partitions.
SHARD_BYTES = 1 << 28

_MAGIC = b"TOKZ0001"
_HEADER = len(_MAGIC) + 32 + 1
_INDEX = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("bytes", "<u4"), ("before", "<u8")])
_SHARD = "shard int, file string, documents bigint, tokens bigint, first_id bigint, last_id bigint"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _put(store: fs.FileSystem, path: str, parts: Iterator[bytes], mark: str) -> None:
    """Write a file whole: under another name first, then renamed."""
    with store.open_output_stream(f"{path}.{mark}") as out:
        for part in parts:
            out.write(part)
    store.move(f"{path}.{mark}", path)


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """Train on the serialized ids of a bounded sample of whole short documents.

    Too few of them to train on are used as they are; without any the dictionary is empty.
    """
    short = docs.where(F.length("text") <= SAMPLE_CHARACTERS)
    chosen = short.select(F.xxhash64("doc_id").alias("_at"), "doc_id").orderBy("_at", "doc_id").limit(SAMPLE_DOCUMENTS)
    keys = F.broadcast(chosen.select("doc_id").distinct())
    texts = short.join(keys, "doc_id", "left_semi").select("text")
    rows = texts.orderBy(F.xxhash64("text")).limit(SAMPLE_DOCUMENTS).collect()
    encoder = stretch_encoder(tokenizer, leading_blank=True)
    samples = _serialised(encoder, [row["text"] for row in rows], end_id, width)
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(samples)[:DICTIONARY_BYTES]


def _serialised(encoder: StretchEncoder, texts: Sequence[str], end_id: int, width: int) -> list[bytes]:
    """The ids of each text and the end id, little-endian."""
    ids, starts = with_end(*encoder.flat(texts), end_id)
    joined, at = ids.astype(f"<u{width}").tobytes(), (width * starts).tolist()
    return [joined[a:b] for a, b in zip(at, at[1:], strict=False)]


def _encoded(source: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """``(doc_id, ids, tie)``: serialized ids of every row, and the text of those whose id is null or comes again."""
    counted = source.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    repeated = materialise(counted.select("doc_id", F.lit(True).alias("again")), "repeated")
    tie = F.when(F.col("again") | F.col("doc_id").isNull(), F.col("text")).alias("tie")
    marked = source.join(repeated, "doc_id", "left").select("doc_id", "text", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = stretch_encoder(tokenizer, leading_blank=True)
        for batch in slices(batches, "text"):
            found = _serialised(encoder, texts_of(batch), end_id, width)
            columns = [batch.column("doc_id"), pa.array(found, pa.binary()), batch.column("tie")]
            yield pa.record_batch(columns, names=["doc_id", "ids", "tie"])

    return marked.mapInArrow(run, "doc_id bigint, ids binary, tie string")


def write_store(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int = 1 << 16, shards: int | None = None
) -> dict:
    """Encode whole texts, append ``end_id``, write the store and return its manifest.

    ``folder`` is a URI every executor reaches; ``vocabulary`` bounds the ids and sets their width.
    The manifest holds one entry per shard.
    """
    spark, width = docs.sparkSession, 2 if vocabulary <= 1 << 16 else 4
    source = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dictionary = train_dictionary(source, tokenizer, end_id, width)
    digest = hashlib.sha256(dictionary).hexdigest()
    store, base = _place(folder)
    store.create_dir(base, recursive=True)
    _put(store, f"{base}/dictionary", iter([dictionary]), "part")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, mark = f"shard-{task.partitionId():05d}", f"attempt-{task.taskAttemptId()}"
        forget()
        compressor = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary))
        index: list[np.ndarray] = []
        total = 0

        def body() -> Iterator[bytes]:
            nonlocal total
            yield _MAGIC + bytes.fromhex(digest) + bytes([width])
            offset = _HEADER
            for batch in slices(batches, "ids"):
                frames = [compressor.compress(ids.as_buffer()) for ids in batch.column("ids")]
                counts = pc.binary_length(batch.column("ids")).to_numpy() // width
                sizes = np.array([len(frame) for frame in frames])
                entries = np.zeros(len(frames), _INDEX)
                entries["known"] = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                entries["doc_id"] = pc.fill_null(batch.column("doc_id"), 0).to_numpy()
                entries["offset"], entries["bytes"] = offset + np.cumsum(sizes) - sizes, sizes
                entries["before"] = total + np.cumsum(counts) - counts
                index.append(entries)
                offset, total = offset + int(sizes.sum()), total + int(counts.sum())
                yield b"".join(frames)
            table = np.concatenate([np.zeros(0, _INDEX), *index])
            yield table.tobytes() + np.array([offset, len(table), total], "<u8").tobytes()

        out, at = _place(folder)
        _put(out, f"{at}/{name}", body(), mark)
        if index:
            table = np.concatenate(index)
            known = table["doc_id"][table["known"] == 1]
            yield pa.RecordBatch.from_pylist(
                [{"shard": task.partitionId(), "file": name, "documents": len(table), "tokens": total,
                  "first_id": int(known[0]) if len(known) else None, "last_id": int(known[-1]) if len(known) else None}],
                pa.schema([("shard", pa.int32()), ("file", pa.string()), ("documents", pa.int64()),
                           ("tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]),
            )

    # Written before it is dealt by range, which reads its input twice; ids are smaller than texts.
    encoded = materialise(_encoded(source, tokenizer, end_id, width), "encoded")
    size = encoded.agg(F.sum(F.octet_length("ids")).alias("bytes")).first()["bytes"] or 0
    parts = shards or max(range_partitions(spark), -(-size // SHARD_BYTES))
    ordered = encoded.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    written = sorted(ordered.mapInArrow(write, _SHARD).collect(), key=lambda row: row["shard"])
    discard(encoded)
    manifest = {"dictionary_sha256": digest, "end_id": end_id, "id_bytes": width, "shards": []}
    before = 0
    for row in written:
        manifest["shards"].append(row.asDict() | {"start": before})
        before += row["tokens"]
    _put(store, f"{base}/manifest.json", iter([json.dumps(manifest).encode()]), "part")
    return manifest


class Shard:
    """Random access to one shard file."""

    def __init__(self, folder: str, name: str, dictionary: bytes) -> None:
        store, base = _place(folder)
        self._file = store.open_input_file(f"{base}/{name}")
        size = self._file.size()
        head = self._file.read_at(_HEADER, 0)
        if head[: len(_MAGIC)] != _MAGIC or head[len(_MAGIC) : -1] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} does not belong to this dictionary")
        self._kind = f"<u{head[-1]}"
        at, rows, self.tokens = np.frombuffer(self._file.read_at(24, size - 24), "<u8").tolist()
        self.index = np.frombuffer(self._file.read_at(rows * _INDEX.itemsize, at), _INDEX)
        self._decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, row: int) -> np.ndarray:
        entry = self.index[row]
        frame = self._file.read_at(int(entry["bytes"]), int(entry["offset"]))
        return np.frombuffer(self._decompressor.decompress(frame), self._kind).astype("<u4")


def _read_manifest(folder: str) -> tuple[dict, bytes]:
    store, base = _place(folder)
    manifest = json.load(io.BytesIO(store.open_input_file(f"{base}/manifest.json").read()))
    return manifest, store.open_input_file(f"{base}/dictionary").read()


def read_store(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Read a store back: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, the ids.

    ``start`` counts the ids of all documents before; one task reads one shard.
    """
    manifest, dictionary = _read_manifest(folder)
    shards = manifest["shards"]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                shard = Shard(folder, shards[number]["file"], dictionary)
                start = shards[number]["start"]
                for first in range(0, len(shard.index), 1000):
                    rows = range(first, min(first + 1000, len(shard.index)))
                    found = [shard.ids(row) for row in rows]
                    entries = shard.index[rows.start : rows.stop]
                    columns = [
                        pa.array(entries["doc_id"].astype(np.int64), pa.int64(), mask=entries["known"] == 0),
                        pa.array(entries["before"].astype(np.int64) + start, pa.int64()),
                        pa.array([len(ids) for ids in found], pa.int64()),
                        pa.array([zlib.crc32(ids.tobytes()) for ids in found], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([ids.astype(np.int64) for ids in found], pa.list_(pa.int64())))
                    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                    yield pa.record_batch(columns, names=names[: len(columns)])

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(read, schema)


def fetch(folder: str, doc_ids: Sequence[int]) -> list[Row]:
    """The ids of a few documents by their ids, reading only index and frames."""
    manifest, dictionary = _read_manifest(folder)
    found = []
    for shard in manifest["shards"]:
        if shard["first_id"] is None:
            continue
        wanted = [d for d in doc_ids if shard["first_id"] <= d <= shard["last_id"]]
        if wanted:
            opened = Shard(folder, shard["file"], dictionary)
            for row in np.flatnonzero(np.isin(opened.index["doc_id"], wanted) & (opened.index["known"] == 1)):
                found.append(Row(doc_id=int(opened.index["doc_id"][row]), ids=opened.ids(row).tolist()))
    return found
