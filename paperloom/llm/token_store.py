"""Token ids in compressed blocks with random access to single documents.

A store is a folder with two Parquet tables that any file system of Spark can hold:

dictionary: one row: the shared zstandard dictionary, its SHA-256, the id width and the end id.
blocks: part, block, start_in_part, n_docs, n_tokens, first_doc, last_doc, payload.  Parts and
blocks follow ascending document id.  A payload stands on its own:

    "TIDZ", version u16, id width u16, documents u32, dictionary SHA-256 32 bytes
    document ids i64[n], null flags u8[n], token counts u32[n], frame offsets u64[n + 1]
    one zstandard frame per document

all little-endian.  One document is read by finding its block through first_doc and last_doc and
decompressing its frame alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.tokens import encoder

MAGIC, VERSION, HEAD = b"TIDZ", 1, struct.Struct("<4sHHI32s")
#: A block is closed at this many bytes of frames or documents.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096
#: The dictionary is trained on so many documents, those with the lowest hashes of their ids, on a run of so many code
#: points that begins anywhere in each; it has so many bytes.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 8192, 64 << 10
BLOCK_SCHEMA = "part int, block int, start_in_part bigint, n_docs int, n_tokens bigint, first_doc bigint, last_doc bigint, payload binary"


class BadStore(ValueError):
    """A payload that is damaged or belongs to another dictionary."""


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A shared dictionary; raw content where the samples are too few to train on, empty without any."""
    samples = [s for s in samples if len(s) >= 8]
    if len(samples) >= 64:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:size]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def pack_block(docs: list[tuple[int | None, bytes]], width: int, dictionary: bytes, compress) -> bytes:
    """docs: id and serialized ids of each document."""
    frames = [compress(raw) for _, raw in docs]
    n = len(docs)
    offsets = np.zeros(n + 1, dtype="<u8")
    np.cumsum([len(f) for f in frames], out=offsets[1:])
    head = HEAD.pack(MAGIC, VERSION, width, n, hashlib.sha256(dictionary).digest())
    ids = np.array([d or 0 for d, _ in docs], dtype="<i8")
    null = np.array([d is None for d, _ in docs], dtype="u1")
    counts = np.array([len(raw) // width for _, raw in docs], dtype="<u4")
    return b"".join([head, ids.tobytes(), null.tobytes(), counts.tobytes(), offsets.tobytes(), *frames])


class Block:
    """Reads one payload; frames are decompressed only when asked for."""

    def __init__(self, payload: bytes, dictionary: bytes):
        magic, version, self.width, n, digest = HEAD.unpack_from(payload)
        if magic != MAGIC or version != VERSION:
            raise BadStore("not a token block")
        if digest != hashlib.sha256(dictionary).digest():
            raise BadStore("the block was written with another dictionary")
        at = HEAD.size
        self.null = np.frombuffer(payload, "u1", n, at + 8 * n)
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(payload, "<i8", n, at).tolist(), self.null, strict=True)]
        self.counts = np.frombuffer(payload, "<u4", n, at + 9 * n)
        self.offsets = np.frombuffer(payload, "<u8", n + 1, at + 13 * n).astype(np.int64)
        self.frames = memoryview(payload)[at + 13 * n + 8 * (n + 1) :]
        if len(self.frames) != self.offsets[-1]:
            raise BadStore("the block is cut short")
        self._open = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def ids(self, i: int) -> np.ndarray:
        raw = self._open(self.frames[self.offsets[i] : self.offsets[i + 1]])
        found = np.frombuffer(raw, f"<u{self.width}").astype("<u4")
        if len(found) != self.counts[i]:
            raise BadStore("a frame has another length than the index")
        return found


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, split: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2
) -> TokenStore:
    """Encodes every whole text (null: empty), appends end_id and writes a store at path.

    vocabulary: a file of the tokenizers library; split: see PieceEncoder; width: bytes of an id, which
    must hold every id of the vocabulary.  Rows of one id, repeated rows too, lie together in the
    order of a hash of their texts; rows without an id come first.  An empty table gives a store
    without blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = encoder(vocabulary, split)
    if max(model.top, end_id) >> (8 * width):
        raise ValueError(f"{width} bytes do not hold the ids of this vocabulary")
    at = 1 + F.pmod(F.xxhash64(F.lit(1), "id"), F.greatest(F.char_length("text") - SAMPLE_CHARS + 1, F.lit(1)).cast("long"))
    runs = rows.select(F.xxhash64("id").alias("h"), F.substring("text", at.cast("int"), F.lit(SAMPLE_CHARS)).alias("run"))
    sample = [r.run for r in runs.orderBy("h", "run").limit(SAMPLE_DOCS).collect()]
    kind = f"<u{width}"
    samples = [ids.astype(kind).tobytes() for ids in model.encode(pa.array(sample, pa.string()))]
    dictionary = train_dictionary(samples)
    meta = [(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary), width, end_id)]
    spark.createDataFrame(meta, "sha256 string, bytes binary, width int, end_id long").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        compress = zstandard.ZstdCompressor(level=1, dict_data=_dictionary(dictionary)).compress
        model, end = encoder(vocabulary, split), np.array([end_id], dtype=kind).tobytes()
        held: list[tuple[int | None, bytes]] = []
        size = n_block = start = 0

        def close():
            nonlocal held, size, n_block, start
            n = sum(len(raw) for _, raw in held) // width
            ids = [d for d, _ in held if d is not None]
            row = (part, n_block, start, len(held), n, min(ids, default=None), max(ids, default=None), pack_block(held, width, dictionary, compress))
            held, size, n_block, start = [], 0, n_block + 1, start + n
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, KINDS, strict=True)], names=NAMES)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc, found in zip(ids, model.encode(batch.column(1)), strict=True):
                raw = found.astype(kind).tobytes() + end
                held.append((doc, raw))
                size += len(raw)
                if size >= 2 * BLOCK_BYTES or len(held) >= BLOCK_DOCS:
                    yield close()
        if held:
            yield close()

    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    return TokenStore(spark, path)


NAMES = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
KINDS = [{"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in BLOCK_SCHEMA.split(", ")]


class TokenStore:
    """Reads a store back."""

    def __init__(self, spark: SparkSession, path: str):
        meta = spark.read.parquet(f"{path}/dictionary").collect()[0]
        self.dictionary, self.end_id = bytes(meta["bytes"]), meta["end_id"]
        if hashlib.sha256(self.dictionary).hexdigest() != meta["sha256"]:
            raise BadStore("the dictionary does not have its hash")
        self.blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")

    def documents(self, with_ids: bool = False) -> DataFrame:
        """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
        totals = self.blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
        starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
        dictionary = self.dictionary

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    block = Block(payload.as_py(), dictionary)
                    ids = [block.ids(i) for i in range(len(block.doc_ids))]
                    n = np.array([len(x) for x in ids], dtype=np.int64)
                    columns = [
                        pa.array(block.doc_ids, pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n),
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
        joined = self.blocks.join(starts, "part").select((F.col("part_start") + F.col("start_in_part")).alias("start"), "payload")
        return joined.mapInArrow(read, schema)

    def fetch(self, doc_ids: list[int]) -> DataFrame:
        """doc_id and ids of a few documents; only their frames are decompressed."""
        wanted, dictionary = set(doc_ids), self.dictionary
        near = F.lit(False)
        for d in sorted(wanted):
            near = near | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for payload in batch.column(0):
                    block = Block(payload.as_py(), dictionary)
                    at = [i for i, d in enumerate(block.doc_ids) if d in wanted]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block.doc_ids[i] for i in at], pa.int64()), pa.array([block.ids(i).tolist() for i in at], pa.list_(pa.int64()))],
                        names=["doc_id", "ids"],
                    )

        return self.blocks.where(near).select("payload").mapInArrow(read, "doc_id bigint, ids array<bigint>")
