"""Token ids in fixed-width bit packing.

A shard is one file: a header, the documents' ids and first positions, the byte offset
of each block of ids, then the packed blocks. Every id takes the same number of bits, the fewest
that hold the vocabulary; a block starts at a byte, so numpy unpacks blocks
without touching the rest of the file.

    magic 8 bytes | bits, block ids: uint32 | documents, ids: uint64
    doc_id int64 x documents | first position uint64 x (documents + 1)
    block offset uint64 x (blocks + 1) | packed blocks, big-endian bit order
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, shared_dir, stored, table
from .piecewise import word_end

MODEL, VOCABULARY, END_ID = "word_bpe_49k.json", 49_408, 2
MAGIC, BLOCK, SHARD_IDS = b"LARKPAK1", 4096, 4_000_000


def width(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` as consecutive groups of ``bits`` bits, padded to a byte."""
    wide = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    if bits in (8, 16, 24, 32):
        return wide[:, 4 - bits // 8 :].tobytes()
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :]).tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    wide = np.zeros((n, 32 if bits % 8 else 4), np.uint8)
    if bits % 8:
        wide[:, 32 - bits :] = np.unpackbits(raw, count=n * bits).reshape(n, bits)
        wide = np.packbits(wide, axis=1)
    else:
        wide[:, 4 - bits // 8 :] = raw.reshape(n, bits // 8)
    return wide.reshape(-1).view(">u4").astype(np.uint32)


def shard_bytes(doc_ids: list[int], ids: list[np.ndarray], bits: int) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = [pack(flat[a : a + BLOCK], bits) for a in range(0, len(flat), BLOCK)]
    return b"".join(
        [
            MAGIC,
            np.array([bits, BLOCK], "<u4").tobytes(),
            np.array([len(doc_ids), len(flat)], "<u8").tobytes(),
            np.array(doc_ids, "<i8").tobytes(),
            np.cumsum([0, *map(len, ids)]).astype("<u8").tobytes(),
            np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes(),
            *blocks,
        ]
    )


class Shard:
    """Random access to the ids in one shard's bytes."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a shard of packed ids")
        self.bits, self.block = map(int, np.frombuffer(data[8:16], "<u4"))
        docs, self.n = map(int, np.frombuffer(data[16:32], "<u8"))
        at = 32
        self.doc_ids = np.frombuffer(data[at : at + 8 * docs], "<i8")
        at += 8 * docs
        self.first = np.frombuffer(data[at : at + 8 * (docs + 1)], "<u8").astype(np.int64)
        at += 8 * (docs + 1)
        blocks = -(-self.n // self.block)
        self.offsets = np.frombuffer(data[at : at + 8 * (blocks + 1)], "<u8").astype(np.int64)
        self.body = data[at + 8 * (blocks + 1) :]

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (not included): only their blocks are unpacked."""
        if b <= a:
            return np.zeros(0, np.uint32)
        parts = []
        for k in range(a // self.block, (b - 1) // self.block + 1):
            n = min(self.block, self.n - k * self.block)
            parts.append(unpack(self.body[self.offsets[k] : self.offsets[k + 1]], n, self.bits))
        start = a // self.block * self.block
        return np.concatenate(parts)[a - start : b - start]

    def document(self, k: int) -> np.ndarray:
        return self.slice(self.first[k], self.first[k + 1])


def put(path: str, data: bytes) -> None:
    """Write a whole file in the shared folder; a repeated task replaces it by the same bytes."""
    scratch = f"{path}.{uuid.uuid4().hex}.tmp"
    if path.startswith("file:") or "://" not in path:
        local, scratch = (x.removeprefix("file:").replace("///", "/", 1) for x in (path, scratch))
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(scratch, "wb") as f:
            f.write(data)
        os.replace(scratch, local)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_output_stream(name + scratch[len(path) :]) as f:
        f.write(data)
    store.move(name + scratch[len(path) :], name)


def write_packed(docs: DataFrame, folder: str) -> DataFrame:
    """Shards of ``docs`` (doc_id, text) under ``folder``, in ascending doc_id order.

    Returns one row for each shard: shard name, its place in the order, ids before it and in it.
    Null texts are empty, so a document has at least the end id; rows with one
    doc_id stay neighbours (ordered by text); a null doc_id is refused; no rows, no shards.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    bits = width(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder = word_end(MODEL)
        end = np.array([END_ID], "<u4").tobytes()
        doc_ids: list[int] = []
        ids: list[np.ndarray] = []
        done: list[tuple[str, int, int, int]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            name = f"{part:06d}-{len(done):04d}.bits"
            put(f"{folder}/{name}", shard_bytes(doc_ids, ids, bits))
            done.append((name, part, len(done), held))
            doc_ids.clear()
            ids.clear()
            held = 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(np.frombuffer(coder(text.as_py() or "") + end, "<u4"))
                doc_ids.append(doc_id)
                held += len(ids[-1])
                if held >= SHARD_IDS:
                    flush()
        if doc_ids:
            flush()
        yield pa.RecordBatch.from_pylist(
            [{"shard": s, "part": p, "piece": k, "ids": n} for s, p, k, n in done],
            schema=pa.schema([("shard", pa.string()), ("part", pa.int32()), ("piece", pa.int32()), ("ids", pa.int64())]),
        )

    shards = stored(ordered.mapInArrow(lean(run), "shard string, part int, piece int, ids long"))
    # one row for each shard of millions of ids, so this order stays small
    before = F.coalesce(F.sum("ids").over(W.orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return shards.withColumn("before", before)


def read_packed(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards under ``folder``."""
    schema = "shard string, doc_id long, first long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                shard = Shard(content.as_py())
                ids, first = shard.slice(0, shard.n).astype("<u4"), shard.first.tolist()  # SHARD_IDS and one text's at most
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path.as_py().rpartition("/")[2]] * len(crc), pa.string()),
                        pa.array(shard.doc_ids),
                        pa.array(shard.first[:-1]),
                        pa.array(np.diff(shard.first)),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["shard", "doc_id", "first", "n_tokens", "ids_crc32"],
                )

    if shards.isEmpty():
        rows = spark.createDataFrame([], schema)
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bits").load(folder)
        rows = files.select("path", "content").mapInArrow(lean(run), schema)
    return rows.join(shards.select("shard", "before"), "shard").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def op10_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    shards = write_packed(table(spark, sf_dir, "documents"), folder)
    return read_packed(spark, folder, shards)
