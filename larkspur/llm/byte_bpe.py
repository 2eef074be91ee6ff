"""Byte-level BPE over Arrow batches.

The tokenizers library encodes. Its vocabulary spells each token in characters that stand for bytes; reversing that
table (``byte_chars``) gives the byte strings of all ids. Decoding joins them, so characters that
are split over several ids come back whole. ``offsets`` gives the bytes that each id covers, ``split_ids`` the ids that
start inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

from .common import lean, table
from .piecewise import byte_level, library

MODEL = "byte_bpe_50k.json"


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def byte_table(model: str = MODEL) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes one after the other, and where each starts (ids ascending)."""
    tokens = library(model, True).get_vocab(with_added_tokens=False)
    byte = {c: b for b, c in byte_chars().items()}
    parts = [b""] * (max(tokens.values()) + 1)
    for token, i in tokens.items():
        parts[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def encode(texts: list[str], model: str = MODEL) -> Iterator[np.ndarray]:
    """Ids (uint32) of each text."""
    coder = byte_level(model)
    return (np.frombuffer(coder(text), dtype="<u4") for text in texts)


def decode(ids: np.ndarray, model: str = MODEL) -> bytes:
    """The bytes of ``ids``, gathered from the byte table without a loop over ids."""
    data, starts = byte_table(model)
    ids = ids.astype(np.int64)
    first, n = starts[ids], starts[ids + 1] - starts[ids]
    ends = np.cumsum(n)
    if not len(ids):
        return b""
    at = np.arange(ends[-1]) + np.repeat(first - (ends - n), n)
    return data[at].tobytes()


def offsets(ids: np.ndarray, model: str = MODEL) -> np.ndarray:
    """(start, end) byte offsets of each id in the decoded text."""
    _, starts = byte_table(model)
    ids = ids.astype(np.int64)
    ends = np.cumsum(starts[ids + 1] - starts[ids])
    return np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1) if len(ids) else np.zeros((0, 2), np.int64)


def split_ids(ids: np.ndarray, decoded: bytes, model: str = MODEL) -> np.ndarray:
    """Which ids start inside a UTF-8 character of their decoded text."""
    return np.frombuffer(decoded, np.uint8)[offsets(ids, model)[:, 0]] & 0xC0 == 0x80 if len(ids) else np.zeros(0, bool)


def encode_documents(docs: DataFrame, text: str = "text", checked: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int): whole texts, null as empty. ``checked``: a column that says whether the ids decode to the text, told in the
    same pass, so that a task has one Python worker and ids don't travel to another."""
    kept = [c for c in docs.columns if c not in ("ids", checked)]
    docs = docs.select(*kept)
    schema = docs.select(*kept).schema.add("ids", ArrayType(IntegerType()))
    if checked:
        schema = schema.add(checked, BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column(text).to_pylist()]
                ids = [x.astype(np.int32) for x in encode(texts)]
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat))]
                if checked:
                    columns.append(pa.array([decode(x) == t.encode() for x, t in zip(ids, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def decode_documents(docs: DataFrame, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded`` (binary) in place of nothing: the bytes of each row's ids (null as none)."""
    kept = [c for c in docs.columns if c != "decoded"]
    schema = docs.select(*kept).schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(ids)
            out = [decode(np.asarray(x.values) if x.is_valid else np.zeros(0, np.int64)) for x in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], names=schema.names)

    return docs.select(*kept).mapInArrow(lean(run), schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, how many ids start inside a character, and whether decoding gave the text back.

    Null texts count as empty: no ids, the digests of nothing. Repeated rows
    are encoded each; an empty table gives none. Texts keep no state between rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column("text").to_pylist()]
                rows: list[tuple] = []
                for text, ids in zip(texts, encode(texts), strict=True):
                    back = decode(ids)
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), int(split_ids(ids, back).sum()), back == text.encode()))
                n, a, b, inside, same = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(inside, pa.int64()), pa.array(same)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split", "round_trip"],
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
