"""Near-duplicate documents by SetSketch registers.

A register keeps the exponentially spaced, truncated minimum of one hash over a document's
shingles: registers of a union are the larger of both, and two documents' registers agree
about as often as their sets do. Bands of registers find candidates; the registers that
agree, exceed and fall below give the maximum-likelihood similarity (set sizes being
known); pairs with a fair chance are verified on full shingle sets; components of verified links are the
groups.

Equal sets are one class from the start. Candidates are taken in rounds, so that a large group is
linked through its centre first and only documents that are still apart are compared further:
(1) every member of a bucket with the bucket's centre, (2) each document with the likeliest
documents outside its component, (3) all remaining candidate pairs across components, verified where they are found.
Buckets are cut into blocks of BLOCK members, and tasks return pairs, not buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, lean, shuffle_cleanup, stored, table
from .components import components
from .hashing import Ranges, mix

WORDS, PERCENT = 4, 80
BANDS, ROWS = 40, 6  # at similarity 0.8 a pair shares no band with probability 5e-6
REGISTERS = BANDS * ROWS
BASE = 1.001
LIKELY = 0.72  # three standard errors of the estimate below 0.8
BLOCK, CALL_ROWS, FIRST = 1024, 2048, 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@lru_cache(maxsize=1)
def _factors() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 2**63, REGISTERS, dtype=np.uint64) * 2 + 1


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text: word n-grams after lowering A-Z; fewer words are one shingle."""
    texts = [t.translate(_LOWER) for t in texts]
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    gap = np.concatenate([[True], _GAP[data]])
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    h = Ranges(data).hash(start, end)
    first = np.searchsorted(start, bounds)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        k = min(words, n)
        x = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[a + j : b - k + 1 + j])
        out.append(np.unique(x))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set: floor(1 - log_BASE(least exponential value)) for each hash, as uint16."""
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[None, at : at + 4096] * _factors()[:, None]).min(axis=1))
    value = -np.log1p(-np.clip(least.astype(np.float64) / 2.0**64, 1e-18, 1 - 1e-16))
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, 65535).astype("<u2")


def likely_similarity(same: np.ndarray, above: np.ndarray, below: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from register comparisons and set sizes (on a grid)."""
    grid = np.linspace(0.5, 1.0, 101)
    u = (nx / (nx + ny))[:, None]
    p_above, p_below = u - (1 - u) * grid, (1 - u) - u * grid
    tiny = 1e-9
    fit = same[:, None] * np.log(grid) + above[:, None] * np.log(np.maximum(p_above, tiny)) + below[:, None] * np.log(np.maximum(p_below, tiny))
    return grid[np.argmax(fit, axis=1)]


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (which identify the set) and registers of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks((t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()):
                sets = shingle_sets(part)
                sums = [[int(mix(s ^ np.uint64(k)).sum(dtype=np.uint64).astype(np.int64)) for k in (1, 2)] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(part)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([x for x, _ in sums], pa.int64()),
                        pa.array([x for _, x in sums], pa.int64()),
                        pa.array([registers(s).tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "registers"],
                )
                at += len(part)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_shingles long, set_a long, set_b long, registers binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """(key, band, id) of every band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), "<u2").reshape(len(ids), BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(ids), BANDS))
            for j in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(ids))), pa.array(np.repeat(ids, BANDS))],
                names=["key", "band", "id"],
            )

    return classes.select("id", "registers").mapInArrow(lean(run), "key long, band int, id long")


class Bucketed:
    """The rows of one task call: members of many buckets, told apart by (key, bi, bj)."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("key", "ascending"), ("bi", "ascending"), ("bj", "ascending"), ("id", "ascending")]).combine_chunks()
        self.ids, self.labels, self.n, self.side, self.bi, self.bj, self.band = (t.column(c).to_numpy() for c in ("id", "label", "n", "side", "bi", "bj", "band"))
        key = t.column("key").to_numpy()
        self.regs = np.frombuffer(b"".join(t.column("registers").to_pylist()), "<u2").reshape(len(key), REGISTERS)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (self.bi[1:] != self.bi[:-1]) | (self.bj[1:] != self.bj[:-1])])
        self.first = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.first, len(key)))
        self.sets = t.column("shingles") if "shingles" in t.column_names else None

    def judged(self, i: np.ndarray, j: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs (i, j) of rows that are likely similar enough, and how similar."""
        fair = (same >= 0.5 * REGISTERS) & (100 * np.minimum(self.n[i], self.n[j]) >= PERCENT * np.maximum(self.n[i], self.n[j]))
        i, j, same = i[fair], j[fair], same[fair]
        above = (self.regs[i] > self.regs[j]).sum(axis=1)
        s = likely_similarity(same, above, REGISTERS - same - above, self.n[i].astype(float), self.n[j].astype(float))
        fit = s >= LIKELY
        return i[fit], j[fit], s[fit]

    def told_here(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs of rows, those whose first common band is this bucket's: a pair is told once."""
        agree = (self.regs[i].reshape(-1, BANDS, ROWS) == self.regs[j].reshape(-1, BANDS, ROWS)).all(axis=2)
        return agree.argmax(axis=1) == self.band[i]

    def twos(self, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All buckets of two members at once."""
        i = self.first[self.sizes == 2]
        j = i + 1
        if across:
            open_pair = self.labels[i] != self.labels[j]
            i, j = i[open_pair], j[open_pair]
        told = self.told_here(i, j)
        i, j = i[told], j[told]
        return self.judged(i, j, (self.regs[i] == self.regs[j]).sum(axis=1))

    def centre(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each member of the first block with the member of the second that agrees most with all of it."""
        left, right = self.sides(rows)
        r = self.regs[left]
        shared = np.array([int((r == self.regs[j]).sum()) for j in right])
        c = right[np.lexsort((self.ids[right], -shared))[0]]
        j = left[left != c]
        return self.judged(np.full(len(j), c), j, (self.regs[j] == self.regs[c]).sum(axis=1))

    def sides(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = self.bi[rows[0]] == self.bj[rows[0]]
        left = rows[self.side[rows] == self.bi[rows]]
        return left, left if one else rows[self.side[rows] != self.bi[rows]]

    def across(self, rows: np.ndarray, best: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Likely pairs across components; with ``best`` only so many of each member."""
        left, right = self.sides(rows)
        found = []
        for i in left:
            j = right[(self.labels[right] != self.labels[i]) & ((self.ids[right] > self.ids[i]) | (left is not right) | (best is not None))]
            x = self.judged(np.full(len(j), i), j, (self.regs[j] == self.regs[i]).sum(axis=1))
            told = self.told_here(x[0], x[1])
            x = tuple(v[told] for v in x)
            if best is not None and len(x[2]) > best:
                x = tuple(v[np.argsort(-x[2], kind="stable")[:best]] for v in x)
            found.append(x)
        return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def similar(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.array([enough(np.frombuffer(self.sets[int(a)].as_py(), np.uint64), np.frombuffer(self.sets[int(b)].as_py(), np.uint64)) for a, b in zip(i, j, strict=True)], bool)


def enough(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough, exactly."""
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    common = int((q[at] == p).sum())
    return 100 * common >= PERCENT * (len(p) + len(q) - common)


def compare(t: pa.Table, mode: str) -> pa.Table:
    """Pairs (x < y, s) of the buckets in ``t``; mode "rest" verifies them at once."""
    rows = Bucketed(t)
    found = [rows.twos(mode != "centre")]
    for k in np.flatnonzero(rows.sizes > 2):
        members = np.arange(rows.first[k], rows.first[k] + rows.sizes[k])
        found.append(rows.centre(members) if mode == "centre" else rows.across(members, FIRST if mode == "first" else None))
    i, j, s = (np.concatenate(v) for v in zip(*found, strict=True))
    i, j = i.astype(np.int64), j.astype(np.int64)
    if mode == "rest":
        keep = rows.similar(i, j)
        i, j, s = i[keep], j[keep], s[keep]
    a, b = rows.ids[i], rows.ids[j]
    return pa.table({"x": pa.array(np.minimum(a, b)), "y": pa.array(np.maximum(a, b)), "s": pa.array(s.astype(np.float64))})


def candidates(members: DataFrame, classes: DataFrame, labels: DataFrame | None, mode: str, sets: DataFrame) -> DataFrame:
    """Likely pairs (x < y, s) within buckets; after the first round only across components."""
    rows = members
    if labels is None:
        rows = rows.withColumn("label", F.col("id"))
    else:
        rows = rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        open_keys = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
        rows = rows.join(open_keys, "key")
    nb = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = stored(
        rows.withColumn("side", F.pmod(F.xxhash64("id"), nb).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), nb - 1)))
        .select("key", "band", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "side", "id", "label")
    )
    calls = max(1, rows.count() // CALL_ROWS)
    rows = rows.withColumn("call", F.pmod(F.xxhash64("key", "bi", "bj"), F.lit(calls))).join(classes.select("id", "n", "registers"), "id")
    if mode == "rest":
        rows = rows.join(sets, "id")
    found = rows.groupBy("call").applyInArrow(lambda t: compare(t, mode), "x long, y long, s double")
    return found.groupBy("x", "y").agg(F.max("s").alias("s"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text).

    Null texts and texts without words have no shingles and stand alone, kept. Repeated rows
    share their doc_id, set and component. A component's least doc_id is kept. Rows without doc_id are linked with
    nothing: their component_id is null, and they are kept. An empty table gives an empty result; extra columns are left out.
    """
    spark = docs.sparkSession
    with shuffle_cleanup(spark):
        sketched = stored(sketch(docs))
        classes = stored(
            sketched.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
        )
        bands = band_rows(classes)
        sizes = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        members = stored(bands.join(sizes, "key"))
        sets = stored(full_sets(docs, members.select("id").distinct()))
        links = None
        labels = None
        for mode in ("centre", "first", "rest"):
            pairs = candidates(members, classes, labels, mode, sets)
            if mode == "rest":
                new = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))
            else:
                best = W.partitionBy("x").orderBy(F.desc("s"), "y")
                least = 2 if mode == "centre" else FIRST
                pairs = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "s"))
                pairs = pairs.withColumn("k", F.row_number().over(best)).where(F.col("k") <= least)
                new = verified(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), sets)
            links = stored(new if links is None else links.unionByName(new))
            labels = components(links)
        names = sketched.join(classes.select("set_a", "set_b", "id"), ["set_a", "set_b"], "left")
        result = names.join(labels, "id", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "id", "doc_id")))
        return result.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents ``ids``, each once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks((t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(part)), pa.array([s.tobytes() for s in shingle_sets(part)], pa.binary())], names=["id", "shingles"]
                )
                at += len(part)

    return texts.mapInArrow(lean(run), "id long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b): the pairs (x, y) whose full sets are similar enough, exactly."""
    x = sets.select(F.col("id").alias("x"), F.col("shingles").alias("sx"))
    y = sets.select(F.col("id").alias("y"), F.col("shingles").alias("sy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("sx"), batch.column("sy"), strict=True)
            good = pa.array([enough(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) for a, b in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(good), batch.column("y").filter(good)], names=["a", "b"])

    return pairs.select("x", "y").join(x, "x").join(y, "y").select("x", "y", "sx", "sy").mapInArrow(lean(run), "a long, b long")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
