"""Exact repeats of LENGTH bytes, by longest-previous-factor arrays over a sorted suffix array.

``suffix_order`` sorts the suffixes of a text by prefix doubling. In that order the nearest suffixes on either
side that start earlier in the text (the previous and next smaller positions) hold the longest earlier match of a
suffix: ``longest_previous`` takes the longer of both common prefixes. Where it reaches LENGTH, a copy stands
earlier, and the later one goes (``keep="first"``). The same arrays over mirrored positions give the longest later match;
where either reaches LENGTH, the string also starts elsewhere (``keep="none"``).

Spark brings suffixes that can match together without moving all of them. Every window of LENGTH
bytes belongs to the least of its GRAM-byte grams (its anchor), a choice that depends on
the window's content alone, so equal windows have equal anchors. Neighbouring windows of
one anchor travel as one row, a run:
  1. equal runs (by a 128-bit BLAKE2 digest of their bytes) are one from here on, so a text with thousands of copies is
     sorted once;
  2. runs whose anchor occurs with different runs send their bytes to the anchor's bucket, where the
     arrays above are computed;
  3. anchors with more than CROWD different runs are never gathered: their windows are
     counted one by one, by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, lean, shuffle_cleanup, stored, table
from .hashing import Ranges

LENGTH, GRAM = 400, 128
CROWD, BUCKET_RUNS = 4096, 2048
SEGMENT = 1 << 20
DEPTH = 448  # characters by which suffixes are told apart; 7 * 2**6, beyond LENGTH


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[i : i + w] for every i with a whole window."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, 2**64 - 1, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def window_runs(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, windows, anchor hash, run digest) of every run of windows with one anchor."""
    w = length - GRAM + 1
    for part in _segments(texts, length):
        body = b"".join(t for _, _, t in part)
        data = np.frombuffer(body, np.uint8)
        bounds = np.cumsum([0, *(len(t) for _, _, t in part)])
        if len(data) < length:
            continue
        grams = Ranges(data)
        start = np.arange(len(data) - GRAM + 1)
        place = np.uint64((1 << 21) - 1)
        key = (grams.hash(start, start + GRAM) & ~place) | (place - start.astype(np.uint64))
        anchor = (place - (_sliding_min(key, w) & place)).astype(np.int64)  # the last of the least
        piece = np.searchsorted(bounds, np.arange(len(anchor)), side="right") - 1
        valid = np.arange(len(anchor)) + length <= bounds[piece + 1]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | (valid[1:] != valid[:-1])])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(anchor)))
        use = valid[first]
        first, n = first[use], n[use]
        owner = piece[first]
        shift = np.array([s for _, s, _ in part])[owner] - bounds[owner]
        h = grams.hash(anchor[first], anchor[first] + GRAM)
        yield np.array([k for k, _, _ in part])[owner], first + shift, n, h, digests(body, first, first + n - 1 + length)


def digests(body: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of a BLAKE2 digest of each range (n x 2)."""
    found = b"".join(hashlib.blake2b(body[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True))
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def _segments(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) lists of about SEGMENT bytes; long texts are cut so that every window is in one piece."""
    part: list[tuple[int, int, bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        for offset in range(0, max(len(text) - length + 1, 0), SEGMENT // 2):
            piece = text[offset : offset + SEGMENT // 2 + length - 1]
            if size + len(piece) > SEGMENT:
                yield part
                part, size = [], 0
            part.append((k, offset, piece))
            size += len(piece)
    if part:
        yield part


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffixes of ``text`` (integers, 0 ends a piece) in order, and for each length 8, 16, ... the ranks of all prefixes of it.

    Prefix doubling: suffixes sorted by k characters are sorted by 2 k characters through the ranks of both halves.
    It ends when all ranks differ, or at DEPTH characters (then equal prefixes stay in order of position).
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(7):  # seven characters of nine bits
        key = key << np.uint64(9) | padded[j : j + n]
    order, rank = _ranked(key)
    k, levels = 7, [(7, rank)]
    while k < DEPTH and rank[order[-1]] < n - 1:
        after = np.zeros(n, np.uint64)
        if k < n:
            after[: n - k] = rank[k:].astype(np.uint64) + np.uint64(1)
        order, rank = _ranked(rank.astype(np.uint64) << np.uint64(32) | after)
        k *= 2
        levels.append((k, rank))
    return order, levels


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of ``key`` and each one's rank (the number of smaller different ones)."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    rank = np.empty(len(key), np.int32)
    rank[order] = np.cumsum(np.concatenate([[0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int32)]))[: len(key)]
    return order, rank


def smaller_positions(x: np.ndarray) -> np.ndarray:
    """For each place in ``x`` the nearest earlier place with a smaller value, or -1. Places not settled jump over those already passed."""
    found = np.arange(len(x)) - 1
    todo = np.arange(1, len(x))
    while len(todo):
        at = found[todo]
        todo = todo[(at >= 0) & (x[np.maximum(at, 0)] > x[todo])]
        found[todo] = found[found[todo]]
    return found


def common_prefix(levels: list[tuple[int, np.ndarray]], text: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at i and j, as far as the levels reach (twice DEPTH at most)."""
    n, length = len(text), np.zeros(len(i), np.int64)
    for k, rank in reversed(levels):
        a, b = i + length, j + length
        inside = np.flatnonzero((a < n) & (b < n))
        same = rank[a[inside]] == rank[b[inside]]
        length[inside[same]] += k
    for _ in range(6):
        a, b = i + length, j + length
        inside = np.flatnonzero((a < n) & (b < n))
        inside = inside[text[a[inside]] == text[b[inside]]]
        length[inside] += 1
    return length


def longest_previous(order: np.ndarray, levels: list[tuple[int, np.ndarray]], text: np.ndarray, left: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array of the suffixes ``order`` (in suffix order): for each the length of the longest match with a smaller ``place``.

    ``left``: how many characters each suffix has up to the end of its piece; matches end there.
    """
    x = place[order]
    before = smaller_positions(x)
    after = len(x) - 1 - smaller_positions(x[::-1])[::-1]  # len(x): none
    longest = np.zeros(len(x), np.int64)
    for other in (before, after):
        has = np.flatnonzero((other >= 0) & (other < len(x)))
        i, j = order[has], order[other[has]]
        match = np.minimum(common_prefix(levels, text, i, j), np.minimum(left[i], left[j]))
        longest[has] = np.maximum(longest[has], match)
    found = np.zeros(len(text), np.int64)
    found[order] = longest
    return found


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``rid``, which tells rows with one doc_id but different texts apart."""
    return docs.select(F.col("doc_id").cast("long"), "text").withColumn("rid", F.xxhash64("doc_id", "text"))


def anchors(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids = batch.column("doc_id"), batch.column("rid")
            at = 0
            for part in chunks((t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()):
                for k, first, n, h, c in window_runs(part, length):
                    take = pa.array(at + k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), ids.take(take), rids.take(take), pa.array(first.astype(np.int64)), pa.array(n.astype(np.int32))],
                        names=["h", "c", "c2", "doc_id", "rid", "first", "n"],
                    )
                at += len(part)

    return rows.mapInArrow(lean(run), "h long, c long, c2 long, doc_id long, rid long, first long, n int")


def repeated_windows(rows: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """(rid, a, b): byte ranges of ``rows`` (from ``identified``) covered by repeated windows.

    ``keep``: "none" covers every copy, "first" leaves the first (by doc_id and place).
    """
    runs = stored(anchors(rows, length))
    if keep == "first":  # repeated rows share their rid; one of them stands for all (see ``cut_repeats``)
        runs = runs.dropDuplicates(["rid", "first"])
    copies = runs.groupBy("h", "c", "c2").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "rid", "first")).alias("lead"))
    kinds = copies.groupBy("h").agg(F.count("*").alias("kinds"), F.max("copies").alias("most")).where("kinds > 1 or most > 1")
    judged = stored(
        runs.join(copies.join(kinds.select("h", "kinds"), "h"), ["h", "c", "c2"]).withColumn(
            "is_lead", (F.col("lead.doc_id") == F.col("doc_id")) & (F.col("lead.rid") == F.col("rid")) & (F.col("lead.first") == F.col("first"))
        ).select("h", "doc_id", "rid", "first", "n", "copies", "kinds", "is_lead")
    )
    whole = judged.where("copies > 1") if keep == "none" else judged.where("copies > 1 and not is_lead")
    whole = whole.select("rid", F.col("first").alias("a"), (F.col("first") + F.col("n") - 1 + length).alias("b"))
    open_runs = judged.where("kinds > 1 and (copies = 1 or is_lead)")
    sent = windows_of(rows, open_runs, length)
    sent = stored(sent.dropDuplicates(["rid", "first", "h", "w2"]) if keep == "first" else sent)
    crowded = sent.where("bytes is null").select(F.col("h").alias("w"), "w2", "doc_id", "rid", "first")
    leads = crowded.groupBy("w", "w2").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "rid", "first")).alias("lead")).where("copies > 1")
    single = crowded.join(leads, ["w", "w2"])
    if keep == "first":
        single = single.where(F.struct("doc_id", "rid", "first") != F.col("lead"))
    single = single.select("rid", F.col("first").alias("a"), (F.col("first") + length).alias("b"))
    gathered = sent.where("bytes is not null")
    n_buckets = max(1, gathered.count() // BUCKET_RUNS)

    def resolve(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        doc_id, rid, first, n = (t.column(x).to_numpy() for x in ("doc_id", "rid", "first", "n"))
        found = matched_windows(t.column("bytes").to_pylist(), n.astype(np.int64), np.lexsort((first, rid, doc_id)), length, keep)
        i, a, b = found
        return pa.table({"rid": pa.array(rid[i]), "a": pa.array(first[i] + a), "b": pa.array(first[i] + b + length)})

    dealt = gathered.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(n_buckets)))
    close = dealt.groupBy("bucket").applyInArrow(resolve, "rid long, a long, b long")
    return whole.unionByName(single).unionByName(close)


def matched_windows(parts: list[bytes], n: np.ndarray, ordered: np.ndarray, length: int, keep: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, first, last) of the maximal rows of windows in ``parts`` that match others by ``length`` bytes; part k has n[k] windows.

    ``ordered``: the parts in order of document and place; with ``keep="first"`` only later copies are returned.
    """
    sizes = np.array([len(x) + 1 for x in parts])
    base = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.uint16) + 1
    text[base + sizes - 1] = 0  # ends of pieces
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    left, place, wanted = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64), np.zeros(len(text), bool)
    at = base[row] + step
    wanted[at] = True
    left[at] = sizes[row] - 1 - step
    rank = np.empty(len(n), np.int64)
    rank[ordered] = np.arange(len(n))
    place[at] = rank[row] * (int(n.max()) + 1) + step
    order, levels = suffix_order(text)
    order = order[wanted[order]]
    flags = longest_previous(order, levels, text, left, place)[at] >= length
    if keep != "first":
        flags |= longest_previous(order, levels, text, left, -place)[at] >= length
    new = flags & ~np.concatenate([[False], flags[:-1] & (row[1:] == row[:-1])])
    last = flags & ~np.concatenate([flags[1:] & (row[1:] == row[:-1]), [False]])
    i, j = np.flatnonzero(new), np.flatnonzero(last)
    return row[i], step[i], step[j]


def windows_of(rows: DataFrame, open_runs: DataFrame, length: int) -> DataFrame:
    """The bytes of each open run; of crowded anchors, a row for each window, h and w2 being its digest."""
    lists = open_runs.groupBy("rid").agg(F.collect_list(F.struct("first", "n", "h", (F.col("kinds") > CROWD).alias("crowd"))).alias("runs"))
    schema = pa.schema([("h", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, rid = batch.column("doc_id")[k].as_py(), batch.column("rid")[k].as_py()
                text = (batch.column("text")[k].as_py() or "").encode("utf-8", "surrogatepass")
                plain, crowd = [], []
                for r in batch.column("runs")[k].as_py():
                    (crowd if r["crowd"] else plain).append(r)
                if plain:
                    cut = [text[r["first"] : r["first"] + r["n"] - 1 + length] for r in plain]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["h"] for r in plain], pa.int64()), pa.nulls(len(cut), pa.int64()), pa.array([doc_id] * len(cut), pa.int64()), pa.array([rid] * len(cut), pa.int64()), pa.array([r["first"] for r in plain], pa.int64()), pa.array([r["n"] for r in plain], pa.int32()), pa.array(cut, pa.binary())],
                        schema=schema,
                    )
                if crowd:
                    first = np.concatenate([r["first"] + np.arange(r["n"]) for r in crowd])
                    w = digests(text, first, first + length)
                    m = len(first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array([doc_id] * m, pa.int64()), pa.array([rid] * m, pa.int64()), pa.array(first.astype(np.int64)), pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.binary())],
                        schema=schema,
                    )

    joined = rows.join(lists, "rid").select("doc_id", "rid", "text", "runs")
    return joined.mapInArrow(lean(run), "h long, w2 long, doc_id long, rid long, first long, n int, bytes binary")


def cut_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none", with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every row.

    Texts are judged as UTF-8 bytes, null as empty; matches never cross documents; texts shorter
    than ``length`` are whole. Repeated rows are copies of each other like any others,
    even with one doc_id: with ``keep="first"`` one of them is judged against the other documents and the rest
    goes. Equal windows are told by 128-bit digests. Empty tables give empty results; other columns are left out.
    """
    rows = identified(docs)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                text = (batch.column("text")[k].as_py() or "").encode("utf-8", "surrogatepass")
                spans = batch.column("spans")[k].as_py()
                mark = np.zeros(len(text) + 1, np.int32)
                for s in spans or ():
                    mark[s["a"]] += 1
                    mark[s["b"]] -= 1
                gone = np.cumsum(mark)[:-1] > 0
                runs = _runs(gone)
                ends = [0, *(x for r in runs for x in r), len(text)]
                left = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                out.append(
                    {"doc_id": batch.column("doc_id")[k].as_py(), "n_bytes": len(text), "n_removed": int(gone.sum()), "n_spans": len(runs), "kept_sha256": hashlib.sha256(left).hexdigest()}
                    | ({"kept": left} if with_bytes else {})
                )
            fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields + ([("kept", pa.binary())] if with_bytes else [])))

    with shuffle_cleanup(docs.sparkSession):
        found = stored(repeated_windows(rows, length, keep))
    spans = found.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = rows.join(spans, "rid", "left").select("doc_id", "text", "rid", "spans")
    if keep == "first":
        joined = _one_of_repeated(joined, length)
    return joined.select("doc_id", "text", "spans").mapInArrow(lean(run), schema)


def _one_of_repeated(rows: DataFrame, length: int) -> DataFrame:
    """``rows`` (doc_id, text, rid, spans), where of rows with one rid all but one have a span over their whole text, if it is long enough."""
    again = rows.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1")
    lone = rows.join(again, "rid", "left_anti")
    # equal rows are one before they are shuffled, with their number; all but the first are dealt out again afterwards
    one = rows.join(again.select("rid"), "rid", "left_semi").groupBy("rid").agg(*(F.first(c).alias(c) for c in ("doc_id", "text", "spans")), F.count("*").alias("n"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    whole = F.when(size >= length, F.array(F.struct(F.lit(0).cast("long").alias("a"), size.alias("b"))))
    others = one.withColumn("spans", whole).withColumn("k", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n"))))
    return lone.unionByName(one.select(lone.columns)).unionByName(others.select(lone.columns))


def op1_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))
