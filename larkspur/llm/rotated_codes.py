"""Nearest neighbours by randomly rotated one-bit codes.

A vector, less the centre, is rotated at random and keeps one sign bit for each
dimension, its length, and the inner product of its direction with that of its bits. A query's
inner product with a vector is estimated from the packed bits and these scalars, with
an error bound of ERROR_WIDTH standard deviations. The best estimates are reranked exactly;
then every vector whose upper bound reaches the k-th exact score is reranked as well.

Vectors and queries are dealt out in blocks; each query block meets each vector block once,
and a meeting returns at most k rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

FIT_ROWS = 10_000  # the centre is the mean of so many rows at most
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 512
ERROR_WIDTH = 4.0
TURNS = 2  # independent rotations; their estimates are averaged
SEED = 20


@lru_cache(maxsize=16)
def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``vectors`` (n x d): packed sign bits of each rotation, lengths, correction scalars of each rotation."""
    d = vectors.shape[1]
    bits, match = [], []
    for turn in range(TURNS):
        rest = (vectors - centre) @ rotation(d, SEED + turn)
        length = np.linalg.norm(rest, axis=1)
        m = np.abs(rest).sum(axis=1) / np.sqrt(d) / np.where(length > 0, length, 1)
        bits.append(np.packbits(rest > 0, axis=1))
        match.append(np.where(m > 0, m, 1))
    return np.stack(bits), length, np.stack(match)


def estimate(bits: np.ndarray, length: np.ndarray, match: np.ndarray, queries: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors) and their error bounds."""
    d = queries.shape[1]
    about = np.zeros((len(queries), len(length)), np.float32)
    variance = np.zeros(len(length))
    for turn in range(TURNS):
        signs = np.unpackbits(bits[turn], axis=1, count=d).astype(np.float32) * 2 - 1
        turned = (queries @ rotation(d, SEED + turn)).astype(np.float32)
        about += (turned @ signs.T) * (length / match[turn] / np.sqrt(d) / TURNS).astype(np.float32)[None, :]
        variance += np.maximum(1 - match[turn] ** 2, 0) / match[turn] ** 2 / max(d - 1, 1) / TURNS**2
    spread = length * np.sqrt(variance)
    about += (queries @ centre).astype(np.float32)[:, None]
    return about, (ERROR_WIDTH * np.linalg.norm(queries, axis=1)[:, None] * spread[None, :] + 1e-5).astype(np.float32)


def exact(query: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products in double precision, dimension after dimension: equal vectors score equally."""
    total = np.zeros(columns.shape[1])
    for x, row in zip(query, columns, strict=True):
        total += x * row
    return total


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part: no nulls, finite, not zero."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.select(F.col("vec_id").cast("long"), x).where(
        "vec_id is not null and embedding is not null"
    ).where(~odd & F.exists(x, lambda v: v != 0))


def blocks(rows: DataFrame, name: str, n: int) -> DataFrame:
    """``rows`` dealt by their ids into ``n`` blocks for each dimension, one packed row each."""
    schema = f"{name} int, d int, ids binary, vectors binary"

    def gather(t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        d = t.column("d")[0].as_py()
        flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
        return pa.table(
            {
                name: pa.array([t.column(name)[0].as_py()], pa.int32()),
                "d": pa.array([d], pa.int32()),
                "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
                "vectors": pa.array([flat.reshape(-1, d)[order].tobytes()], pa.binary()),
            }
        )

    dealt = rows.withColumn("d", F.size("embedding")).withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    return dealt.groupBy(name, "d").applyInArrow(gather, schema)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each query, itself left out.

    ``rows`` and ``queries``: vec_id, embedding. Vectors that are null, zero, or hold nulls
    or non-finite components take no part; vectors of another dimension than the query's
    are no candidates. Ties go to the smaller vec_id; fewer candidates than ``k`` give
    fewer rows; repeated rows count once.
    """
    spark = rows.sparkSession
    rows, queries = usable(rows).dropDuplicates(["vec_id"]), usable(queries).dropDuplicates(["vec_id"])
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED))).limit(FIT_ROWS)
    centres = {
        d: np.array(mean)
        for d, mean in sample.select(F.size("embedding").alias("d"), F.posexplode("embedding"))
        .groupBy("d", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
        .groupBy("d").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]))
        .collect()
    }
    nb = max(1, -(-n // VECTOR_BLOCK))
    nq = max(1, -(-n // (20 * QUERY_BLOCK)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d = row["d"]
                bits, length, match = encode(np.frombuffer(row["vectors"], "<f8").reshape(-1, d), centres.get(d, np.zeros(d)))
                yield pa.RecordBatch.from_pylist([row | {"bits": bits.tobytes(), "scalars": np.vstack([length, match]).tobytes()}], schema=indexed)

    indexed = pa.schema([("block", pa.int32()), ("d", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("bits", pa.binary()), ("scalars", pa.binary())])
    coded = blocks(rows, "block", nb).mapInArrow(index, "block int, d int, ids binary, vectors binary, bits binary, scalars binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                d = row["d"]
                ids = np.frombuffer(row["ids"], "<i8")
                columns = np.ascontiguousarray(np.frombuffer(row["vectors"], "<f8").reshape(-1, d).T)
                bits = np.frombuffer(row["bits"], np.uint8).reshape(TURNS, len(ids), -1)
                scalars = np.frombuffer(row["scalars"], "<f8").reshape(1 + TURNS, -1)
                q_ids = np.frombuffer(row["q_ids"], "<i8")
                wanted = np.frombuffer(row["q_vectors"], "<f8").reshape(-1, d)
                out: list[tuple] = []
                for at in range(0, len(q_ids), 64):
                    about, error = estimate(bits, scalars[0], scalars[1:], wanted[at : at + 64], centres.get(d, np.zeros(d)))
                    for q_id, query, a, e in zip(q_ids[at : at + 64], wanted[at : at + 64], about, error, strict=True):
                        a = np.where(ids == q_id, -np.inf, a)
                        first = np.argpartition(-a, min(4 * k, len(a) - 1))[: 4 * k + 1]
                        least = np.sort(exact(query, columns[:, first[ids[first] != q_id]]))[-k:][:1]
                        near = np.flatnonzero((a + e >= (least[0] if len(least) else -np.inf)) & (ids != q_id))
                        near = np.union1d(near, first[ids[first] != q_id])
                        score = exact(query, columns[:, near])
                        best = np.lexsort((ids[near], -score))[:k]
                        out += [(int(q_id), int(ids[near[j]]), float(score[j])) for j in best]
                q, v, s = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    asked = blocks(queries, "q_block", nq).select("d", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = asked.join(coded, ["block", "d"]).repartition(spread).mapInArrow(search, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))


OP7_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v) AS score
  FROM e AS q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
