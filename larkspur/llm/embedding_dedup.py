"""Near-duplicate embeddings by product quantisation.

Vectors are scaled to length 1, where a cosine of ``least`` or more is a distance of r = sqrt(2 - 2 * least) or less.
Coarse centroids cut the space into inverted lists; within its list a vector is told by the codes of its residual in small
subspaces, and by how far the coded place is from it. A vector visits its own list and every list whose border it is near;
there its distances to all coded places are summed from one table per subspace. A resident is compared further
unless that distance exceeds r by more than the resident's own coding error, which no linked one's can; then the exact
cosine in double precision decides.

Probes. Of two linked vectors on both sides of a border one is within half of their distance across it. So
a vector visits the lists whose borders are within WIDTH * r / sqrt(d) / 2, where r / sqrt(d) is the standard deviation, across a
border, of a step of length r in a random direction; with ``width`` = sqrt(d) the search is exact. Nothing else is left out: there are no caps on
lists, candidates or partners.

Equal vectors are one class with a count. Lists are cut into blocks, and so are their visitors; blocks meet in tasks
of bounded size. A meeting returns at most one row for each of its classes: how many vectors it found linked, and the
class that it is joined to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import if_small, stored, table
from .components import components

LEAST, WIDTH = 0.95, 4.0
#: Centroids and codebooks are fitted on so many vectors at most (those of least hash), and so many numbers.
FIT_ROWS, FIT_VALUES = 32_768, 1 << 22
MOST_LISTS, ROWS_PER_LIST = 1024, 32  # lists: about the square root of the vectors; fitted rows for each
SUBSPACE, CODES = 4, 256  # dimensions of a subspace, codes in it
BLOCK_VALUES = 1 << 18  # numbers in a block of residents or visitors
HOT = 10_000  # rows of a class from which on its members are told by broadcast
SEED = 13


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centres)."""
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T, 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[a : a + 4096], centres).argmin(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` centres of ``x`` (fewer if ``x`` has fewer different rows); centres that lose all rows stay where they are."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(SEED).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds if len(centres) < len(x) else 0):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class Quantiser:
    """Coarse centres, and the codebook of residuals of each subspace."""

    centres: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def fit(cls, unit: np.ndarray, lists: int) -> Quantiser:
        centres = k_means(unit, lists)
        rest = unit - centres[nearest(unit, centres)]
        return cls(centres, [k_means(part, CODES) for part in cls.parts(rest)])

    @classmethod
    def blank(cls, d: int) -> Quantiser:
        """For dimensions without fitted rows: one list, one code."""
        return cls(np.zeros((1, d)), [np.zeros((1, part.shape[1])) for part in cls.parts(np.zeros((1, d)))])

    @staticmethod
    def parts(x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, max(1, x.shape[1] // SUBSPACE), axis=1)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of each vector."""
        lists = nearest(unit, self.centres)
        parts = self.parts(unit - self.centres[lists])
        codes = np.stack([nearest(part, book) for part, book in zip(parts, self.books, strict=True)], axis=1).astype(np.uint8)
        lost = sum(((part - book[codes[:, m]]) ** 2).sum(1) for m, (part, book) in enumerate(zip(parts, self.books, strict=True)))
        return lists, codes, np.sqrt(lost)

    def gaps(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """How far each vector is from its list's borders to all lists (rows x lists; 0 to its own)."""
        far = distances(unit, self.centres)
        apart = 2 * np.sqrt(distances(self.centres, self.centres))[lists]
        own = np.take_along_axis(far, lists[:, None], 1)
        return np.where(apart > 0, (far - own) / np.where(apart > 0, apart, 1), np.where(np.arange(len(self.centres)) == lists[:, None], 0, np.inf))

    def tables(self, unit: np.ndarray, home: int) -> list[np.ndarray]:
        """For each subspace, squared distances of each vector's residual in list ``home`` to all codes."""
        return [distances(part, book) for part, book in zip(self.parts(unit - self.centres[home]), self.books, strict=True)]


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, as squares may leave the range of doubles."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows of equal place, dimension after dimension in double precision."""
    dot, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for a, b in zip(x.T, y.T, strict=True):
        dot, xx, yy = dot + a * b, xx + a * a, yy + b * b
    return dot / (np.sqrt(xx) * np.sqrt(yy))


class Groups:
    """Union-find over places, by vectorised rounds."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while (self.up != self.up[self.up]).any():
                self.up = self.up[self.up]


def usable(rows: DataFrame, vector: Column) -> DataFrame:
    """(vec_id, x, k1, k2) of rows that take part: an id, no nulls, finite, not zero; k1 and k2 tell the vector."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("x"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(~odd & F.exists("x", lambda v: v != 0))
    return rows.select("vec_id", F.col("x").cast("array<double>").alias("x"), F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(1), "x").alias("k2"))


def fitted(classes: DataFrame, n: int) -> dict[int, Quantiser]:
    """A quantiser for each dimension, from FIT_ROWS vectors of least hash (a bounded sample)."""
    widest = classes.agg(F.max("d")).first()[0] or 1
    rows = classes.orderBy(F.xxhash64("k1", F.lit(SEED)), "k2").limit(max(1, min(FIT_ROWS, FIT_VALUES // widest))).select("d", "x").toPandas()
    found = {}
    for d, part in rows.groupby("d"):
        lists = min(MOST_LISTS, round(np.sqrt(n)), len(part) // ROWS_PER_LIST)
        found[int(d)] = Quantiser.fit(units(np.stack(part["x"].to_numpy())), max(1, lists))
    return found


def found_links(classes: DataFrame, least: float = LEAST, width: float = WIDTH) -> DataFrame:
    """(id, k1, found, root) from meetings of blocks of ``classes`` (id, k1, k2, n, d, x): linked vectors of other classes, and a class in the same component."""
    total = classes.count()
    models = fitted(classes, total)
    reach = np.sqrt(max(2 - 2 * least, 0)) + 1e-6
    model = lambda d: models.get(d) or Quantiser.blank(d)
    margin = lambda d: min(width / np.sqrt(d), 1.0) * reach / 2
    matrix = lambda column: np.stack(column.to_numpy())

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, part in frame.groupby("d"):
                q, unit = model(d), units(matrix(part["x"]))
                lists, codes, error = q.encode(unit)
                near = q.gaps(unit, lists) <= margin(d)
                near[np.arange(len(part)), lists] = True
                yield part.assign(home=lists, code=[c.tobytes() for c in codes], error=error, visits=[np.flatnonzero(row) for row in near])

    shape = "id long, k1 long, k2 long, n long, d int, x array<double>"
    coded = stored(classes.select("id", "k1", "k2", "n", "d", "x").mapInPandas(encode, f"{shape}, home int, code binary, error double, visits array<int>"))
    # blocks of each list, of residents and of visitors
    count = lambda of: coded.select("d", of).groupBy("d", "list").agg(F.count("*").alias("n"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) * F.col("d") / BLOCK_VALUES)).cast("int")
    residents, visitors = count(F.col("home").alias("list")), count(F.explode("visits").alias("list"))
    grid = visitors.withColumnRenamed("n", "v").join(residents.withColumnRenamed("n", "r"), ["d", "list"]).select("d", "list", blocks("r").alias("rows"), blocks("v").alias("columns"))
    grid = if_small(stored(grid), 100_000)
    side = lambda salt, parts: F.pmod(F.xxhash64("k1", "k2", F.lit(salt)), F.col(parts)).cast("int")
    others = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    kept = ["id", "k1", "k2", "n", "home", "x"]
    stay = coded.withColumn("list", F.col("home")).join(grid, ["d", "list"]).withColumns({"row": side(0, "rows"), "column": others("columns")})
    come = coded.withColumn("list", F.explode("visits")).join(grid, ["d", "list"]).withColumns({"column": side(1, "columns"), "row": others("rows")})
    stay = stay.select("d", "list", "row", "column", F.lit(True).alias("stays"), *kept, "code", "error")
    come = come.select("d", "list", "row", "column", F.lit(False).alias("stays"), *kept, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"id": pd.array([], "int64"), "k1": pd.array([], "int64"), "found": pd.array([], "int64"), "root": pd.array([], "int64")})
        a, b = group[~group["stays"]], group[group["stays"]]
        if not len(a) or not len(b):
            return empty
        d, home = int(group["d"].iloc[0]), int(group["list"].iloc[0])
        q = model(d)
        ax, bx = matrix(a["x"]), matrix(b["x"])
        au, bu = units(ax), units(bx)
        codes = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
        limit = (reach + b["error"].to_numpy()) ** 2
        # (id, k1, k2) in one order for all: a pair whose vectors visit each other's lists is taken where the lesser one visits
        keys = np.concatenate([a[["id", "k1", "k2"]].to_numpy(), b[["id", "k1", "k2"]].to_numpy()])
        rank = np.unique(keys, axis=0, return_inverse=True)[1].reshape(-1)
        a_rank, b_rank = rank[: len(a)], rank[len(a) :]
        a_home, a_n, b_n = a["home"].to_numpy(), a["n"].to_numpy(), b["n"].to_numpy()
        b_gaps = q.gaps(bu, np.full(len(b), home)) <= margin(d)
        b_gaps[:, home] = True
        found, groups = np.zeros(rank.max() + 1, np.int64), Groups(rank.max() + 1)
        for at in range(0, len(a), 64):
            near = np.zeros((len(au[at : at + 64]), len(b)), np.float32)
            for m, t in enumerate(q.tables(au[at : at + 64], home)):
                near += t.astype(np.float32)[:, codes[:, m]]
            i, j = np.nonzero(near <= limit[None, :] + 1e-5)
            i += at
            once = (a_rank[i] != b_rank[j]) & (~b_gaps[j, a_home[i]] | (a_rank[i] < b_rank[j]))
            i, j = i[once], j[once]
            linked = cosines(ax[i], bx[j]) >= least
            i, j = i[linked], j[linked]
            np.add.at(found, a_rank[i], b_n[j])
            np.add.at(found, b_rank[j], a_n[i])
            groups.join(a_rank[i], b_rank[j])
        first = np.zeros((len(found), 3), np.int64)
        first[rank] = keys
        hit = np.flatnonzero(found)
        return pd.DataFrame({"id": first[hit, 0], "k1": first[hit, 1], "found": found[hit], "root": first[groups.up[hit], 0]})

    return stay.unionByName(come).groupBy("d", "list", "row", "column").applyInPandas(meet, "id long, k1 long, found long, root long")


def near_embeddings(rows: DataFrame, least: float = LEAST, width: float = WIDTH, vector: str = "embedding") -> DataFrame:
    """``rows`` with n_links (other vectors linked directly), component_id (least vec_id reachable) and kept (vec_id = component_id).

    Vectors that are null, zero, or hold nulls or non-finite components link with nothing, nor do vectors without vec_id
    (component_id null, kept true) or of different dimensions. Repeated rows are vectors of their own that link with each other; as they
    share a vec_id, all or none are kept. Columns of ``rows`` stay; those of the three names are replaced. An empty table
    gives an empty result. Equal vectors are told by 128 bits.
    """
    made = ("n_links", "component_id", "kept")
    columns = F.struct(*(rows[f"`{c}`"] for c in rows.columns if c.lower() not in made)).alias("row")
    taken = usable(rows, F.col(vector))
    classes = taken.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("x").alias("x")).withColumn("d", F.size("x"))
    classes = stored(classes)
    met = stored(found_links(classes, least, width))
    labels = components(met.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    found = met.groupBy("id", "k1").agg(F.sum("found").alias("found"))
    told = classes.drop("x", "d").join(found, ["id", "k1"], "left").join(labels, "id", "left")
    told = stored(told.select("k1", "k2", "n", (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("label", "id").alias("component_id")))
    own = F.struct(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64(vector).alias("k1"), F.xxhash64(F.lit(1), vector).alias("k2"))
    keyed = rows.select(columns, own.alias("own"))
    hot = told.where(F.col("n") > HOT)
    lone = told.where(F.col("n") <= HOT)
    hot_keys = if_small(hot.select("k1", "k2"), 100_000)
    keys = lambda df: df.select("row", "own", F.col("own.k1").alias("k1"), F.col("own.k2").alias("k2"))
    many = keys(keyed).join(if_small(hot, 100_000), ["k1", "k2"])
    few = keys(keyed).join(hot_keys, ["k1", "k2"], "left_anti").join(lone, ["k1", "k2"], "left")
    out = many.unionByName(few)
    # vectors that take no part have no class
    vec_id = F.col("own.vec_id")
    takes = vec_id.isNotNull() & F.col("n").isNotNull()
    component = F.when(takes, F.col("component_id")).otherwise(vec_id)
    return out.select("row.*", F.when(takes, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), (vec_id.eqNullSafe(component)).alias("kept"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


OP13_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = vec_id)::BIGINT AS n_links, least(vec_id, (SELECT min(b) FROM r WHERE r.a = vec_id))::BIGINT AS component_id,
  vec_id = least(vec_id, (SELECT min(b) FROM r WHERE r.a = vec_id)) AS kept FROM embeddings
"""
