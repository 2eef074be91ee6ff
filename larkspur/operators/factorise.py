"""Matrix factorisation with biases by stochastic gradient steps on squared error, in rotating blocks.

Users and items are dealt to ``parts`` blocks each, pairs to parts * parts blocks. An epoch has ``parts`` turns: in turn s the task
of user block b holds that block's factors, those of item block b + s, and the pairs of both, so no two tasks of a turn share a user
or an item and their steps don't disturb one another. Factors travel between turns, pairs don't change. After every
epoch the factors are written to the shared folder. A pair's steps come in another order than in one sequential pass, and that
is the only difference to it. Inside a block, pairs that share no row with an earlier one left to do are stepped together; each
row still goes through its steps in the block's order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators.rounds import checkpointed

#: Factors, epochs, step, ridge and the range of the first factors.
FACTORS, EPOCHS, STEP, RIDGE, START = 8, 25, 0.05, 0.001, 0.01
_SCHEMA = "kind string, block int, other int, n int, data binary"
_FIELDS = pa.schema([("kind", pa.string()), ("block", pa.int32()), ("other", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])


@dataclass
class Factors:
    """``users`` and ``items``: id, factors (an array), bias."""

    users: DataFrame
    items: DataFrame

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (user_id, item_id, ...) with ``score``: product of the factors and both biases; the item's bias alone for users without factors, 0 for unknown items."""
        u = self.users.select(F.col("id").alias("user_id"), F.col("factors").alias("uf"), F.col("bias").alias("ub"))
        i = self.items.select(F.col("id").alias("item_id"), F.col("factors").alias("if"), F.col("bias").alias("ib"))
        dot = F.aggregate(F.zip_with("uf", "if", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        met = rows.join(u, "user_id", "left").join(i, "item_id", "left")
        return met.withColumn("score", F.coalesce(dot + F.col("ub") + F.col("ib"), "ib", F.lit(0.0))).drop("uf", "ub", "if", "ib")


def steps(users: np.ndarray, items: np.ndarray, pairs: np.ndarray, step: float, ridge: float) -> None:
    """One pass over ``pairs`` (places of users and items), in place; the last column of a row is its bias."""
    for u, i in pairs:
        a, b = users[u], items[i]
        error = 1.0 - (a[:-1] @ b[:-1] + a[-1] + b[-1])
        moved = step * (error * b - ridge * a)
        moved[-1] = step * (error - ridge * a[-1])
        back = step * (error * a - ridge * b)
        back[-1] = step * (error - ridge * b[-1])
        a += moved
        b += back


FEW = 16  # pairs of one rank that are stepped one by one


def ranks(pairs: np.ndarray) -> np.ndarray:
    """1 for a pair whose user and item no earlier pair has, else one more than the largest rank of these earlier pairs: pairs of one rank share nothing."""
    users, items = [0] * (int(pairs[:, 0].max(initial=-1)) + 1), [0] * (int(pairs[:, 1].max(initial=-1)) + 1)
    out = np.empty(len(pairs), np.int32)
    for start in range(0, len(pairs), 1 << 16):
        told = []
        for u, i in pairs[start : start + (1 << 16)].tolist():
            a, b = users[u], items[i]
            r = (a if a > b else b) + 1
            users[u] = items[i] = r
            told.append(r)
        out[start : start + len(told)] = told
    return out


def ranked_steps(users: np.ndarray, items: np.ndarray, pairs: np.ndarray, step: float, ridge: float) -> None:
    """``steps`` over ``pairs`` in the order of their ``ranks``, all pairs of a rank at once: each row goes through the same steps in the same order as by ``steps`` in the
    order of ``pairs``, whose rows (place of user, place of item, rank) come sorted by rank."""
    ends = np.flatnonzero(np.diff(pairs[:, 2], append=-1)) + 1
    start = 0
    for end in ends.tolist():
        if end - start < FEW:
            steps(users, items, pairs[start:end, :2], step, ridge)
        else:
            u, i = pairs[start:end, 0], pairs[start:end, 1]
            a, b = users[u], items[i]
            error = 1.0 - (np.einsum("ij,ij->i", a[:, :-1], b[:, :-1]) + a[:, -1] + b[:, -1])[:, None]
            moved = step * (error * b - ridge * a)
            moved[:, -1:] = step * (error - ridge * a[:, -1:])
            back = step * (error * a - ridge * b)
            back[:, -1:] = step * (error - ridge * b[:, -1:])
            users[u], items[i] = a + moved, b + back
        start = end


def _blocks(ids: DataFrame, kind: str, parts: int, factors: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(id, block, place) of ids, and the blocks' first factors."""
    placed = ids.select("id").distinct().withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)).cast("int"))
    placed = checkpointed(placed.withColumn("place", F.row_number().over(W.partitionBy("block").orderBy("id")) - 1))

    def start(t: pa.Table) -> pa.Table:
        block, n = t.column("block")[0].as_py(), t.num_rows
        rng = np.random.default_rng([seed, block, kind == "u"])
        data = np.hstack([rng.uniform(-START, START, (n, factors)), np.zeros((n, 1))])
        return pa.Table.from_pylist([{"kind": kind, "block": block, "other": -1, "n": n, "data": data.tobytes()}], schema=_FIELDS)

    return placed, placed.groupBy("block").applyInArrow(start, _SCHEMA)


def fit(pairs: DataFrame, items: DataFrame, factors: int = FACTORS, epochs: int = EPOCHS, step: float = STEP, ridge: float = RIDGE, parts: int = 4, seed: int = 0) -> Factors:
    """Factors of the different ``pairs`` (user_id, item_id), all of which should score 1; every item of ``items`` (item_id) has factors.

    A block of pairs is held by one task: take parts so that pairs / parts**2 fit. No pairs leave the first factors.
    """
    wanted = pairs.select("user_id", "item_id").where("user_id is not null and item_id is not null").distinct()
    catalog = items.select(F.col("item_id").alias("id")).unionByName(wanted.select(F.col("item_id").alias("id"))).where("id is not null")
    user_places, user_blocks = _blocks(wanted.select(F.col("user_id").alias("id")), "u", parts, factors, seed)
    item_places, item_blocks = _blocks(catalog, "i", parts, factors, seed)
    u = user_places.select(F.col("id").alias("user_id"), "block", F.col("place").alias("u"))
    i = item_places.select(F.col("id").alias("item_id"), F.col("block").alias("other"), F.col("place").alias("i"))
    coded = wanted.join(u, "user_id").join(i, "item_id").select("block", "other", "u", "i")

    def pack(t: pa.Table) -> pa.Table:
        data = np.stack([t.column("u").to_numpy(), t.column("i").to_numpy()], 1).astype("<i4")
        data = data[np.lexsort((data[:, 1], data[:, 0]))]
        rank = ranks(data)
        data = np.column_stack([data, rank])[np.argsort(rank, kind="stable")].astype("<i4")
        return pa.Table.from_pylist([{"kind": "p", "block": t.column("block")[0].as_py(), "other": t.column("other")[0].as_py(), "n": len(data), "data": data.tobytes()}], schema=_FIELDS)

    packed = checkpointed(coded.groupBy("block", "other").applyInArrow(pack, _SCHEMA))
    state = checkpointed(user_blocks.unionByName(item_blocks))

    def turn(t: pa.Table) -> pa.Table:
        rows = {r["kind"]: r for r in t.to_pylist()}
        out = [r for r in (rows.get("u"), rows.get("i")) if r]
        if len(rows) == 3:
            grids = {k: np.frombuffer(rows[k]["data"], "<f8").reshape(rows[k]["n"], -1).copy() for k in "ui"}
            ranked_steps(grids["u"], grids["i"], np.frombuffer(rows["p"]["data"], "<i4").reshape(-1, 3), step, ridge)
            out = [rows[k] | {"data": grids[k].tobytes()} for k in "ui"]
        return pa.Table.from_pylist(out, schema=_FIELDS)

    for _ in range(epochs):
        for s in range(parts):
            task = F.when(F.col("kind") == "i", F.pmod(F.col("block") - s, F.lit(parts))).otherwise(F.col("block"))
            now = packed.where(F.col("other") == F.pmod(F.col("block") + s, F.lit(parts)))
            dealt = state.unionByName(now).withColumn("task", task).repartition(parts, "task")
            state = dealt.groupBy("task").applyInArrow(lambda t: turn(t.drop(["task"])), _SCHEMA)
        state = checkpointed(state)

    def unpack(t: pa.Table) -> pa.Table:
        kinds = pa.schema([("block", pa.int32()), ("place", pa.int32()), ("factors", pa.list_(pa.float64())), ("bias", pa.float64())])
        parts = []
        for r in t.to_pylist():
            grid = np.frombuffer(r["data"], "<f8").reshape(r["n"], -1)
            n, wide = grid.shape[0], grid.shape[1] - 1
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * wide, pa.int32()), pa.array(np.ascontiguousarray(grid[:, :-1]).ravel()))
            parts.append(pa.Table.from_arrays([pa.array(np.full(n, r["block"], np.int32)), pa.array(np.arange(n, dtype=np.int32)), lists, pa.array(grid[:, -1].copy())], schema=kinds))
        return pa.concat_tables(parts) if parts else kinds.empty_table()

    def told(kind: str, places: DataFrame) -> DataFrame:
        flat = state.where(F.col("kind") == kind).groupBy("block").applyInArrow(unpack, "block int, place int, factors array<double>, bias double")
        return places.join(flat, ["block", "place"]).select("id", "factors", "bias")

    return Factors(told("u", user_places), told("i", item_places))
