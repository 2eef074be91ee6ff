"""Candidate sets and hash-ordered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators import splits
from larkspur.operators.rounds import checkpointed


def hash_number(text: Column, digits: int = 8) -> Column:
    """The first hex digits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("long")


def full(examples: DataFrame, catalog: Column) -> DataFrame:
    """Catalog (an array, for small catalogs) without the history, with the target, sorted."""
    return examples.withColumn("candidates", F.array_sort(F.array_union(F.array_except(catalog, "history"), F.array("target"))))


def _asked(keys: DataFrame, indexed: DataFrame, draws: int, seed: int) -> DataFrame:
    """``keys`` (example_id, ...) with each different ``item_index`` that they draw."""
    n = indexed.agg(F.max("item_index").alias("n_items"))
    number = lambda j: hash_number(F.concat_ws(":", F.lit(str(seed)), "example_id", j.cast("string"))) % F.col("n_items") + 1
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda j: number(j).cast("int")))
    return keys.join(F.broadcast(n), F.lit(True)).select(*keys.columns, F.explode(places).alias("item_index"))


def drawn_lists(examples: DataFrame, indexed: DataFrame, draws: int, seed: int = 13) -> DataFrame:
    """``examples`` (example_id, all different, target, history, ...) with ``candidates``: seeded draws from an indexed catalog (item_id,
    item_index from 1), without the history, and the target; each item once.

    Draws meet items by index, so work grows with examples, not with the catalog. Only example_id and index travel there, and only
    example_id and item come back: each history is moved once, not once for each draw.
    """
    asked = _asked(examples.select("example_id"), indexed, draws, seed)
    found = asked.join(indexed.select("item_index", "item_id"), "item_index").groupBy("example_id").agg(F.collect_list("item_id").alias("candidates"))
    none = F.array().cast("array<string>")
    others = F.coalesce(F.array_except("candidates", "history"), none)
    return examples.join(found, "example_id", "left").select(*examples.columns, F.array_union(others, F.array("target")).alias("candidates"))


def drawn(examples: DataFrame, indexed: DataFrame, draws: int, seed: int = 13) -> DataFrame:
    """One row per example and candidate of ``drawn_lists``."""
    return drawn_lists(examples, indexed, draws, seed).select(*examples.columns, F.explode("candidates").alias("item_id"))


def drawn_known(examples: DataFrame, indexed: DataFrame, known: DataFrame, draws: int, moves: DataFrame | None = None, seed: int = 13) -> DataFrame:
    """``drawn_lists`` with what is known of each candidate: ``candidates`` are structs of item_id, popularity and n, null where nothing is known.

    ``known``: item_id, popularity; ``moves``: src, dst, n, for n of the candidate after the last item of the history (null without ``moves``). Draws meet all of
    it on their one way to the catalog and back, so no row for an example and candidate travels a second time.
    """
    past = [F.try_element_at("history", F.lit(-1)).alias("src")] if moves else []
    keys = examples.select("example_id", *past)
    drawn = _asked(keys, indexed, draws, seed).join(indexed.select("item_index", "item_id").join(known, "item_id", "left"), "item_index").drop("item_index").withColumn("is_target", F.lit(False))
    own = examples.select("example_id", *past, F.col("target").alias("item_id"))
    rows = drawn.unionByName(own.join(known, "item_id", "left").withColumn("is_target", F.lit(True)))
    rows = rows.join(moves.withColumnRenamed("dst", "item_id"), ["src", "item_id"], "left") if moves else rows.withColumn("n", F.lit(None).cast("long"))
    met = rows.groupBy("example_id").agg(F.collect_list(F.struct("item_id", "popularity", "n", "is_target")).alias("met"))
    out = F.filter("met", lambda c: c["is_target"] | ~(F.coalesce(F.array_contains("history", c["item_id"]), F.lit(False)) | c["item_id"].eqNullSafe(F.col("target"))))
    told = F.transform(out, lambda c: F.struct(c["item_id"].alias("item_id"), c["popularity"].alias("popularity"), c["n"].alias("n")))
    return examples.join(met, "example_id").select(*examples.columns, told.alias("candidates"))


def hash_sample(rows: DataFrame, key: Column, item: str, k: int, group: list[str]) -> DataFrame:
    """``k`` rows of each group in order of sha256(key:item)."""
    order = W.partitionBy(*group).orderBy(F.sha2(F.concat_ws(":", key, F.col(item)), 256), item)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


#: Contrast roles, in the order in which negatives are taken.
ROLES = ["history_echo_probe", "head_bias_probe", "tail_underconfidence_probe", "mid_popularity_probe", "stable_negative"]


def stratified(rows: DataFrame, k: int) -> DataFrame:
    """``k`` negatives of an example: the first in hash order of each role, roles in order, then others in the hash order of the fill.

    ``rows``: example_id, item_id, role. The hashed texts are example:role:item and example:fill:item. Examples with ``k`` rows or
    fewer keep them all, by item_id.
    """
    hashed = lambda kind: F.sha2(F.concat_ws(":", "example_id", kind, "item_id"), 256)
    place = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    first = F.row_number().over(W.partitionBy("example_id", "role").orderBy(hashed("role"), "item_id")) == 1
    few = F.count("*").over(W.partitionBy("example_id")) <= k
    rows = rows.withColumn("first", first).withColumn("few", few)
    order = W.partitionBy("example_id").orderBy(
        F.when(F.col("few"), 0).when(F.col("first"), place).otherwise(99), F.when(F.col("few"), F.col("item_id")).otherwise(hashed(F.lit("fill"))), "item_id"
    )
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("first", "few")


def listwise_panel(rows: DataFrame, size: int = 12) -> DataFrame:
    """Target first, with it up to size / 2 most popular, then the least popular; ties in hash order (example:head:item, example:tail:item).

    ``rows``: example_id, target, item_id, popularity.
    """
    hashed = lambda kind: F.sha2(F.concat_ws(":", "example_id", F.lit(kind), "item_id"), 256)
    is_target = F.col("item_id") == F.col("target")
    mine = F.max(F.when(is_target, 1).otherwise(0)).over(W.partitionBy("example_id"))
    top = F.row_number().over(W.partitionBy("example_id", is_target).orderBy(F.desc("popularity"), hashed("head"), "item_id"))
    low = F.row_number().over(W.partitionBy("example_id", is_target).orderBy("popularity", hashed("tail"), "item_id"))
    rows = rows.withColumn("mine", mine).withColumn("top", top).withColumn("low", low)
    rows = rows.withColumn("part", F.when(is_target, 0).when(F.col("top") <= size // 2 - F.col("mine"), 1).otherwise(2))
    order = W.partitionBy("example_id").orderBy("part", F.when(F.col("part") == 1, F.col("top")).otherwise(F.col("low")))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).drop("mine", "top", "low", "part")


def shuffled_first(seed: int, n: int, take: int) -> list[int]:
    """The first ``take`` of ``range(n)`` as ``random.Random(seed).shuffle`` orders it, without moving anything.

    The shuffle swaps places i and j(i) <= i for i from n - 1 down to 1; j(i) is the first of the generator's numbers, cut to the bits of
    i + 1, that isn't above i. All are told in arrays; the first places are then followed back through the swaps that touch them.
    """
    import random

    import numpy as np

    state = random.Random(seed).getstate()[1]
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    raw, at = np.zeros(0, np.uint32), 0
    swaps, i, small = np.zeros(n, np.int32), n - 1, 512
    while i >= small:
        k = (i + 1).bit_length()
        low, many = max(small, (1 << (k - 1)) - 1), min(max(1 << (k - 4), 512), 1 << 14)
        if len(raw) - at < many:
            raw, at = np.concatenate([raw[at:], bits.random_raw(max(many, min(3 * i // 2, 1 << 16))).astype(np.uint32)]), 0
        r = (raw[at : at + many] >> np.uint32(32 - k)).astype(np.int32)
        taken = r <= i
        while True:  # how many were taken before decides what is taken; the sequence that agrees with itself is the only one
            again = r <= i - (np.cumsum(taken, dtype=np.int32) - taken)
            if np.array_equal(again, taken):
                break
            taken = again
        found = np.flatnonzero(taken)[: i - low + 1]
        at += int(found[-1]) + 1 if len(found) == i - low + 1 else many
        swaps[i - len(found) + 1 : i + 1] = r[found][::-1]
        i -= len(found)

    def numbers():
        for x in range(at, len(raw), 1024):
            yield from raw[x : x + 1024].tolist()
        while True:
            yield int(bits.random_raw())

    rest = numbers()
    for i in range(i, 0, -1):
        r = i + 1
        while r > i:
            r = next(rest) >> (32 - (i + 1).bit_length())
        swaps[i] = r
    came = {p: p for p in range(min(take, n))}  # where it was -> place in the result
    for i in range(1, min(small, n)):
        j = int(swaps[i])
        if j != i:
            a, b = came.pop(i, None), came.pop(j, None)
            came |= ({j: a} if a is not None else {}) | ({i: b} if b is not None else {})
    start = small
    while start < n:
        stop = min(2 * start, n)
        part, live = swaps[start:stop], np.zeros(stop, bool)
        live[list(came)] = True
        first: dict[int, int] = {}
        for x in np.flatnonzero(live[part]).tolist():
            first.setdefault(int(part[x]), x)
        for j, x in first.items():
            p = came.pop(j)
            while True:
                later = np.flatnonzero(part[x + 1 :] == start + x)
                if not len(later):
                    break
                x += 1 + int(later[0])
            came[start + x] = p
        start = stop
    return [x for x, _ in sorted(came.items(), key=lambda y: y[1])]


def seeded(examples: DataFrame, items: DataFrame, size: int, seed: int = 13) -> DataFrame:
    """``examples`` (example_id, all different, target, history, ...) with sorted ``candidates``: those of ``attached`` with ``size``, for a catalog of any size.

    Tasks hold numbers, not the catalog: an item is its rank, and the shuffle is followed back from its first places. The numbers that it
    draws are still one for each pair of example and item, as the generator can't be asked for later ones alone.
    """
    import hashlib

    import pandas as pd

    if size < 1:
        raise ValueError("a sample needs one candidate at least")
    ranks = checkpointed(splits.item_index(items.where("item_id is not null")).select("item_id", (F.col("item_index") - 1).alias("rank")))
    n = ranks.count()
    out = examples.select("example_id", F.explode(F.array_append(F.coalesce("history", F.array().cast("array<string>")), F.col("target"))).alias("item_id"))
    out = out.join(ranks, "item_id", "left").groupBy("example_id").agg(F.array_sort(F.collect_set("rank")).alias("out"))

    def pick(frames):
        for frame in frames:
            told = []
            for example_id, past in zip(frame["example_id"], frame["out"], strict=True):
                key = int(hashlib.sha256(f"{seed}:{example_id}".encode()).hexdigest()[:16], 16)
                places = []
                for place in shuffled_first(key, n - len(past), size - 1):
                    for rank in past:
                        place += place >= rank
                    places.append(int(place))
                told.append(places)
            yield pd.DataFrame({"example_id": frame["example_id"], "places": told})

    # so many tasks whatever the bytes: an example is little to read and long to work on
    tasks = int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = out.repartition(tasks, F.xxhash64("example_id")).mapInPandas(pick, "example_id string, places array<int>")
    found = found.select("example_id", F.explode("places").alias("rank")).join(ranks, "rank").groupBy("example_id").agg(F.collect_list("item_id").alias("found"))
    others = F.coalesce("found", F.array().cast("array<string>"))
    return examples.join(found, "example_id", "left").select(*examples.columns, F.array_sort(F.array_union(others, F.array("target"))).alias("candidates"))


MOST_ITEMS = 200_000  # of a catalog that every task holds


def attached(examples: DataFrame, items: DataFrame, size: int | None = None, seed: int = 13, include_history: bool = False) -> DataFrame:
    """``examples`` (example_id, target, history, ...) with sorted ``candidates``: the target and ``size`` - 1 others, all others if it is null.

    The others are the first of a Mersenne-Twister shuffle seeded by sha256(seed:example_id), of the sorted catalog without the history
    (unless ``include_history``) and the target: the same in any partitioning. The catalog (distinct, MOST_ITEMS at most) goes to every
    task; use ``seeded``, ``drawn`` or ``hash_sample`` for larger ones.
    """
    import hashlib
    import random

    import pandas as pd

    if size is not None and size < 1:
        raise ValueError("a sample needs one candidate at least")
    known = [r[0] for r in items.select("item_id").where("item_id is not null").distinct().limit(MOST_ITEMS + 1).collect()]
    if len(known) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items")
    catalog = sorted(known)

    def pick(frames):
        for frame in frames:
            out = []
            for example_id, target, history in zip(frame["example_id"], frame["target"], frame["history"], strict=True):
                past = set() if include_history or history is None else set(history)
                others = [i for i in catalog if i not in past and i != target]
                if size is not None:
                    random.Random(int(hashlib.sha256(f"{seed}:{example_id}".encode()).hexdigest()[:16], 16)).shuffle(others)
                    others = others[: size - 1]
                out.append(sorted({*others, target}))
            yield pd.DataFrame({"example_id": frame["example_id"], "candidates": out})

    found = examples.select("example_id", "target", "history").mapInPandas(pick, "example_id string, candidates array<string>")
    return examples.join(found, "example_id")
