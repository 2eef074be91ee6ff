"""Nearest titles by matching-block ratio, exactly, with upper bounds.

The ratio of two texts is twice the characters in their matching blocks over their lengths together (as difflib has it). Matching
blocks form a common subsequence, so the ratio is at most that of
  * the shorter length,
  * the characters that both have, whatever their order (the quick ratio), and
  * the longest common subsequence.
Items are opened in order of the quick ratio, and only while it reaches the k-th best ratio found so far; those that the
common subsequence rules out are never compared by blocks. Bounds are sums of the same integers divided alike, so ties stay ties.

Titles and items are packed in blocks of one length each. A block of titles meets the blocks of items from the nearest length
on in one task, row after row, and skips those whose lengths rule all of their items out. One meeting is in memory at a time.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TITLE_BLOCK, ITEM_BLOCK = 256, 4096


def ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


def longest_common(a: str, b: str, places: dict[str, int]) -> int:
    """Length of the longest common subsequence, by the bits of one integer; ``places`` holds a's characters as bits."""
    every = (1 << len(a)) - 1
    rows = every
    for c in b:
        at = rows & places.get(c, 0)
        rows = ((rows + at) | (rows - at)) & every
    return len(a) - rows.bit_count()


def places_of(a: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(a):
        found[c] = found.get(c, 0) | 1 << i
    return found


def common_characters(titles: list[str], names: list[str]) -> np.ndarray:
    """Characters that each title has in common with each name, whatever their order (titles x names)."""
    codes = lambda texts: [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    a, b = codes(titles), codes(names)
    alphabet = np.unique(np.concatenate(a)) if a else np.zeros(0, np.uint32)

    def counts(rows: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate(rows)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.searchsorted(alphabet, flat)
        known = at < len(alphabet)
        known[known] = alphabet[at[known]] == flat[known]
        cells = owner[known] * len(alphabet) + at[known]
        return np.bincount(cells, minlength=len(rows) * len(alphabet)).reshape(len(rows), -1).astype(np.uint16)

    x, y = counts(a), counts(b)
    total = np.zeros((len(titles), len(names)), np.int32)
    for c in range(len(alphabet)):
        total += np.minimum(x[:, c][:, None], y[:, c][None, :])
    return total


def meetings(titles: DataFrame, items: DataFrame) -> DataFrame:
    """(t, names, ...) rows: blocks of titles with all blocks of items, nearest lengths first; a block's rows stand together.

    ``titles``: f, all different and not empty. ``items``: name (not empty) and other columns.
    """
    counted = lambda rows, text, most: rows.groupBy(F.length(text).alias("len")).agg(F.ceil(F.count("*") / most).cast("int").alias("subs"))
    dealt = lambda rows, text, key, most: rows.withColumn("len", F.length(text)).join(F.broadcast(counted(rows, text, most)), "len").withColumn("sub", F.pmod(F.xxhash64(*key), "subs").cast("int")).drop("subs")
    lengths = counted(items, "name", ITEM_BLOCK).agg(F.collect_list(F.struct("len", "subs")).alias("lengths"))  # one row, an entry for each length
    blocks = dealt(items, "name", ["item_id"], ITEM_BLOCK).groupBy("len", "sub").agg(F.collect_list(F.struct(*items.columns)).alias("names"))
    asked = dealt(titles, "f", ["f"], TITLE_BLOCK).groupBy(F.col("len").alias("t_len"), F.col("sub").alias("t_sub")).agg(F.collect_list("f").alias("t"))
    asked = asked.join(F.broadcast(lengths), F.lit(True)).withColumn("l", F.explode("lengths")).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("l.subs") - 1)))
    met = asked.select("t_len", "t_sub", "t", F.col("l.len").alias("len"), "sub").join(blocks, ["len", "sub"])
    # so many tasks whatever the bytes: a meeting is little to read and long to work on. The key is hashed once more, as
    # rows that lie by t_len and t_sub already wouldn't be dealt again
    tasks = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(tasks, F.xxhash64("t_len", "t_sub")).sortWithinPartitions("t_len", "t_sub", F.abs(F.col("len") - F.col("t_len")), "len", "sub").select("t_len", "t_sub", "len", "t", "names")


def nearest_titles(titles: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(f, near): of each title the ``k`` items of best ratio, best first, ties by item_id; items without words have ratio 0.

    ``titles``: f, all different. ``items``: item_id, name. Items of one name are compared once, under the least item_id: the ``k`` best
    items have no more than the ``k`` best names, and of each name only the ``k`` least item_ids can be among them.
    """
    with_words = items.where("name != ''").withColumn("n", F.row_number().over(W.partitionBy("name").orderBy("item_id"))).where(F.col("n") <= k)
    named = with_words.groupBy("name").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    names = named.select(F.col("ids")[0].alias("item_id"), "name")
    first = lambda rows, name: rows.orderBy("item_id").limit(k).agg(F.collect_list("item_id").alias(name))
    fill = first(items.where("name = ''"), "blank").join(F.broadcast(first(items, "any")), F.lit(True))  # one row

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if block != (row["t_len"], row["t_sub"]):
                    block, best = (row["t_len"], row["t_sub"]), {f: [] for f in row["t"]}
                n, m = row["t_len"], row["len"]
                most = 2.0 * min(n, m) / (n + m)
                wanted = [f for f in row["t"] if len(best[f]) < k or most >= -best[f][-1][0]]
                if not wanted:
                    continue
                names = [x["name"] for x in row["names"]]
                ids = [x["item_id"] for x in row["names"]]
                common = common_characters(wanted, names)
                out = []
                for f, line in zip(wanted, common, strict=True):
                    here, places, before = best[f], places_of(f), best[f]
                    for j in np.argsort(-line, kind="stable"):
                        least = -here[-1][0] if len(here) == k else 0.0
                        if 2.0 * int(line[j]) / (n + m) < least:
                            break
                        if least and 2.0 * longest_common(f, names[j], places) / (n + m) < least:
                            continue
                        here = sorted([*here, (-ratio(f, names[j]), ids[j])])[:k]
                    best[f] = here
                    out += [(f, i, -s) for s, i in here if (s, i) not in before]
                if out:
                    f, i, s = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(i, pa.string()), pa.array(s, pa.float64())], names=["f", "item_id", "score"])

    found = meetings(titles.where("f != ''"), names).mapInArrow(search, "f string, item_id string, score double")
    place = F.row_number().over(W.partitionBy("f").orderBy(F.desc("score"), "item_id"))
    found = found.withColumn("p", place).where(F.col("p") <= k)
    found = found.join(named.withColumn("item_id", F.col("ids")[0]), "item_id").select("f", "score", F.explode("ids").alias("item_id"))
    found = found.withColumn("p", place).where(F.col("p") <= k)
    near = found.groupBy("f").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "item_id"))), lambda x: F.struct(x["item_id"].alias("item_id"), (-x["s"]).alias("score"))).alias("near"))
    zeros = F.transform(F.when(F.col("f") == "", F.col("any")).otherwise(F.col("blank")), lambda i: F.struct(i.alias("item_id"), F.lit(0.0).alias("score")))
    none = F.array().cast("array<struct<item_id:string,score:double>>")
    out = titles.join(near, "f", "left").join(F.broadcast(fill), F.lit(True))
    merged = F.array_sort(F.transform(F.concat(F.coalesce("near", none), zeros), lambda x: F.struct((-x["score"]).alias("s"), x["item_id"].alias("item_id"))))
    return out.select("f", F.slice(F.transform(merged, lambda x: F.struct(x["item_id"].alias("item_id"), (0.0 - x["s"]).alias("score"))), 1, k).alias("near"))


def within_levels(found: DataFrame, by: list, most: int) -> DataFrame:
    """The rows of ``found`` (f, n, ...) that can be among the ``most`` items of f: better levels (by the order ``by``) hold fewer than ``most`` of the ``n`` items each stands for."""
    level = W.partitionBy("f").orderBy(*by)
    sofar = F.sum("n").over(level.rangeBetween(W.unboundedPreceding, W.currentRow)) - F.sum("n").over(level.rangeBetween(W.currentRow, W.currentRow))
    return found.withColumn("ahead", sofar).where(F.col("ahead") < most).drop("ahead")


def quick_shortlist(titles: DataFrame, items: DataFrame, most: int, shared: bool) -> DataFrame:
    """(f, item_id, name, popularity): of each title the ``most`` items of best quick ratio, then popularity, then item_id; ``shared``: only those with a common word.

    ``titles``: f, all different and not empty. ``items``: item_id, name (not empty), popularity. Items of one name are compared once and
    told apart afterwards.
    """
    own = F.row_number().over(W.partitionBy("name").orderBy(F.desc("popularity"), "item_id"))
    few = items.withColumn("p", own).where(F.col("p") <= most)
    member = F.struct("p", "item_id", "popularity")
    named = few.groupBy("name").agg(F.array_sort(F.collect_list(member)).alias("members"), F.count("*").alias("n"))
    names = named.select("name", "n", F.col("name").alias("item_id"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if block != (row["t_len"], row["t_sub"]):
                    block, best = (row["t_len"], row["t_sub"]), {f: [] for f in row["t"]}
                n, m, names = row["t_len"], row["len"], row["names"]
                asked = [f for f in row["t"] if 2.0 * min(n, m) / (n + m) >= least_quick(best[f])]
                if not asked:
                    continue
                texts = [x["name"] for x in names]
                counts = [x["n"] for x in names]
                quick = 2.0 * common_characters(asked, texts) / (n + m)
                by_word: dict[str, list[int]] = {}
                for j, text in enumerate(texts):
                    for word in set(text.split()):
                        by_word.setdefault(word, []).append(j)
                out = []
                for f, line in zip(asked, quick, strict=True):
                    use = np.full(len(texts), not shared)
                    if shared:
                        use[[j for word in set(f.split()) for j in by_word.get(word, ())]] = True
                    use &= line >= least_quick(best[f])
                    good = np.flatnonzero(use)
                    levels = best[f] + [(float(line[j]), counts[j]) for j in good]
                    best[f] = kept_levels(levels, most)
                    floor = least_quick(best[f])
                    out += [(f, texts[j], counts[j], float(line[j])) for j in good if line[j] >= floor]
                if out:
                    columns = zip(*out, strict=True)
                    kinds = [pa.string(), pa.string(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["f", "name", "n", "quick"])

    def least_quick(levels: list[tuple[float, int]]) -> float:
        return levels[-1][0] if sum(n for _, n in levels) >= most else 0.0

    def kept_levels(levels: list[tuple[float, int]], most: int) -> list[tuple[float, int]]:
        """Ratios with their counts of items, best first, up to the one with which there are ``most``."""
        total: dict[float, int] = {}
        for quick, n in levels:
            total[quick] = total.get(quick, 0) + n
        kept, have = [], 0
        for quick in sorted(total, reverse=True):
            kept.append((quick, total[quick]))
            have += total[quick]
            if have >= most:
                break
        return kept

    found = meetings(titles, names).mapInArrow(search, "f string, name string, n long, quick double")
    found = within_levels(found, [F.desc("quick")], most)
    rows = found.join(named.select("name", "members"), "name").select("f", "name", "quick", F.explode("members").alias("m")).select("f", "name", "quick", "m.item_id", "m.popularity")
    order = W.partitionBy("f").orderBy(F.desc("quick"), F.desc("popularity"), "item_id")
    return rows.withColumn("p", F.row_number().over(order)).where(F.col("p") <= most).select("f", "item_id", "name", "popularity")


def grams(text: str) -> dict[str, int]:
    """Weights of a normalised text's parts: 4 for each token of two or more letters, 1 for each trigram (marked by #)."""
    joined = text.replace(" ", "")
    found = {"#" + joined[i : i + 3]: 1 for i in range(max(len(joined) - 2, 0))} or {"#" + joined: 1}
    return found | {token: 4 for token in text.split(" ") if len(token) >= 2}


def shared_parts(titles: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """(f, name, n, weight, gap): for each title the names that can hold its ``most`` items of greatest weight of shared ``grams``, then least difference in length.

    ``titles``: f, all different. ``items``: name, all different, n (items of that name). No row for a pair is moved: blocks meet, and a meeting tells
    only what its title's block hasn't seen bettered.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if block != (row["t_len"], row["t_sub"]):
                    block, best = (row["t_len"], row["t_sub"]), {f: [] for f in row["t"]}
                titles, names = row["t"], [x["name"] for x in row["names"]]
                counts = np.array([x["n"] for x in row["names"]])
                gap, weights = abs(row["t_len"] - row["len"]), np.zeros((len(titles), len(names)), np.int32)
                asked: dict[str, list[int]] = {}
                held: dict[str, list[int]] = {}
                for texts, places in ((titles, asked), (names, held)):
                    for i, text in enumerate(texts):
                        for g in grams(text):
                            places.setdefault(g, []).append(i)
                for g in asked.keys() & held.keys():
                    weights[np.ix_(asked[g], held[g])] += 1 if g.startswith("#") else 4
                out = []
                for f, line in zip(titles, weights, strict=True):
                    levels = best[f]
                    full = sum(x[2] for x in levels) >= most
                    good = np.flatnonzero((line > 0) & (line >= levels[-1][0]) if full else line > 0)
                    if not len(good):
                        continue
                    if len(good) > most:
                        good = good[line[good] >= np.partition(line[good], len(good) - most)[len(good) - most]]
                    total = {(w, g): n for w, g, n in levels}
                    for j in good:
                        total[int(line[j]), gap] = total.get((int(line[j]), gap), 0) + int(counts[j])
                    kept, have = [], 0
                    for w, g in sorted(total, key=lambda x: (-x[0], x[1])):
                        kept.append((w, g, total[w, g]))
                        have += total[w, g]
                        if have >= most:
                            break
                    best[f] = kept
                    last = (-kept[-1][0], kept[-1][1])
                    out += [(f, names[j], int(counts[j]), int(line[j]), gap) for j in good if have < most or (-int(line[j]), gap) <= last]
                if out:
                    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["f", "name", "n", "weight", "gap"])

    found = meetings(titles, items.select("name", "n", F.col("name").alias("item_id"))).mapInArrow(search, "f string, name string, n long, weight long, gap int")
    return within_levels(found, [F.desc("weight"), F.col("gap")], most)


def with_ratio(pairs: DataFrame) -> DataFrame:
    """``pairs`` (f, item_id, name, popularity) with ``score``, their matching-block ratio; equal texts are compared once."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(score=[ratio(a, b) for a, b in zip(frame["f"], frame["name"], strict=True)])

    # so many tasks whatever the bytes: a pair is little to read and long to work on
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = pairs.select("f", "name").distinct().repartition(tasks, "f", "name").mapInPandas(compare, "f string, name string, score double")
    return pairs.join(told, ["f", "name"]).select("f", "item_id", "popularity", "score")
