"""Sequences, examples and splits: windows over each user's timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIMELINE = ["ts", "item_id", "l_orderkey", "l_linenumber"]


def timeline(inter: DataFrame) -> DataFrame:
    """Each user's interactions with ``idx`` (from 0, by time then item) and ``n``."""
    users = W.partitionBy("user_id")
    order = users.orderBy(F.coalesce("ts", F.lit(0.0)), *TIMELINE[1:])
    return inter.withColumn("idx", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(users))


def history(most: int | None = None) -> Column:
    """Items before the current one, oldest first, at most the last ``most``."""
    frame = W.partitionBy("user_id").orderBy("idx").rowsBetween(-most if most else W.unboundedPreceding, -1)
    return F.collect_list("item_id").over(frame)


def leave_one_out(inter: DataFrame, min_history: int = 1, train_limit: int | None = None) -> DataFrame:
    """Examples: the last item is test, the one before valid, the others train.

    Users with no more than ``min_history`` interactions are dropped; valid needs two more than
    ``min_history``; ``train_limit`` keeps the last train examples of each user.
    """
    seq = timeline(inter).withColumn("history", history()).where(F.col("n") > min_history)
    idx, n, low = F.col("idx"), F.col("n"), F.lit(min_history)
    split = (
        F.when(idx == n - 1, "test")
        .when((idx == n - 2) & (n >= min_history + 2), "valid")
        .when((idx >= low) & (idx < F.greatest(low, n - 2)), "train")
    )
    out = seq.withColumn("split", split).where("split is not null")
    if train_limit:
        late = F.row_number().over(W.partitionBy("user_id", "split").orderBy(F.desc("idx")))
        out = out.withColumn("__k", late).where((F.col("split") != "train") | (F.col("__k") <= train_limit)).drop("__k")
    return out.select(F.concat_ws(":", "user_id", "idx").alias("example_id"), "user_id", "split", "idx", "history", F.col("item_id").alias("target"), "ts")


def held_out(inter: DataFrame, min_history: int = 1) -> DataFrame:
    """The test examples of ``leave_one_out`` alone: one list of each user's items, where that makes a history for each row of a user."""
    seq = timeline(inter).where(F.col("n") > min_history)
    last = F.col("idx") == F.col("n") - 1
    before = F.collect_list(F.when(~last & F.col("item_id").isNotNull(), F.struct("idx", "item_id")))
    ends = [F.max("idx").alias("idx"), F.max(F.when(last, F.col("item_id"))).alias("target"), F.max(F.when(last, F.col("ts"))).alias("ts")]
    rows = seq.groupBy("user_id").agg(F.sort_array(before).alias("before"), *ends)
    return rows.select(F.concat_ws(":", "user_id", "idx").alias("example_id"), "user_id", F.lit("test").alias("split"), "idx", F.col("before.item_id").alias("history"), "target", "ts")


def listed(inter: DataFrame) -> DataFrame:
    """(user_id, items, ts): a row for each user, all items in the order of ``timeline``, with the time of the last. What a query needs of the timelines is told from these rows."""
    rows = F.sort_array(F.collect_list(F.struct(F.coalesce("ts", F.lit(0.0)).alias("at"), *TIMELINE[1:], "ts")))
    return inter.groupBy("user_id").agg(rows.alias("r")).select("user_id", F.col("r.item_id").alias("items"), F.element_at("r", -1)["ts"].alias("ts"))


def held_out_of(lists: DataFrame, min_history: int = 1) -> DataFrame:
    """``held_out`` from ``listed`` rows."""
    n = F.size("items")
    history = F.array_compact(F.slice("items", F.lit(1), n - 1))
    rows = lists.where(n > min_history).withColumn("idx", n - 1)
    return rows.select(F.concat_ws(":", "user_id", "idx").alias("example_id"), "user_id", F.lit("test").alias("split"), "idx", history.alias("history"), F.element_at("items", -1).alias("target"), "ts")


def unlisted(lists: DataFrame) -> DataFrame:
    """(item_id, idx, n) of each interaction behind ``listed`` rows."""
    return lists.select(F.size("items").alias("n"), F.posexplode("items").alias("idx", "item_id"))


def rolling(inter: DataFrame, min_history: int = 3, max_history: int = 10) -> DataFrame:
    """One example for each interaction from ``min_history`` on, with at most ``max_history`` items before it."""
    seq = timeline(inter).withColumn("history", history(max_history)).where(F.col("idx") >= min_history)
    start = F.greatest(F.col("idx") - max_history, F.lit(0))
    return seq.select(
        F.concat_ws(":", "user_id", "idx").alias("example_id"), "user_id", "idx", start.alias("history_start"), "history", F.col("item_id").alias("target"), "ts"
    )


def leave_last(inter: DataFrame, min_history: int = 3, max_history: int | None = None, leave: int = 2) -> DataFrame:
    """Examples from ``min_history`` on: the last item of a user is test, with ``leave`` 2 the one before it val, the others train."""
    if leave not in (1, 2):
        raise ValueError("leave must be 1 or 2")
    seq = timeline(inter).withColumn("history", history(max_history))
    idx, n = F.col("idx"), F.col("n")
    split = F.when(idx == n - 1, "test").when((idx == n - 2) & (n >= min_history + 2) & (leave == 2), "val").when(idx < F.greatest(F.lit(min_history), n - leave), "train")
    out = seq.where((n > min_history) & (idx >= min_history)).withColumn("split", split).where("split is not null")
    return out.select(F.concat_ws(":", "user_id", "idx").alias("example_id"), "user_id", "idx", "split", "history", F.col("item_id").alias("target"), "ts")


def chronological(examples: DataFrame, train: float = 0.8, valid: float = 0.1, name: str = "valid") -> DataFrame:
    """Split all examples by (ts, user_id, example_id): first int(N * train), up to int(N * (train + valid)), rest.

    The two cut points are found by counting examples per timestamp, so that only those at a cut's
    own timestamp are ordered; no task sees all rows.
    """
    n = examples.agg(F.count("*").alias("n"))
    per_ts = examples.groupBy("ts").agg(F.count("*").alias("c"))
    # cumulative counts in two steps: days, then timestamps of a day
    days = per_ts.withColumn("day", F.floor(F.col("ts") / 86400))
    day_sums = days.groupBy("day").agg(F.sum("c").alias("dc"))
    before_day = day_sums.select("day", (F.sum("dc").over(W.orderBy("day")) - F.col("dc")).alias("before_day"))
    before = days.join(before_day, "day").select(
        "ts", (F.col("before_day") + F.sum("c").over(W.partitionBy("day").orderBy("ts")) - F.col("c")).alias("before")
    )
    rank = F.col("before") + F.row_number().over(W.partitionBy("ts").orderBy("user_id", "example_id")) - 1
    placed = examples.join(before, "ts").join(F.broadcast(n), F.lit(True)).withColumn("place", rank)
    split = (
        F.when(F.col("place") < F.floor(F.col("n") * train), "train").when(F.col("place") < F.floor(F.col("n") * (train + valid)), name).otherwise("test")
    )
    return placed.withColumn("split", split).drop("before", "n", "place")


def user_sequences(inter: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(*TIMELINE, "rating")))
    out = inter.groupBy("user_id").agg(rows.alias("r"))
    return out.select("user_id", F.col("r.item_id").alias("items"), F.col("r.ts").alias("times"), F.col("r.rating").alias("ratings"))


def item_index(ids: DataFrame) -> DataFrame:
    """item_id -> 1..n in string order (0 pads)."""
    ids = ids.select("item_id").distinct()
    # a catalog has a row for each item; the rank within a leading prefix plus the prefix's offset avoids one big window
    part = ids.withColumn("p", F.substring("item_id", 1, 2))
    sizes = part.groupBy("p").agg(F.count("*").alias("c"))
    offset = sizes.select("p", (F.sum("c").over(W.orderBy("p")) - F.col("c")).alias("o"))
    return part.join(offset, "p").select("item_id", (F.col("o") + F.row_number().over(W.partitionBy("p").orderBy("item_id"))).cast("int").alias("item_index"))


def padded_sequences(inter: DataFrame, most: int = 8) -> DataFrame:
    """Rolling examples whose target is taken out of the history, as left-padded item indices."""
    index = item_index(inter)
    seq = timeline(inter.join(index, "item_id"))
    frame = W.partitionBy("user_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    seq = seq.withColumn("h", F.collect_list("item_index").over(frame)).where("idx >= 1")
    kept = F.filter("h", lambda x: x != F.col("item_index"))
    last = F.slice(kept, F.greatest(F.size(kept) - most, F.lit(0)) + 1, most)
    padded = F.concat(F.array_repeat(F.lit(0), most - F.size(last)), last)
    return seq.select(F.concat_ws(":", "user_id", "idx").alias("example_id"), padded.alias("history_indices"), F.col("item_index").alias("target_index"))


def longest_train_prefix(examples: DataFrame) -> DataFrame:
    """Of each user, the train example with the longest history (ties: the last), and its whole timeline prefix."""
    best = examples.where("split = 'train'").groupBy("user_id").agg(F.max(F.struct(F.size("history").alias("n"), "idx", "history", "target")).alias("m"))
    return best.select("user_id", F.concat("m.history", F.array("m.target")).alias("prefix"))
