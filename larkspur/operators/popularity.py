"""Popularity counts, ranks and the five bucket definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def item_counts(inter: DataFrame) -> DataFrame:
    return inter.groupBy("item_id").agg(F.count("*").alias("popularity"))


def train_counts(examples: DataFrame) -> DataFrame:
    """Counts over all train histories and targets: overlapping histories count each time."""
    train = examples.where("split = 'train'")
    return train.select(F.explode(F.concat("history", F.array("target"))).alias("item_id")).groupBy("item_id").agg(F.count("*").alias("popularity"))


def train_counts_of(timeline: DataFrame) -> DataFrame:
    """``train_counts`` of leave-one-out examples in closed form: the item at idx of n is in the n - 2 - max(idx, 1) train examples from it on.

    ``timeline``: item_id, idx, n. Nothing is exploded, so a user's length counts once and not squared.
    """
    times = F.col("n") - 2 - F.greatest("idx", F.lit(1))
    return timeline.where(times > 0).groupBy("item_id").agg(F.sum(times).alias("popularity"))


def with_catalog(counts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Counts of every catalog or counted item, 0 where never seen."""
    ids = catalog.select("item_id").unionByName(counts.select("item_id")).distinct()
    return ids.join(counts, "item_id", "left").select("item_id", F.coalesce("popularity", F.lit(0)).alias("popularity"))


def ranked(counts: DataFrame) -> DataFrame:
    """``pop_rank`` (from 1 by count descending, then id) and the number of items ``n_items``.

    Items of one count are ranked among themselves and shifted by how many items have more: no window
    spans the catalog, only the few distinct counts.
    """
    sizes = counts.groupBy("popularity").agg(F.count("*").alias("c"))
    above = sizes.select(
        "popularity", (F.sum("c").over(W.orderBy(F.desc("popularity"))) - F.col("c")).alias("above"), F.sum("c").over(W.partitionBy(F.lit(0))).alias("n_items")
    )
    inside = F.row_number().over(W.partitionBy("popularity").orderBy("item_id"))
    return counts.join(above, "popularity").select("item_id", "popularity", (F.col("above") + inside).alias("pop_rank"), "n_items")


def buckets_by_fraction(ranks: DataFrame) -> DataFrame:
    """head = first max(1, ceil(.2 n)), mid = next max(1, ceil(.3 n)), rest tail; from three items on the last is tail."""
    n, r = F.col("n_items"), F.col("pop_rank")
    head, mid = F.greatest(F.lit(1), F.ceil(n * 0.2)), F.greatest(F.lit(1), F.ceil(n * 0.3))
    bucket = F.when(r <= head, "head").when(r <= head + mid, "mid").otherwise("tail")
    return ranks.withColumn("bucket", F.when((n >= 3) & (head + mid >= n) & (r == n), "tail").otherwise(bucket))


def buckets_head_tail(ranks: DataFrame, head: float = 0.2, tail: float = 0.2) -> DataFrame:
    """ceil(.2 n) from the front are head, ceil(.2 n) from the end tail (never overlapping), the rest mid."""
    n, r = F.col("n_items"), F.col("pop_rank")
    return ranks.withColumn("bucket", F.when(r <= F.ceil(n * head), "head").when(r > n - F.ceil(n * tail), "tail").otherwise("mid"))


def buckets_by_quantile(counts: DataFrame) -> DataFrame:
    """head/mid from the sorted counts at positions int(.8 n) and int(.5 n); unseen items are unknown."""
    ranks = ranked(counts)
    q = lambda f: F.max(F.when(F.col("n_items") - F.col("pop_rank") == F.floor(F.col("n_items") * f), F.col("popularity")))
    cut = ranks.agg(q(0.8).alias("q80"), q(0.5).alias("q50"))
    p = F.col("popularity")
    return ranks.join(F.broadcast(cut), F.lit(True)).select(
        "item_id", "popularity", F.when(p >= F.col("q80"), "head").when(p >= F.col("q50"), "mid").otherwise("tail").alias("bucket")
    )


def buckets_by_extremes(counts: DataFrame) -> DataFrame:
    """head at the largest count, tail at the least positive count or below, else mid."""
    ends = counts.agg(F.max("popularity").alias("hi"), F.min(F.when(F.col("popularity") > 0, F.col("popularity"))).alias("lo"))
    p = F.col("popularity")
    bucket = F.when(p >= F.col("hi"), "head").when(p <= F.coalesce("lo", F.lit(0)), "tail").otherwise("mid")
    return counts.join(F.broadcast(ends), F.lit(True)).select("item_id", "popularity", bucket.alias("bucket"))


def percentile(counts: DataFrame) -> DataFrame:
    """Share of items with at most this popularity; .5 where all are equal."""
    sizes = counts.groupBy("popularity").agg(F.count("*").alias("c"))
    upto = sizes.select("popularity", F.sum("c").over(W.orderBy("popularity")).alias("upto"), F.sum("c").over(W.partitionBy(F.lit(0))).alias("n"), F.count("*").over(W.partitionBy(F.lit(0))).alias("kinds"))
    return counts.join(upto, "popularity").select("item_id", "popularity", F.when(F.col("kinds") == 1, 0.5).otherwise(F.col("upto") / F.col("n")).alias("percentile"))
