"""Title baselines, fallback orders and exposure inequality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators.candidates import hash_number


def popular_order(items: DataFrame) -> DataFrame:
    """``items`` (item_id, title, popularity) with ``at``: their place, from 1, by popularity descending, title, item_id.

    Items are ordered among those of one popularity and shifted by how many have more, so only the distinct counts meet in one window.
    """
    sizes = items.groupBy("popularity").agg(F.count("*").alias("c"))
    above = sizes.select("popularity", (F.sum("c").over(W.orderBy(F.desc("popularity"))) - F.col("c")).alias("above"))
    inside = F.row_number().over(W.partitionBy("popularity").orderBy("title", "item_id"))
    return items.join(above, "popularity").withColumn("at", F.col("above") + inside).drop("above")


def popular_title(examples: DataFrame, items: DataFrame) -> DataFrame:
    """example_id, item_id, title, confidence: the most popular item that isn't in the history; if all are, the most popular one.

    ``examples``: example_id, history; ``items``: item_id, title, popularity. Confidence is log1p(popularity) over log1p of the largest one,
    0.5 if that is 0. The answer's place is the least that no history item has, so examples meet items by place only.
    """
    ordered = popular_order(items)
    seen = examples.select("example_id", F.explode("history").alias("item_id")).join(ordered.select("item_id", "at"), "item_id")
    seen = seen.groupBy("example_id").agg(F.array_sort(F.collect_set("at")).alias("taken"))
    # the first place k (from 0) at which the k-th place taken isn't k + 1
    gap = F.filter(F.transform("taken", lambda x, k: F.when(x != k + 1, k + 1)), lambda x: x.isNotNull())
    ends = items.agg(F.count("*").alias("n_items"), F.max("popularity").alias("most"))  # one row
    rows = examples.select("example_id").join(seen, "example_id", "left").join(F.broadcast(ends), F.lit(True))
    wanted = F.coalesce(F.get(gap, F.lit(0)), F.size("taken") + 1)
    wanted = F.when(F.col("taken").isNull() | (wanted > F.col("n_items")), 1).otherwise(wanted)
    found = rows.select("example_id", "most", wanted.cast("long").alias("at")).join(ordered, "at")
    confidence = F.when(F.col("most") > 0, F.log1p("popularity") / F.log1p("most")).otherwise(0.5)
    return found.select("example_id", "item_id", "title", confidence.alias("confidence"))


def ranking_confidence(score: str, scores: str, rank: str) -> Column:
    """Of a chosen candidate: softmax of its score among all scores (two or more), else the sigmoid of its score, else 1 / sqrt(rank); within [0, 1]."""
    known = F.filter(scores, lambda x: x.isNotNull())
    top = F.array_max(known)
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    value = (
        F.when(F.col(score).isNotNull() & (F.size(known) >= 2), F.exp(F.col(score) - top) / total)
        .when(F.col(score).isNotNull(), 1 / (1 + F.exp(-F.col(score)))).otherwise(1 / F.sqrt(F.greatest(F.col(rank), F.lit(1))))
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def ranked_title(rankings: DataFrame, examples: DataFrame, items: DataFrame) -> DataFrame:
    """example_id, item_id, selected_rank, confidence: the first item of an outside ranking that is in the catalog and not in the history.

    ``rankings``: example_id, rank (from 1), item_id, score (maybe null); the first place of a repeated item counts. Inputs without
    any such item aren't returned (``popular_title`` serves them).
    """
    rows = rankings.groupBy("example_id", "item_id").agg(F.min(F.struct("rank", "score")).alias("x")).select("example_id", "item_id", "x.rank", "x.score")
    rows = rows.join(items.select("item_id").distinct(), "item_id", "left_semi").join(examples.select("example_id", "history"), "example_id")
    rows = rows.where(~F.array_contains("history", F.col("item_id")))
    best = rows.groupBy("example_id").agg(F.min(F.struct("rank", "item_id", "score")).alias("b"), F.collect_list("score").alias("scores"))
    best = best.select("example_id", "b.item_id", F.col("b.rank").alias("selected_rank"), F.col("b.score").alias("score"), "scores")
    return best.select("example_id", "item_id", "selected_rank", ranking_confidence("score", "scores", "selected_rank").alias("confidence"))


def fallback_order(scored: DataFrame) -> DataFrame:
    """``scored`` (example_id, item_id, score) with ``place`` by score descending, a hash of the item alone, item_id."""
    order = W.partitionBy("example_id").orderBy(F.desc("score"), hash_number(F.concat(F.lit("0::"), "item_id")), "item_id")
    return scored.withColumn("place", F.row_number().over(order))


def primary_label(low: float = 0.5, high: float = 0.7) -> Column:
    """correct, wrong or ungrounded with high, low or intermediate confidence, of rows with confidence, correct and is_grounded."""
    kind = F.when(~F.col("is_grounded"), "ungrounded").when(F.col("correct") == 1, "correct").otherwise("wrong")
    level = F.when(F.col("confidence") >= high, "high").when(F.col("confidence") < low, "low").otherwise("intermediate")
    return F.concat_ws("_", kind, level, F.lit("confidence"))


def inequality(counts: DataFrame, value: str = "exposures") -> DataFrame:
    """One row: gini of ``value`` over all rows (zeros included) and its entropy in natural units; 0 without any.

    Values are counted first, so the only window is over distinct values.
    """
    sizes = counts.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.orderBy("v"))
    # the ranks of c equal values sum to c * (first + last) / 2
    ranked = sizes.select("v", "c", upto.alias("last")).select("v", "c", (F.col("c") * (2 * F.col("last") - F.col("c") + 1) / 2).alias("ranks"))
    out = ranked.agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("v")).alias("total"), F.sum(F.col("ranks") * F.col("v")).alias("weighted"),
        F.sum(F.when(F.col("v") > 0, F.col("c") * F.col("v") * F.ln("v"))).alias("vlogv"),
    )
    total, n = F.col("total"), F.col("n")
    gini = F.when(total > 0, 2 * F.col("weighted") / (n * total) - (n + 1) / n).otherwise(0.0)
    return out.select(gini.alias("gini"), F.when(total > 0, F.ln(total) - F.col("vlogv") / total).otherwise(0.0).alias("entropy"))
