"""Row filters, validation and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators.rounds import checkpointed


def users_with(inter: DataFrame, least: int) -> DataFrame:
    """Interactions of users with at least ``least`` of them (HAVING brought back to rows)."""
    n = inter.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return inter.join(n, "user_id")


def k_core(inter: DataFrame, user_k: int, item_k: int, most_rounds: int = 100) -> DataFrame:
    """Drop users and items below their counts, both counted on one snapshot, until nothing changes."""
    rows, before = checkpointed(inter), None
    for _ in range(most_rounds):
        n = rows.count()
        if n == before:
            return rows
        users = rows.groupBy("user_id").agg(F.count("*").alias("c")).where(F.col("c") >= user_k).select("user_id")
        items = rows.groupBy("item_id").agg(F.count("*").alias("c")).where(F.col("c") >= item_k).select("item_id")
        rows, before = checkpointed(rows.join(users, "user_id", "left_semi").join(items, "item_id", "left_semi")), n
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def items_in(items: DataFrame, inter: DataFrame) -> DataFrame:
    return items.join(inter.select("item_id").distinct(), "item_id", "left_semi")


def repeat_features(examples: DataFrame) -> DataFrame:
    """Whether and how often the target is in the history, and the history's repeats."""
    h, t = F.col("history"), F.col("target")
    distinct = F.size(F.array_distinct(h))
    return examples.select(
        "*",
        F.array_contains(h, t).alias("repeats"),
        F.size(F.filter(h, lambda x: x == t)).cast("long").alias("times"),
        (F.size(h) - distinct).cast("long").alias("duplicates"),
        distinct.cast("long").alias("distinct_items"),
    )


def repeat_targets(examples: DataFrame, policy: str) -> DataFrame:
    """policy: all, exclude or only examples whose target is in the history."""
    known = F.array_contains("history", F.col("target"))
    return {"all": examples, "exclude": examples.where(~known), "only": examples.where(known)}[policy]


def round_robin(rows: DataFrame, n: int, order: tuple[str, ...] = ("ts", "user_id", "example_id")) -> DataFrame:
    """``n`` rows taken from head, mid and tail in turn (``bucket``), each in ``order``."""
    place = F.when(F.col("bucket") == "head", 0).when(F.col("bucket") == "mid", 1).otherwise(2)
    ranked = rows.withColumn("k", F.row_number().over(W.partitionBy("bucket").orderBy(*order))).where(F.col("k") <= n)
    return ranked.orderBy("k", place).limit(n)


def history_bucket(length: Column) -> Column:
    return F.when(length <= 2, "cold_user").when(length <= 5, "warm_user").otherwise("heavy_user")


def prediction_errors(rows: DataFrame) -> DataFrame:
    """``errors`` of prediction rows: missing ids, null lists, scores of another length, confidence out of [0, 1]."""
    checks = {
        "user_id": F.coalesce(F.trim("user_id") == "", F.lit(True)),
        "target": F.coalesce(F.trim("target") == "", F.lit(True)),
        "predicted": F.col("predicted").isNull() | F.exists("predicted", lambda x: x.isNull() | (x == "")),
        "scores": F.col("scores").isNotNull() & (F.size("scores") != F.size("predicted")),
        "confidence": F.col("confidence").isNotNull() & (F.isnan("confidence") | ~F.col("confidence").between(0, 1)),
    }
    return rows.withColumn("errors", F.array_compact(F.array(*(F.when(bad, name) for name, bad in checks.items()))))


def repeated_titles(items: DataFrame) -> DataFrame:
    groups = items.groupBy(F.lower("title").alias("title_key")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("item_ids"))
    return groups.where("n > 1")
