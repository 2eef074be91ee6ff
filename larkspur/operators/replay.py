"""Replay statistics as a state that can be written, merged and only then summarised.

A state has one row for each of the given keys (seed, variant): counts, sums, maps of popularity buckets, and ten bins of
confidence. States of different seeds or days merge into the state of all of their rows, without the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 10
#: What counts as confident and as doubtful.
HIGH, LOW = 0.85, 0.5
SUMS = [
    "count", "override_count", "hit_sum", "mrr_sum", "ndcg_sum", "valid_count", "hallucinated_count",
    "confidence_count", "confidence_sum", "brier_sum", "high_confidence_wrong_count", "low_confidence_correct_count",
]
MAPS = ["target_bucket_counts", "target_bucket_hits", "predicted_bucket_counts"]
ARRAYS = ["bin_counts", "bin_confidence_sums", "bin_correct_sums"]


def _with_maps(state: DataFrame, tall: DataFrame, keys: list[str]) -> DataFrame:
    """``state`` with the maps whose entries ``tall`` (keys, map, bucket, value) adds up; buckets are few."""
    entries = tall.groupBy(*keys, "map", "bucket").agg(F.sum("value").alias("value"))
    pack = lambda m: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("map") == m, F.struct("bucket", "value"))))).alias(m)
    maps = entries.groupBy(*keys).agg(*(pack(m) for m in MAPS))
    none = F.create_map().cast("map<string,double>")
    return state.join(maps, keys, "left").withColumns({m: F.coalesce(m, none) for m in MAPS})


def partial_state(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The state of ``rows``: override, hit, mrr, ndcg, valid, hallucinated, target_bucket, predicted_buckets (map bucket -> count), confidence (maybe null), correct."""
    c, right = F.col("confidence"), F.col("correct")
    has = c.isNotNull()
    total = lambda x: F.sum(F.coalesce(x.cast("double"), F.lit(0.0)))
    which = F.least(F.lit(BINS - 1), F.floor(c * BINS)).cast("int")
    binned = lambda x: F.array(*(total(F.when(has & (which == i), x)) for i in range(BINS)))
    state = rows.groupBy(*keys).agg(
        F.count("*").cast("double").alias("count"), total(F.col("override")).alias("override_count"), total(F.col("hit")).alias("hit_sum"), total(F.col("mrr")).alias("mrr_sum"),
        total(F.col("ndcg")).alias("ndcg_sum"), total(F.col("valid")).alias("valid_count"), total(F.col("hallucinated")).alias("hallucinated_count"),
        total(has).alias("confidence_count"), total(c).alias("confidence_sum"), total(F.pow(c - right.cast("double"), 2)).alias("brier_sum"),
        total((c >= HIGH) & ~right).alias("high_confidence_wrong_count"), total((c < LOW) & right).alias("low_confidence_correct_count"),
        binned(F.lit(1.0)).alias("bin_counts"), binned(c).alias("bin_confidence_sums"), binned(right.cast("double")).alias("bin_correct_sums"),
    )
    one = rows.select(*keys, F.col("target_bucket").alias("bucket"), F.col("hit").cast("double").alias("hit"))
    tall = one.select(*keys, F.explode(F.array(F.struct(F.lit(MAPS[0]).alias("map"), "bucket", F.lit(1.0).alias("value")), F.struct(F.lit(MAPS[1]).alias("map"), "bucket", F.col("hit").alias("value")))).alias("x"))
    seen = rows.select(*keys, F.explode("predicted_buckets").alias("bucket", "n")).select(*keys, F.struct(F.lit(MAPS[2]).alias("map"), "bucket", F.col("n").cast("double").alias("value")).alias("x"))
    return _with_maps(state, tall.unionByName(seen).select(*keys, "x.*").where("bucket is not null"), keys)


def merged_state(states: DataFrame, keys: list[str]) -> DataFrame:
    """The state of all rows behind ``states``, by fewer keys: sums, bins and maps add up."""
    arrays = [F.array(*(F.sum(F.get(a, F.lit(i))) for i in range(BINS))).alias(a) for a in ARRAYS]
    state = states.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in SUMS), *arrays)
    tall = None
    for m in MAPS:
        part = states.select(*keys, F.lit(m).alias("map"), F.explode(m).alias("bucket", "value"))
        tall = part if tall is None else tall.unionByName(part)
    return _with_maps(state, tall, keys)


def summary(states: DataFrame) -> DataFrame:
    """Rates of a state: means over its rows, ece and brier over the rows with a confidence (0 without any), recall of target buckets (null if a bucket has no target)."""
    per: Column = F.try_divide
    share = lambda a, b="count": F.coalesce(per(F.col(a), F.col(b)), F.lit(0.0))
    at = lambda a, i: F.get(a, i)
    gap = F.aggregate(
        F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0.0),
        lambda s, i: s + F.when(at("bin_counts", i) > 0, F.abs(at("bin_correct_sums", i) - at("bin_confidence_sums", i)) / F.col("confidence_count")).otherwise(0.0),
    )
    recall = lambda b: per(F.coalesce(F.col("target_bucket_hits")[b], F.lit(0.0)), F.col("target_bucket_counts")[b])
    kept = [c for c in states.columns if c not in (*SUMS, *MAPS, *ARRAYS)]
    whole = ["count", "override_count", "high_confidence_wrong_count", "low_confidence_correct_count"]
    return states.select(
        *kept, *(F.col(c).cast("long").alias(c) for c in whole), share("override_count").alias("override_rate"), share("hit_sum").alias("recall"), share("mrr_sum").alias("mrr"),
        share("ndcg_sum").alias("ndcg"), share("valid_count").alias("validity_rate"), share("hallucinated_count").alias("hallucination_rate"),
        per(F.col("confidence_sum"), F.col("confidence_count")).alias("mean_confidence"), gap.alias("ece"), share("brier_sum", "confidence_count").alias("brier"),
        recall("tail").alias("tail_recall"), recall("head").alias("head_recall"), "target_bucket_counts", "predicted_bucket_counts",
    )
