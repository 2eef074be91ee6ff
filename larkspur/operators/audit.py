"""Audits: rows on one side only, duplicates, overlaps; comparisons of runs; case selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def artifact_check(rankings: DataFrame, inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row of counts: inputs without a ranking, rankings without an input, repeated keys, unknown items, items from the history.

    ``rankings``: example_id, items; ``inputs``: example_id, history.
    """
    missing = inputs.join(rankings, "example_id", "left_anti").agg(F.count("*").alias("missing"))
    extra = rankings.join(inputs, "example_id", "left_anti").agg(F.count("*").alias("extra"))
    repeated = rankings.groupBy("example_id").count().where("count > 1").agg(F.count("*").alias("repeated"))
    unknown = rankings.select(F.explode("items").alias("item_id")).join(catalog.select("item_id").distinct(), "item_id", "left_anti").agg(F.count("*").alias("unknown"))
    overlap = rankings.join(inputs, "example_id").agg(F.coalesce(F.sum(F.size(F.array_intersect("items", "history"))), F.lit(0)).cast("long").alias("overlap"))
    out = missing
    for one in (extra, repeated, unknown, overlap):
        out = out.crossJoin(one)  # each side is one row
    return out


def against_first(runs: DataFrame, value: str, order: str) -> DataFrame:
    """Each run's difference from the first one."""
    return runs.withColumn("delta", F.col(value) - F.first_value(value).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))


def attribution(method: DataFrame, fallback: DataFrame) -> DataFrame:
    """Rows of two methods on one example: differences of hit, mrr and whether the top lists are equal."""
    a = method.select("example_id", F.col("rank").alias("r1"), F.col("predicted").alias("p1"))
    b = fallback.select("example_id", F.col("rank").alias("r2"), F.col("predicted").alias("p2"))
    hit = lambda r: F.when(F.col(r).isNotNull(), 1).otherwise(0)
    inverse = lambda r: F.coalesce(1 / F.col(r), F.lit(0.0))
    return a.join(b, "example_id").select("example_id", (hit("r1") - hit("r2")).alias("d_hit"), (inverse("r1") - inverse("r2")).alias("d_mrr"), (F.col("p1") == F.col("p2")).alias("same_top"))


def top_cases(rows: DataFrame, kind: str, k: int, order: list) -> DataFrame:
    """The first ``k`` rows of each kind."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(kind).orderBy(*order))).where(F.col("place") <= k)


def candidate_diagnostics(grounded: DataFrame, inputs: DataFrame) -> DataFrame:
    """Place of the grounded item among an input's candidates, whether the target is among them and the item in the history."""
    both = grounded.join(inputs, "example_id", "left")
    place = F.nullif(F.array_position("candidates", F.col("item_id")), F.lit(0))
    return both.select("example_id", "item_id", place.alias("place"), F.array_contains("candidates", F.col("target")).alias("target_in_candidates"), F.array_contains("history", F.col("item_id")).alias("from_history"))
