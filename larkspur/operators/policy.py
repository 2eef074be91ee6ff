"""Uncertainty policy, override labels, panels and preference fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Default thresholds of the policy.
THRESHOLDS = {"accept": 0.7, "grounding": 0.8, "normalized": 0.5, "high": 0.85, "echo": 0.8}


def decision(t: dict[str, float] = THRESHOLDS, fallback: str = "fallback") -> Column:
    """decision and reason of rows with parse_success, grounding_success, grounding_score, confidence,
    normalized (maybe null), bucket and similarity; the first rule that fits decides."""
    c = F.coalesce("confidence", F.lit(0.0))
    high = c >= t["high"]
    rules = [
        (~F.col("parse_success"), fallback, "parse_failure"),
        (~F.col("grounding_success"), fallback, "grounding_failure"),
        (F.coalesce("grounding_score", F.lit(0.0)) < t["grounding"], fallback, "low_grounding_score"),
        (c < t["accept"], fallback, "low_confidence"),
        (F.col("normalized").isNull(), fallback, "candidate_normalized_confidence_missing"),
        (F.col("normalized") < t["normalized"], fallback, "low_candidate_normalized_confidence"),
        (high & (F.col("bucket") == "head"), "rerank", "head_item_overconfidence"),
        (high & (F.coalesce("similarity", F.lit(0.0)) >= t["echo"]), "rerank", "echo_risk"),
    ]
    out = F.struct(F.lit("accept").alias("decision"), F.lit("confidence_and_grounding_pass").alias("reason"))
    for when, d, r in reversed(rules):
        out = F.when(when, F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))).otherwise(out)
    return out


def grid_replay(rows: DataFrame, accepts: list[float], normals: list[float]) -> DataFrame:
    """Hits of every threshold pair: an accepted row shows its own item first, others keep the fallback's.

    ``rows``: confidence, normalized, own_hit, fallback_hit. The grid is a constant list, so it is exploded, and rows
    are aggregated at once.
    """
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("accept"), F.lit(n).alias("normal")) for a in accepts for n in normals)))
    tall = rows.withColumn("g", grid)
    take = (F.col("confidence") >= F.col("g.accept")) & (F.coalesce("normalized", F.lit(0.0)) >= F.col("g.normal"))
    hit = F.when(take, F.col("own_hit")).otherwise(F.col("fallback_hit")).cast("double")
    return tall.groupBy("g.accept", "g.normal").agg(F.avg(hit).alias("hit_rate"), F.avg(take.cast("double")).alias("override_rate"))


def override_outcomes(rows: DataFrame, groups: list[str] = (), tolerance: float = 1e-14) -> DataFrame:
    """beneficial, harmful and neutral changes of ndcg, and the harmful share of all rows."""
    d = F.col("ndcg_after") - F.col("ndcg_before")
    return rows.groupBy(*groups).agg(
        F.count_if(d > tolerance).alias("beneficial"), F.count_if(d < -tolerance).alias("harmful"), F.count_if(F.abs(d) <= tolerance).alias("neutral"),
        F.avg(F.when(d < -tolerance, 1.0).otherwise(0.0)).alias("harmful_rate"),
    )


def promoted(order: Column, item: Column, k: int) -> Column:
    """``item`` first, then the rest of ``order`` without it, ``k`` at most."""
    return F.slice(F.array_prepend(F.array_remove(order, item), item), 1, k)


def merged_order(rows: DataFrame) -> DataFrame:
    """Panel items take, in fused order, the places that panel items had; all others keep theirs.

    ``rows``: example_id, item_id, place, fused (place in the panel's new order, null outside the panel).
    """
    slots = rows.where("fused is not null").select("example_id", F.col("place").alias("new_place"), F.row_number().over(W.partitionBy("example_id").orderBy("place")).alias("slot"))
    moved = rows.where("fused is not null").withColumn("slot", F.row_number().over(W.partitionBy("example_id").orderBy("fused", "item_id")))
    moved = moved.join(slots, ["example_id", "slot"]).select("example_id", "item_id", F.col("new_place").alias("place"))
    return moved.unionByName(rows.where("fused is null").select("example_id", "item_id", "place"))


def normalized(value: str, group: str = "example_id") -> Column:
    """Min-max within the group; 0 where all are equal."""
    w = W.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0)


def fused(panel: DataFrame, alpha: float = 0.5, beta: float = 0.3, gamma: float = 0.1, penalty: float = 0.1) -> DataFrame:
    """alpha * fallback + beta * preference + gamma * confidence - penalty * popularity, each normalised in the panel."""
    rows = panel.withColumn("fb", normalized("fallback_score")).withColumn("pr", normalized("preference")).withColumn("lp", F.log1p("popularity"))
    rows = rows.withColumn("pp", normalized("lp"))
    rows = rows.withColumn("fusion", alpha * F.col("fb") + beta * F.col("pr") + gamma * F.col("confidence") - penalty * F.col("pp"))
    order = W.partitionBy("example_id").orderBy(F.desc(F.round("fusion", 9)), "item_id")
    return rows.withColumn("place", F.row_number().over(order)).drop("fb", "pr", "lp", "pp")


def confident_margin(panel: DataFrame, margin: float, confidence: float) -> DataFrame:
    """Examples whose best preference leads the next by ``margin`` with enough confidence."""
    order = W.partitionBy("example_id").orderBy(F.desc("preference"), "item_id")
    lead = panel.withColumn("next", F.lead("preference").over(order)).withColumn("k", F.row_number().over(order)).where("k = 1")
    return lead.withColumn("trusted", (F.col("preference") - F.coalesce("next", F.lit(0.0)) >= margin) & (F.col("confidence") >= confidence))


def oracle_rank(rows: DataFrame) -> DataFrame:
    """Best rank that reordering the panel could give the target: the panel's first place if the target is in it."""
    first = F.min(F.when(F.col("in_panel"), F.col("place")))
    mine = F.max(F.when(F.col("item_id") == F.col("target"), F.col("place")))
    inside = F.max(F.when((F.col("item_id") == F.col("target")) & F.col("in_panel"), 1).otherwise(0)) == 1
    return rows.groupBy("example_id").agg(mine.alias("rank"), F.when(inside, first).otherwise(mine).alias("oracle_rank"))
