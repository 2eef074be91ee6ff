"""Choosing fusion weights and gates on a grid under a limit of harm, and replaying the choice.

Rows are candidates: example_id, pack (train, validation or test), item_id, target, place (in the fallback's order), in_panel, parsed, fallback_score,
preference, confidence, popularity. A point of a grid reorders the panel: its items take, in the new order, the places that
panel items had. All metrics look at the target only, so for every point it is enough to know the target's new place: one array per
example holds it for the whole grid, and one aggregate per pack adds the arrays up.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grids.
WEIGHTS = {"alpha": [0.5, 0.7, 0.9, 1.0], "beta": [0.1, 0.3, 0.5, 0.7], "gamma": [0.0, 0.1, 0.2], "penalty": [0.0, 0.05, 0.1]}
GATES = {"margin": [0.0, 0.03, 0.05, 0.08, 0.1], "confidence_min": [0.5, 0.55, 0.6, 0.65, 0.7]}
HARM, TOLERANCE, DIGITS = 0.05, 1e-14, 9


def points(grid: dict[str, list[float]]) -> Column:
    """All points of a grid, an array of structs."""
    return F.array(*(F.struct(*(F.lit(v).alias(name) for name, v in zip(grid, point, strict=True))) for point in product(*grid.values())))


def panels(rows: DataFrame) -> DataFrame:
    """(example_id, pack, target, own_place, panel, slots): one row per example; panel items with their features scaled in the panel, slots their places in order.

    ``own_place`` is the target's place in the fallback's order, null if it isn't a candidate; panels of answers that couldn't be parsed are empty.
    """
    inside = F.coalesce(F.col("in_panel") & F.col("parsed"), F.lit(False))
    item = F.struct("item_id", "fallback_score", "preference", F.coalesce("confidence", F.lit(0.0)).alias("conf"), F.log1p("popularity").alias("lp"))
    own = F.max(F.when(F.col("item_id") == F.col("target"), F.col("place"))).alias("own_place")
    lists = [F.collect_list(F.when(inside, item)).alias("panel"), F.sort_array(F.collect_list(F.when(inside, F.col("place")))).alias("slots")]
    packed = rows.groupBy("example_id", "pack", "target").agg(own, *lists)  # one group, so that rows are made once and their lists need no window

    def scaled(of: str):
        low, high = F.array_min(F.col("panel")[of]), F.array_max(F.col("panel")[of])
        return lambda p: F.when(high > low, (p[of] - low) / (high - low)).otherwise(0.0)

    fb, pr, pp = scaled("fallback_score"), scaled("preference"), scaled("lp")
    told = F.transform("panel", lambda p: F.struct(p["item_id"].alias("item_id"), fb(p).alias("fb"), pr(p).alias("pr"), p["conf"].alias("conf"), pp(p).alias("pp"), p["preference"].alias("raw")))
    some = lambda c, x: F.when(F.size(c) > 0, x)
    return packed.select("example_id", "pack", "target", "own_place", some("panel", told).alias("panel"), some("slots", F.col("slots")).alias("slots"))


def _mine() -> Column:
    return F.get(F.filter("panel", lambda p: p["item_id"] == F.col("target")), F.lit(0))


def _ahead(score, mine: Column) -> Column:
    """How many panel items come before the target by ``score`` (of an item), then item_id."""
    return F.size(F.filter("panel", lambda p: (score(p) > mine) | ((score(p) == mine) & (p["item_id"] < F.col("target")))))


def fused_places(rows: DataFrame, grid: dict[str, list[float]] = WEIGHTS) -> DataFrame:
    """``panels`` rows with ``places``: the target's place for every point of weights (alpha, beta, gamma, penalty)."""
    fusion = lambda w: lambda p: F.round(w["alpha"] * p["fb"] + w["beta"] * p["pr"] + w["gamma"] * p["conf"] - w["penalty"] * p["pp"], DIGITS)
    told = rows.withColumn("mine", _mine())
    own = F.transform(points(grid), lambda w: F.struct(w.alias("w"), fusion(w)(F.col("mine")).alias("f")))
    moved = F.transform(own, lambda x: F.get("slots", _ahead(fusion(x["w"]), x["f"])))
    still = F.transform(points(grid), lambda w: F.col("own_place"))
    return told.withColumn("places", F.when(F.col("mine").isNotNull(), moved).otherwise(still)).drop("mine")


def gated_places(rows: DataFrame, grid: dict[str, list[float]] = GATES) -> DataFrame:
    """``panels`` rows with ``places``: for every gate (margin, confidence_min) the target's place by preference alone, where the best preference
    leads the next by the margin and is confident enough, else its own place. A panel of fewer than two items stays."""
    best = F.array_sort(F.transform("panel", lambda p: F.struct((-F.coalesce(p["raw"], F.lit(0.0))).alias("s"), p["item_id"].alias("item_id"), p["conf"].alias("conf"))))
    told = rows.withColumn("mine", _mine()).withColumn("best", best)
    lead = F.get("best", F.lit(1))["s"] - F.get("best", F.lit(0))["s"]
    raw = lambda p: F.coalesce(p["raw"], F.lit(0.0))
    told = told.withColumn("lead", F.round(lead, DIGITS)).withColumn("sure", F.get("best", F.lit(0))["conf"]).withColumn("free", F.get("slots", _ahead(raw, raw(F.col("mine")))))
    opened = lambda g: F.col("mine").isNotNull() & F.coalesce((F.col("lead") >= g["margin"]) & (F.col("sure") >= g["confidence_min"]), F.lit(False))
    places = F.transform(points(grid), lambda g: F.when(opened(g), F.col("free")).otherwise(F.col("own_place")))
    return told.withColumn("places", places).drop("mine", "best", "lead", "sure", "free")


def gain(place: Column, k: int = 10) -> Column:
    return F.when(place <= k, 1 / F.log2(place + 1)).otherwise(0.0)


def grid_means(rows: DataFrame, k: int = 10) -> DataFrame:
    """(pack, n, ndcg, harm): mean arrays over the points, in one aggregate for each pack."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    base = gain(F.col("own_place"), k)
    ndcg = F.transform("places", lambda p: gain(p, k))
    harm = F.transform("places", lambda p: F.when(gain(p, k) - base < -TOLERANCE, 1.0).otherwise(0.0))
    means = rows.groupBy("pack").agg(F.count("*").alias("n"), Summarizer.mean(array_to_vector(F.concat(ndcg, harm))).alias("m"))
    m = means.withColumn("m", vector_to_array("m"))
    half = (F.size("m") / 2).cast("int")
    return m.select("pack", "n", F.slice("m", F.lit(1), half).alias("ndcg"), F.slice("m", half + 1, half).alias("harm"))


def select_point(rows: DataFrame, grid: dict[str, list[float]], harm: float = HARM) -> DataFrame:
    """One row per point: its values, train_ndcg, validation_ndcg, validation_harmful_rate, constraint_met and selected.

    Selected is the best validation ndcg among the points that keep the limit of ``harm`` (if none does, among all), then
    less harm, then smaller values. Means are rounded to DIGITS places first, so that equal points stay equal.
    """
    means = grid_means(rows)
    pick = lambda pack, of: F.max(F.when(F.col("pack") == pack, F.col(of)))
    flat = means.agg(pick("train", "ndcg").alias("train"), pick("validation", "ndcg").alias("ndcg"), pick("validation", "harm").alias("harm"))
    tall = flat.select("train", "ndcg", "harm", F.posexplode(points(grid)).alias("i", "g"))
    at = lambda of: F.round(F.coalesce(F.get(of, F.col("i")), F.lit(0.0)), DIGITS)
    tall = tall.select("g.*", at("train").alias("train_ndcg"), at("ndcg").alias("validation_ndcg"), at("harm").alias("validation_harmful_rate"))
    tall = tall.withColumn("constraint_met", F.col("validation_harmful_rate") <= harm)
    order = F.struct(F.col("constraint_met"), F.col("validation_ndcg"), -F.col("validation_harmful_rate"), *(-F.col(name) for name in grid))
    best = tall.agg(F.max(order).alias("best"))  # one row
    return tall.withColumn("o", order).join(F.broadcast(best), F.lit(True)).withColumn("selected", F.col("o") == F.col("best")).drop("o", "best")


def replay(rows: DataFrame, chosen: DataFrame, grid: dict[str, list[float]], pack: str = "test", k: int = 10) -> DataFrame:
    """The selected point on another pack: its values, constraint_met, n, recall, mrr, ndcg, fallback_ndcg, beneficial, harmful, neutral, harmful_rate.

    ``rows``: panels with ``places`` of the grid; ``chosen``: the rows of ``select_point``.
    """
    names = list(grid)
    index = F.array_position(points(grid), F.struct(*(F.col(name) for name in names)))
    point = chosen.where("selected").select(*names, "constraint_met", index.cast("int").alias("i"))  # one row
    met = rows.where(F.col("pack") == pack).join(F.broadcast(point), F.lit(True)).withColumn("new", F.element_at("places", F.col("i")))
    d = gain(F.col("new"), k) - gain(F.col("own_place"), k)
    hit = F.col("new") <= k
    return met.groupBy(*names, "constraint_met").agg(
        F.count("*").alias("n"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("recall"), F.avg(F.when(hit, 1 / F.col("new")).otherwise(0.0)).alias("mrr"),
        F.avg(gain(F.col("new"), k)).alias("ndcg"), F.avg(gain(F.col("own_place"), k)).alias("fallback_ndcg"),
        F.count_if(d > TOLERANCE).alias("beneficial"), F.count_if(d < -TOLERANCE).alias("harmful"), F.count_if(F.abs(d) <= TOLERANCE).alias("neutral"),
        F.avg(F.when(d < -TOLERANCE, 1.0).otherwise(0.0)).alias("harmful_rate"),
    )
