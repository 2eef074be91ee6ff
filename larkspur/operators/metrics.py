"""Ranking, coverage, validity, diversity, novelty and long-tail metrics over prediction rows.

Prediction rows: example_id, user_id, target, candidates, predicted (best first), and any grouping columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_of(target: str = "target", predicted: str = "predicted", k: int | None = None) -> Column:
    """Place of the target among the distinct predictions, null if it isn't there (or beyond ``k``)."""
    place = F.nullif(F.array_position(F.array_distinct(predicted), F.col(target)), F.lit(0))
    return place if k is None else F.when(place <= k, place)


def ranking(rows: DataFrame, ks: list[int], groups: list[str] = ()) -> DataFrame:
    """recall, mrr and ndcg at each k: means over rows, 0 on no rows."""
    tall = rows.withColumn("k", F.explode(F.array(*map(F.lit, sorted(set(ks)))))).withColumn("r", rank_of())
    hit = F.col("r") <= F.col("k")
    mean = lambda x: F.coalesce(F.avg(F.when(hit, x).otherwise(0.0)), F.lit(0.0))
    return tall.groupBy(*groups, "k").agg(
        F.count("*").alias("n"), mean(F.lit(1.0)).alias("recall"), mean(1 / F.col("r")).alias("mrr"), mean(1 / F.log2(F.col("r") + 1)).alias("ndcg")
    )


def sliced(rows: DataFrame, slices: list[str], k: int) -> DataFrame:
    """Recall and ndcg overall and by each slice column, in one pass of grouping sets."""
    keep = rows.withColumn("r", rank_of(k=k))
    out = keep.groupingSets([[], *([F.col(s)] for s in slices)], *(F.col(s) for s in slices)).agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg(F.when(F.col("r").isNotNull(), 1.0).otherwise(0.0)).alias("recall"),
        F.avg(F.coalesce(1 / F.log2(F.col("r") + 1), F.lit(0.0))).alias("ndcg"),
    )
    name = F.lit("all")
    for s in slices:
        name = F.when(F.col(s).isNotNull(), s).otherwise(name)
    return out.select(name.alias("slice"), F.coalesce(*(F.col(s).cast("string") for s in slices), F.lit("all")).alias("value"), "n", "recall", "ndcg")


def coverage(rows: DataFrame, k: int, catalog: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Distinct top-k items over distinct candidates and over the catalog; covered rows and users. ``rows`` are read once: items and users are told apart by kind."""
    n = catalog.select("item_id").distinct().agg(F.count("*").alias("catalog"))
    tell = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("key"), (F.size("predicted") > 0).alias("covered"))
    top, seen = (F.coalesce(c, F.array().cast("array<string>")) for c in (F.slice("predicted", 1, k), F.col("candidates")))
    kinds = F.concat(F.transform(top, lambda x: tell("top", x)), F.transform(seen, lambda x: tell("seen", x)), F.array(tell("user", F.col("user_id"))))
    once = rows.select(*groups, F.explode(kinds).alias("x")).groupBy(*groups, "x.kind", "x.key").agg(F.count("*").alias("rows"), F.count_if("x.covered").alias("covered"))
    many = lambda kind: F.count_if((F.col("kind") == kind) & F.col("key").isNotNull())
    users = F.sum(F.when(F.col("kind") == "user", F.col("covered"))) / F.sum(F.when(F.col("kind") == "user", F.col("rows")))
    some = F.count_if(F.col("kind") == "top") > 0, F.count_if(F.col("kind") == "seen") > 0
    both = once.groupBy(*groups).agg(many("top").alias("top"), many("seen").alias("seen"), users.alias("row_coverage"), many("user").alias("users"), (some[0] & some[1]).alias("some"))
    if groups:  # a group without any prediction or candidate has no row, as one that is null
        both = both.where("some").where(" and ".join(f"`{g}` is not null" for g in groups))
    both = both.join(F.broadcast(n), F.lit(True))
    return both.select(*groups, (F.col("top") / F.col("seen")).alias("coverage"), (F.col("top") / F.col("catalog")).alias("catalog_coverage"), "row_coverage", "users")


def validity(rows: DataFrame, groups: list[str] = ()) -> DataFrame:
    """valid: predictions non-empty and all candidates; hallucinated: any outside (an empty list is neither)."""
    outside = F.size(F.array_except("predicted", "candidates"))
    some = F.size("predicted") > 0
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return rows.groupBy(*groups).agg(share(some & (outside == 0)).alias("valid"), share(outside > 0).alias("hallucinated"), F.count("*").alias("n"))


def diversity(rows: DataFrame, items: DataFrame, k: int, groups: list[str] = ()) -> DataFrame:
    """Share of top-k pairs with different categories, distinct categories, category entropy (bits): means over rows."""
    top = rows.select(*groups, "example_id", F.explode(F.slice("predicted", 1, k)).alias("item_id"))
    named = top.join(items.select("item_id", "category"), "item_id", "left").fillna("unknown", ["category"])
    counts = named.groupBy(*groups, "example_id", "category").agg(F.count("*").alias("c"))
    n = F.sum("c")
    per = counts.groupBy(*groups, "example_id").agg(
        n.alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.count("*").alias("categories"), (-F.sum(F.col("c") * F.log2("c"))).alias("clog")
    )
    n = F.col("n")
    pairs = F.when(n > 1, 1 - F.col("same") / (n * (n - 1))).otherwise(0.0)
    entropy = F.col("clog") / n + F.log2(n)
    return per.groupBy(*groups).agg(F.avg(pairs).alias("ild"), F.avg(F.col("categories").cast("double")).alias("categories"), F.avg(entropy).alias("entropy"))


def novelty(rows: DataFrame, ranks: DataFrame, k: int, groups: list[str] = ()) -> DataFrame:
    """Mean self-information and popularity rank over all (row, item) of the top k (micro means).

    ``ranks``: item_id, popularity, pop_rank, n_items over the catalog; unknown items rank last.
    """
    totals = ranks.agg(F.sum("popularity").alias("total"), F.max("n_items").alias("size"))
    top = rows.select(*groups, F.explode(F.slice("predicted", 1, k)).alias("item_id")).join(ranks.select("item_id", "popularity", "pop_rank"), "item_id", "left")
    top = top.join(F.broadcast(totals), F.lit(True))
    info = -F.log2((F.coalesce("popularity", F.lit(0)) + 1) / (F.col("total") + F.greatest("size", F.lit(1))))
    return top.groupBy(*groups).agg(F.avg(info).alias("self_information"), F.avg(F.coalesce("pop_rank", F.col("size") + 1).cast("double")).alias("popularity_rank"))


def long_tail(rows: DataFrame, buckets: DataFrame, k: int, groups: list[str] = ()) -> DataFrame:
    """By target bucket: hits at k; by recommended bucket: distinct recommended items over the bucket's items."""
    hits = rows.join(buckets.select(F.col("item_id").alias("target"), "bucket"), "target", "left").fillna("tail", ["bucket"])
    hits = hits.groupBy(*groups, "bucket").agg(F.avg(F.when(rank_of(k=k).isNotNull(), 1.0).otherwise(0.0)).alias("hit_rate"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size"))
    top = rows.select(*groups, F.explode(F.slice("predicted", 1, k)).alias("item_id")).join(buckets.select("item_id", "bucket"), "item_id")
    covered = top.groupBy(*groups, "bucket").agg(F.countDistinct("item_id").alias("c")).join(sizes, "bucket")
    return hits.join(covered.select(*groups, "bucket", (F.col("c") / F.col("size")).alias("bucket_coverage")), [*groups, "bucket"], "left").fillna(0.0, ["bucket_coverage"])


def over_seeds(rows: DataFrame, groups: list[str], value: str = "value") -> DataFrame:
    """Mean, sample deviation (0 for one), count and half width of the 95 % interval over seeds."""
    std = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    out = rows.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.avg(value).alias("mean"), std.alias("std"), F.count("*").alias("seeds"))
    return out.withColumn("ci95", 1.96 * F.col("std") / F.sqrt("seeds"))


def nearest_ranks(rows: DataFrame, group: str, value: str, quantiles: dict[str, float], parts: int = 200) -> DataFrame:
    """``group`` and, for each name of ``quantiles``, the sorted value at position (n - 1) q, rounded half to even; nulls don't count.

    Values are counted first. Approximate quantiles cut a group into about ``parts`` ranges; counts before each range are cumulated, and only the
    range that holds the position is ordered, so neither an array nor a window holds a group. The result is exact whatever the cuts are.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    cuts = counts.groupBy(group).agg(F.percentile_approx("v", [k / parts for k in range(1, parts)], 10_000).alias("cuts"))
    counts = counts.join(cuts, group).select(group, "v", "c", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("part"))
    sizes = counts.groupBy(group, "part").agg(F.sum("c").alias("size"))
    whole = W.partitionBy(group)
    upto = F.sum("size").over(whole.orderBy("part"))
    sizes = sizes.select(group, "part", (upto - F.col("size")).alias("before"), upto.alias("upto"), F.sum("size").over(whole).alias("n"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.bround((F.col("n") - 1) * F.lit(q)).cast("long").alias("at")) for name, q in quantiles.items())))
    wanted = sizes.select("*", wanted.alias("x")).where((F.col("x.at") >= F.col("before")) & (F.col("x.at") < F.col("upto"))).select(group, "part", "before", "x.name", "x.at")
    inside = counts.join(wanted, [group, "part"])
    passed = F.col("before") + F.sum("c").over(W.partitionBy(group, "name").orderBy("v"))
    found = inside.withColumn("passed", passed).where(F.col("passed") > F.col("at"))
    return found.groupBy(group).agg(*(F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in quantiles))
