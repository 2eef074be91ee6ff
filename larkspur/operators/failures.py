"""Why titles couldn't be grounded: several categories for each failure, what to do about them, and counts of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import grounding, similarity

#: Thresholds, statuses of failures, and the action that each category asks for.
NEAR, WEAK, SURE = 0.70, 0.40, 0.70
FAILED = ["ambiguous", "ungrounded", "out_of_catalog", "parse_failed"]
ACTIONS = {
    "generated_title_too_generic": "tighten_prompt_for_specific_catalog_title",
    "near_miss_candidate": "inspect_grounding_threshold_and_normalization",
    "weak_candidate_overlap": "inspect_prompt_catalog_alignment",
    "no_catalog_support": "consider_catalog_constrained_gate_or_retrieval_context",
    "duplicate_title_risk": "review_duplicate_title_disambiguation",
    "target_title_near_generated": "inspect_target_near_miss_grounding",
    "high_confidence_ungrounded": "prioritize_case_review_before_api_scale",
}


def duplicate_titles(catalog: DataFrame) -> DataFrame:
    """(f, count, max_popularity) of normalised titles that several items have. ``catalog``: item_id, title, popularity."""
    rows = catalog.select(T.fold_title(F.coalesce("title", F.lit(""))).alias("f"), F.coalesce("popularity", F.lit(0)).alias("popularity")).where("f != ''")
    return rows.groupBy("f").agg(F.count("*").alias("count"), F.max("popularity").alias("max_popularity")).where("count > 1")


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """One row: items, empty titles, groups of equal normalised titles, their items and share, and a map of buckets."""
    rows = catalog.select("title", F.coalesce("bucket", F.lit("unknown")).alias("bucket"), T.fold_title(F.coalesce("title", F.lit(""))).alias("f"))
    groups = rows.where("f != ''").groupBy("f").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("c"), F.lit(0)).alias("duplicate_items"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("c")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "c")))).alias("buckets"))
    whole = rows.agg(F.count("*").alias("items"), F.count_if(F.trim(F.coalesce("title", F.lit(""))) == "").alias("empty_titles"))
    out = whole.join(F.broadcast(groups), F.lit(True)).join(F.broadcast(buckets), F.lit(True))
    return out.withColumn("duplicate_share", F.coalesce(F.try_divide("duplicate_items", "items"), F.lit(0.0)))


def categories(confidence: Column, repeated: Column, f: Column, top: Column, target_ratio: Column) -> Column:
    """All categories of a failure, in their fixed order."""
    words = F.when(f == "", 0).otherwise(F.size(F.split(f, " ")))
    return F.array_compact(F.array(
        F.when(confidence >= SURE, "high_confidence_ungrounded"), F.when(repeated, "duplicate_title_risk"), F.when((words <= 2) | (F.length(f) < 8), "generated_title_too_generic"),
        F.when(top >= NEAR, "near_miss_candidate").when(top >= WEAK, "weak_candidate_overlap").otherwise("no_catalog_support"),
        F.when(target_ratio >= NEAR, "target_title_near_generated").otherwise("target_title_distant"),
    ))


def actions(found: Column) -> Column:
    """What the categories ask for, sorted, each once; a manual review if they ask for nothing."""
    told = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    asked = F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda c: told[c]), lambda a: a.isNotNull())))
    return F.when(F.size(asked) > 0, asked).otherwise(F.array(F.lit("manual_review")))


def classified(rows: DataFrame, catalog: DataFrame, k: int = 3) -> DataFrame:
    """The failures among ``rows`` with top_score, second_score, margin, target_ratio, categories and actions.

    ``rows``: title_id, title, target_title, status, item_id (grounded, null if not), confidence (maybe null). ``catalog``: item_id, title, popularity.
    A failure has no item or one of the statuses FAILED. Candidates are those of ``catalog_candidates``.
    """
    failed = rows.where(F.col("item_id").isNull() | F.lower(F.coalesce("status", F.lit(""))).isin(FAILED))
    best = grounding.catalog_candidates(failed.select("title_id", "title"), catalog, k)
    scores = best.groupBy("title_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second_score"))
    folded = failed.withColumn("f", T.fold_title(F.coalesce("title", F.lit("")))).withColumn("g", T.fold_title(F.coalesce("target_title", F.lit(""))))
    ratios = similarity.with_ratio(folded.select("f", F.col("title_id").alias("item_id"), F.col("g").alias("name"), F.lit(0).cast("long").alias("popularity"))).select(F.col("item_id").alias("title_id"), F.col("score").alias("target_ratio"))
    met = folded.join(scores, "title_id", "left").join(ratios, "title_id").join(duplicate_titles(catalog).select("f", F.lit(True).alias("repeated")), "f", "left")
    met = met.withColumn("top_score", F.coalesce("top", F.lit(0.0))).withColumn("margin", F.col("top") - F.col("second_score"))
    found = categories(F.col("confidence"), F.coalesce("repeated", F.lit(False)), F.col("f"), F.col("top_score"), F.col("target_ratio"))
    return met.withColumn("categories", found).withColumn("actions", actions(F.col("categories"))).drop("f", "g", "top", "repeated")


def review(failures: DataFrame) -> DataFrame:
    """(what, name, n): how many failures have each status, category and action."""
    told = lambda what, names: failures.select(F.lit(what).alias("what"), names.alias("name"))
    rows = told("status", F.coalesce("status", F.lit("unknown"))).unionByName(told("category", F.explode("categories"))).unionByName(told("action", F.explode("actions")))
    return rows.groupBy("what", "name").agg(F.count("*").alias("n"))


def cases(failures: DataFrame, most: int = 50) -> DataFrame:
    """The ``most`` failures to look at first: by confidence, then by the best candidate's score, then by title_id."""
    return failures.orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), F.desc("top_score"), "title_id").limit(most)
