"""Rows for review and training: case tags and actions, filled rankings, panel statistics, chat rows, strict enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators.baselines import primary_label

#: What is advised for a tag.
ACTIONS = {
    "grounding_failure": ["inspect_catalog_coverage_and_title_normalization"],
    "ungrounded_high_confidence": ["tighten_prompt_to_catalog_groundable_titles", "add_or_improve_retrieval_assisted_grounding"],
    "grounding_ambiguous": ["review_grounding_thresholds_and_candidate_margin"],
    "fuzzy_grounding": ["review_grounding_thresholds_and_candidate_margin"],
    "self_verified_wrong": ["audit_self_verification_confidence_prompt"],
    "generated_more_popular_than_target": ["prioritize_popularity_confidence_residual_analysis"],
    "generated_head_target_tail": ["prioritize_popularity_confidence_residual_analysis"],
    "wrong_high_confidence_generated_head": ["prioritize_popularity_confidence_residual_analysis"],
    "wrong_high_confidence": ["prioritize_overconfidence_case_review"],
    "correct_low_confidence_tail": ["prioritize_tail_underconfidence_calibration"],
    "correct_low_confidence": ["preserve_hard_positive_before_naive_pruning"],
}
OTHERWISE = "monitor_in_aggregate"
BUCKETS = ("head", "mid", "tail")
MISSING = 999  # the place of a target that an answer leaves out


def tags(low: float = 0.5, high: float = 0.7, ambiguity: float = 0.5, ratio: float = 2.0) -> Column:
    """Sorted tags of rows with confidence, correct, is_grounded, status, ambiguity, verified, bucket, popularity, made_bucket and made_popularity."""
    c = F.col
    sure, unsure, right = c("confidence") >= high, c("confidence") < low, c("correct") == 1
    rules = {
        "self_verified_wrong": c("verified") & ~right,
        "grounding_failure": ~c("is_grounded"),
        "fuzzy_grounding": c("is_grounded") & (c("status") == "fuzzy"),
        "grounding_ambiguous": F.coalesce("ambiguity", F.lit(0.0)) >= ambiguity,
        "generated_more_popular_than_target": (c("made_popularity") > 0) & (c("made_popularity") >= ratio * F.greatest(c("popularity"), F.lit(1))),
        "generated_head_target_tail": (c("made_bucket") == "head") & (c("bucket") == "tail"),
        "wrong_high_confidence_generated_head": ~right & sure & (c("made_bucket") == "head"),
        "correct_low_confidence_tail": right & unsure & (c("bucket") == "tail"),
    }
    named = [F.when(rule, tag) for tag, rule in rules.items()]
    named += [F.when(c(column).isin(*BUCKETS), F.concat(F.lit(side), c(column))) for column, side in (("bucket", "target_"), ("made_bucket", "generated_"))]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(primary_label(low, high), *named))))


def actions(tag_list: str = "tags") -> Column:
    """Sorted actions that the tags call for."""
    advised = F.create_map(*(x for tag, todo in ACTIONS.items() for x in (F.lit(tag), F.array(*map(F.lit, todo)))))
    found = F.flatten(F.transform(tag_list, lambda t: F.coalesce(F.try_element_at(advised, t), F.array().cast("array<string>"))))
    return F.when(F.size(found) > 0, F.array_sort(F.array_distinct(found))).otherwise(F.array(F.lit(OTHERWISE)))


def filled_ranking(ranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """example_id, item_id, place, score: ranked items that are candidates, at their first place, then the other candidates with score 0.

    ``ranked``: example_id, rank, item_id (null if not grounded), score (maybe null); ``candidates``: example_id, item_id, at (their order).
    """
    first = ranked.where("item_id is not null").groupBy("example_id", "item_id").agg(F.min(F.struct("rank", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("r"))
    once = candidates.groupBy("example_id", "item_id").agg(F.min("at").alias("at"))
    rows = once.join(first, ["example_id", "item_id"], "left")
    order = W.partitionBy("example_id").orderBy(F.asc_nulls_last("r.rank"), "at", "item_id")
    return rows.select("example_id", "item_id", F.row_number().over(order).alias("place"), F.coalesce("r.score", F.lit(0.0)).alias("score"))


def candidate_summary(rows: DataFrame, keys: list[str], high: float = 0.7) -> DataFrame:
    """Counts and rates of answers with candidates: chosen among them, grounded elsewhere, not grounded, from the history.

    ``rows``: ``keys``, place (of the grounded item among the candidates, or null), item_id (null if not grounded), target_in_candidates,
    from_history, confidence, correct. Rates are over all rows of a group.
    """
    chosen, grounded = F.col("place").isNotNull(), F.col("item_id").isNotNull()
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(chosen).alias("chosen"), F.count_if(grounded & ~chosen).alias("elsewhere"), F.count_if(~grounded).alias("ungrounded"),
        F.count_if(~F.col("target_in_candidates")).alias("target_excluded"), F.count_if(F.coalesce("from_history", F.lit(False))).alias("from_history"),
        (F.count_if(chosen) / F.count("*")).alias("chosen_rate"), F.avg("place").alias("mean_place"),
        F.count_if(chosen & (F.col("correct") == 0) & (F.col("confidence") >= high)).alias("wrong_high"),
    )


def quadrants(rows: DataFrame, keys: list[str], low: float = 0.5, high: float = 0.7) -> DataFrame:
    """How many answers of a group are right or wrong with high or low confidence; null confidence counts as 0."""
    c, right = F.coalesce("confidence", F.lit(0.0)), F.col("correct") == 1
    return rows.groupBy(*keys).agg(
        F.count_if(right & (c >= high)).alias("correct_high"), F.count_if(right & (c < low)).alias("correct_low"),
        F.count_if(~right & (c >= high)).alias("wrong_high"), F.count_if(~right & (c < low)).alias("wrong_low"), F.count("*").alias("n"),
    )


def panel_stats(panels: DataFrame, examples: DataFrame) -> DataFrame:
    """One row: how often the target is in the panel, its mean places there by fallback and by answer, how often the answer's first is the target.

    ``panels``: example_id, item_id, place (in the panel), fallback (place in the fallback order), score (of the answer, null for items it
    leaves out); ``examples``: example_id, target. Ties go by item_id for the fallback and by place for the answer. Places are among the panel; a target that the answer leaves out has MISSING as its place. Means are over
    examples with an answer.
    """
    group = W.partitionBy("example_id")
    places = panels.select(
        "example_id", "item_id", F.row_number().over(group.orderBy("fallback", "item_id")).alias("by_fallback"),
        F.when(F.col("score").isNotNull(), F.row_number().over(group.orderBy(F.desc_nulls_last("score"), "place", "item_id"))).alias("by_answer"),
        F.max(F.col("score").isNotNull()).over(group).alias("answered"),
    )
    targets = examples.select("example_id", F.col("target").alias("item_id")).join(places, ["example_id", "item_id"], "left")
    answered = F.coalesce("answered", F.lit(False))
    return targets.agg(
        F.avg(F.col("by_fallback").isNotNull().cast("int")).alias("in_panel"), F.avg(F.when(answered, F.col("by_fallback"))).alias("fallback_place"),
        F.avg(F.when(answered, F.coalesce("by_answer", F.lit(MISSING)))).alias("answer_place"), F.avg(F.when(answered, (F.coalesce("by_answer", F.lit(0)) == 1).cast("int"))).alias("top_hit"),
    )



def letters(n: Column, i: Column) -> Column:
    """The label of place ``i`` (from 0) of ``n``: A to Z, or L0, L1 ... in longer panels."""
    return F.when(n > 26, F.concat(F.lit("L"), i)).otherwise(F.char(F.lit(65) + i))


def labelled_panel(panels: DataFrame) -> DataFrame:
    """example_id, labels (label to item_id), lines (numbered titles) of panels with example_id, item_id, place (from 1), title."""
    rows = panels.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("place", "item_id", "title"))).alias("p"))  # a panel is short
    keyed = F.transform("p", lambda x, i: F.struct(letters(F.size("p"), i).alias("label"), x["item_id"].alias("item_id")))
    lines = F.array_join(F.transform("p", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["title"])), "\n")
    return rows.select("example_id", F.map_from_entries(keyed).alias("labels"), lines.alias("lines"))


def chat_rows(candidates: DataFrame, prompt: Column) -> DataFrame:
    """example_id, item_id, messages (JSON): a question for each candidate, answered Yes. for the target and No. for others."""
    answer = F.when(F.col("item_id") == F.col("target"), "Yes.").otherwise("No.")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return candidates.select("example_id", "item_id", F.to_json(F.array(message("user", prompt), message("assistant", answer))).alias("messages"))


def strictly_enriched(examples: DataFrame, items: DataFrame) -> DataFrame:
    """example_id, target_title, titles (of the history, in its order); the job fails if an item isn't in the catalog."""
    known = items.select("item_id", "title").dropDuplicates(["item_id"])
    ids = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.col("target").alias("item_id"))), F.transform("history", lambda x, i: F.struct(i.alias("at"), x.alias("item_id"))))
    rows = examples.select("example_id", F.explode(ids).alias("x")).select("example_id", "x.*").join(known.withColumn("known", F.lit(True)), "item_id", "left")
    title = F.when(F.col("known"), F.col("title")).otherwise(F.raise_error(F.concat(F.lit("not in the catalog: "), F.coalesce("item_id", F.lit("null")))))
    out = rows.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("at", title.alias("title")))).alias("t"))
    return out.select("example_id", F.col("t")[0]["title"].alias("target_title"), F.transform(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda x: x["title"]).alias("titles"))
