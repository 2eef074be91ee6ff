"""What a prompt may show of an example: known items only, without the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T


def prompt_context(examples: DataFrame, items: DataFrame, policy: str = "title_only", excluded: Column | None = None) -> DataFrame:
    """``examples`` (example_id, history, target, candidates) with what their prompts show.

    history_item_ids and prompt_candidate_item_ids keep their order without excluded ids and ids that aren't in the catalog; history_titles and
    candidate_titles are their texts by ``policy``, as JSON lists. ``excluded``: an array of ids that must not be shown, the target if it isn't given.
    excluded_item_ids are these, sorted, history_excluded_item_ids what of the history was left out for it.
    """
    ban = F.array("target") if excluded is None else excluded
    rows = examples.withColumn("excluded_item_ids", F.array_sort(F.array_distinct(F.filter(ban, lambda x: F.coalesce(x != "", F.lit(False))))))
    names = items.dropDuplicates(["item_id"]).select("item_id", T.item_text(policy).alias("text"))
    none = F.array().cast("array<string>")

    def hidden(x: Column) -> Column:
        return F.array_contains("excluded_item_ids", F.coalesce(x, F.lit("")))

    def placed(column: str, side: int) -> Column:
        return F.transform(F.coalesce(column, none), lambda x, p: F.struct(F.lit(side).alias("side"), p.alias("p"), x.alias("item_id")))

    def shown(side: int, field: str) -> Column:
        return F.transform(F.filter("met", lambda x: x["side"] == side), lambda x: x[field])

    # both lists meet the catalog together
    asked = F.filter(F.concat(placed("history", 0), placed("candidates", 1)), lambda x: ~hidden(x["item_id"]))
    met = rows.select("example_id", F.inline(asked)).join(names, "item_id")
    met = met.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("side", "p", "item_id", "text"))).alias("met"))
    ids = {c: F.coalesce(shown(side, "item_id"), none) for side, c in enumerate(("history_item_ids", "prompt_candidate_item_ids"))}
    titles = {c: F.coalesce(F.to_json(shown(side, "text")), F.lit("[]")) for side, c in enumerate(("history_titles", "candidate_titles"))}
    told = {"history_excluded_item_ids": F.filter(F.coalesce("history", none), hidden), "target_excluded_from_prompt": hidden(F.col("target"))}
    return rows.join(met, "example_id", "left").withColumns(ids | titles | told).drop("met")
