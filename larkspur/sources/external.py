"""External rankings in JSON lines of many dialects: aliases are told apart on reading, rows keep their shape as VARIANT until then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import variant as V

#: Names under which each field may come, in order.
EVENT = ["event_id", "source_event_id", "example_id"]
USER = ["user_id", "uid"]
TARGET = ["target_item", "target_item_id", "positive_item_id", "item_id", "pos_item"]
CANDIDATES = ["candidate_items", "candidates", "candidate_item_ids", "items"]
HISTORY = ["history", "history_item_ids", "user_history", "train_history"]
ITEM = ["item_id", "asin", "iid"]


def item_ids(v: Column, names: list[str]) -> Column:
    """Ids of the first member of ``names`` that is a list; elements are ids or objects with one. Empty if there is none."""
    own = lambda x: F.when(V.kind(x) == "object", F.coalesce(V.first_text(x, ITEM), F.lit(""))).otherwise(F.coalesce(V.text(x), F.lit("None")))
    found = F.coalesce(*(V.items(V.member(v, n)) for n in names))
    return F.coalesce(F.transform(found, own), F.array().cast("array<string>"))


def events(lines: DataFrame, domain: str, split: str, strict: bool = False, histories: DataFrame | None = None) -> DataFrame:
    """Examples of ``lines`` (value: JSON, index: place in its file from 1): example_id, user_id, target, history, candidates, inserted, given.

    Repeated candidates are an error. A target that isn't a candidate is put first (``inserted``; with ``strict`` an error). Rows without a history
    take the user's from ``histories`` (user_id, history). Lines that aren't JSON are an error, blank ones are skipped.
    """
    filled = F.when(F.trim("value") != "", F.col("value"))  # blank lines reach no parser, wherever the filter runs
    rows = lines.where(filled.isNotNull()).select("index", F.parse_json(filled).alias("v"))
    v = F.col("v")
    event = F.coalesce(V.first_text(v, EVENT), F.concat(F.lit(f"{domain}_{split}_"), F.col("index").cast("string")))
    rows = rows.select(
        event.alias("example_id"), F.coalesce(V.first_text(v, USER), F.lit("")).alias("user_id"), F.coalesce(V.first_text(v, TARGET), F.lit("")).alias("target"),
        item_ids(v, HISTORY).alias("history"), item_ids(v, CANDIDATES).alias("given"),
    )
    if histories is not None:
        known = histories.select("user_id", F.col("history").alias("known"))
        rows = rows.join(known, "user_id", "left").withColumn("history", F.when(F.size("history") > 0, F.col("history")).otherwise(F.coalesce("known", "history"))).drop("known")
    missing = (F.col("target") != "") & ~F.array_contains("given", F.col("target"))
    refuse = lambda what: F.raise_error(F.concat(F.lit(f"{what} in event "), F.col("example_id"))).cast("array<string>")
    candidates = F.when(F.size(F.array_distinct("given")) != F.size("given"), refuse("duplicate candidates"))
    candidates = candidates.when(missing, refuse("target missing from candidates") if strict else F.array_prepend("given", F.col("target"))).otherwise(F.col("given"))
    return rows.select("example_id", "user_id", "target", "history", candidates.alias("candidates"), missing.alias("inserted"), F.size("given").alias("given"))


def candidate_rows(examples: DataFrame) -> DataFrame:
    """(example_id, user_id, item_id, label): a row for each candidate, 1 for the target."""
    return examples.select("example_id", "user_id", "target", F.explode("candidates").alias("item_id")).select("example_id", "user_id", "item_id", (F.col("item_id") == F.col("target")).cast("int").alias("label"))


def known_items(examples: DataFrame) -> DataFrame:
    """Every item_id of candidates, histories and targets, once."""
    ids = F.concat("candidates", "history", F.when(F.col("target") != "", F.array("target")).otherwise(F.array().cast("array<string>")))
    return examples.select(F.explode(ids).alias("item_id")).distinct()
