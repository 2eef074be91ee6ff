"""Checks of model answers by task: every rule has its error, and an answer without one is good.

Answers are JSON of any shape, read as VARIANT. Objects must not repeat a key. Where several rules fail, the first in this order is told: no
object; a confidence anywhere that is no number, or outside [0, 1] (in order of keys); the rules of the task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import variant as V

TASKS = ("generation", "rerank", "yes_no", "candidates")
#: Fixed value: a list that closes in an answer that doesn't, with nested lists of one more level; strings may hold brackets.
_STRING = r'"(?:[^"\\]|\\.)*"'
_CLOSED = rf'(?s)"ranked_items"\s*:\s*(\[(?:[^\[\]"]|{_STRING}|\[(?:[^\[\]"]|{_STRING})*\])*\])'


def confidence_error(v: Column, clamp: bool = False) -> Column:
    """The first fault of a confidence at any depth; with ``clamp`` numbers outside [0, 1] are none."""
    found = V.nested(v, "confidence")
    odd = lambda x: ~x.rlike("^-?[0-9]")
    outside = lambda x: ~x.try_cast("double").between(0, 1)
    wrong = F.filter(found, lambda x: odd(x) if clamp else odd(x) | F.coalesce(outside(x), F.lit(True)))
    first = F.get(wrong, F.lit(0))
    return F.when(first.isNotNull(), F.when(odd(first), "confidence must be numeric").otherwise("confidence must be in [0, 1]"))


def _listed(v: Column, name: str) -> Column:
    """Faults of a list of objects with titles."""
    rows = V.items(V.member(v, name))
    bad = F.filter(F.transform(rows, lambda x, i: F.when(F.coalesce(V.kind(V.member(x, "title")) == "string", F.lit(False)), -1).otherwise(i)), lambda i: i >= 0)
    return (
        F.when(rows.isNull(), f"{name} must be a list").when(F.size(rows) == 0, f"{name} must be non-empty")
        .when(F.size(bad) > 0, F.concat(F.lit(f"{name}["), F.get(bad, F.lit(0)).cast("string"), F.lit("].title must be a string")))
    )


def task_error(v: Column, task: str) -> Column:
    has_confidence = F.when(V.member(v, "confidence").isNull(), "confidence is required")
    if task == "generation":
        value = V.member(v, "recommendation")
        rules = F.when(F.coalesce(V.kind(value) != "string", F.lit(True)), "recommendation must be a string").when(F.trim(V.text(value)) == "", "recommendation must be non-empty")
        return F.coalesce(rules, has_confidence)
    if task == "yes_no":
        answer = F.lower(F.coalesce(V.text(V.member(v, "answer")), F.lit("")))
        return F.coalesce(F.when(~answer.isin("yes", "no"), "answer must be yes or no"), has_confidence)
    return _listed(v, "ranked_items" if task == "rerank" else "options")


def checked(rows: DataFrame, task: str, raw: str = "raw", clamp: bool = False) -> DataFrame:
    """``rows`` with data (variant), ok, error and recovered of their answers.

    Of an answer to a rerank task whose object doesn't close, a list of ranked items that does close is taken (``recovered``).
    """
    if task not in TASKS:
        raise ValueError(f"{task} isn't one of {TASKS}")
    whole = F.try_parse_json(T.first_json(F.col(raw)))
    rows = rows.withColumn("data", F.when(V.kind(whole) == "object", whole)).withColumn("recovered", F.lit(False))
    if task == "rerank":
        closed = F.nullif(F.regexp_extract(raw, _CLOSED, 1), F.lit(""))
        saved = F.try_parse_json(F.concat(F.lit('{"ranked_items":'), closed, F.lit("}")))
        saved = F.when(confidence_error(saved, clamp).isNull() & (F.size(V.items(V.member(saved, "ranked_items"))) > 0), saved)
        rows = rows.withColumn("recovered", F.col("data").isNull() & saved.isNotNull()).withColumn("data", F.coalesce("data", saved))
    data = F.col("data")
    error = F.when(data.isNull(), "no JSON object").otherwise(F.coalesce(confidence_error(data, clamp), task_error(data, task)))
    return rows.withColumn("error", error).withColumn("ok", F.col("error").isNull())
