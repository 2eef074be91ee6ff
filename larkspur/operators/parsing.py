"""Parsing model answers into typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T


def observations(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """title, confidence, verdict and strategy of answers: strict, fenced or embedded JSON, else key: value lines."""
    x = F.col(raw)
    whole = F.trim(x).startswith("{") & F.trim(x).endswith("}")
    doc = T.first_json(x)
    get = lambda *names: F.coalesce(*(F.nullif(F.get_json_object(doc, f"$.{n}"), F.lit("")) for n in names))
    line = lambda name: F.nullif(F.trim(F.regexp_extract(x, rf"(?im)^\s*{name}\s*[:=]\s*(.+?)\s*$", 1)), F.lit(""))
    ok = doc.isNotNull() & F.try_parse_json(doc).isNotNull()
    strategy = F.when(ok & whole, "strict").when(ok & x.contains("```"), "fenced").when(ok, "embedded").when(line("title").isNotNull(), "lines").otherwise("failed")
    return rows.select(
        "*",
        F.when(ok, get("title", "generated_title", "recommendation")).otherwise(line("title")).alias("title"),
        T.confidence(F.when(ok, get("confidence", "probability")).otherwise(line("confidence"))).alias("confidence"),
        T.yes_no(F.when(ok, get("answer", "verdict")).otherwise(line("answer"))).alias("verdict"),
        strategy.alias("strategy"),
    )


def rankings(rows: DataFrame, raw: str = "raw", labels: str = "labels") -> DataFrame:
    """items and error of listwise answers {"ranking": [{"label": ...}]}: unknown and repeated labels fail, labels map to items."""
    doc = F.from_json(T.first_json(F.col(raw)), "ranking array<struct<label:string,score:double,confidence:double>>")
    rows = rows.withColumn("__r", doc["ranking"]).withColumn("__l", F.col("__r.label"))
    unknown = F.exists("__l", lambda x: x.isNull() | ~F.map_contains_key(labels, F.coalesce(x, F.lit(""))))
    error = (
        F.when(F.col("__r").isNull(), "unparsed").when(unknown, "unknown_label").when(F.size("__l") != F.size(F.array_distinct("__l")), "duplicate_label")
    )
    rows = rows.withColumn("error", error)
    items = F.when(F.col("error").isNull(), F.transform("__l", lambda x: F.element_at(labels, x)))
    return rows.withColumn("items", items).drop("__r", "__l")
