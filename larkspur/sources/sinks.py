"""Sinks: JSON lines, CSV with nested values as JSON, metric rows, artifacts, tab-separated exports, response cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> None:
    """One object per line with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Sorted columns; arrays, maps and structs as JSON text."""
    nested = ("array", "map", "struct")
    columns = [F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in sorted(df.dtypes)]
    df.select(*columns).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def metric_rows(df: DataFrame, scope: list[str]) -> DataFrame:
    """Long rows (scope, metric, value) of a wide table of metrics."""
    values = [c for c in df.columns if c not in scope]
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values))
    name = F.concat_ws("/", *scope) if scope else F.lit("all")
    return df.select(name.alias("scope"), F.explode(pairs).alias("x")).select("scope", "x.metric", "x.value")


def artifacts(tables: dict[str, DataFrame], folder: str, seed: int) -> DataFrame:
    """Write every table as Parquet; returns its manifest (table, rows, seed) from what was written."""
    out = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        n = df.sparkSession.read.parquet(f"{folder}/{name}").agg(F.count("*").alias("rows"))
        row = n.select(F.lit(name).alias("table"), "rows", F.lit(seed).alias("seed"))
        out = row if out is None else out.unionByName(row)
    return out


def request_key(*fields: str):
    """SHA-256 of the canonical JSON of a request."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def answered(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their cached response and whether there was one."""
    return requests.join(cache, "request_key", "left").withColumn("cache_hit", F.col("response").isNotNull())
