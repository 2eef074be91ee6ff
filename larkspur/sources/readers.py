"""Readers: CSV and JSON lines as strings first, then typed with declared casts (no inference passes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from larkspur.functions import text as T


def rows(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """``.jsonl`` (or ``.json``, also gzipped) by line, anything else as CSV with a header; cells are strings."""
    if ".json" in path:
        reader = spark.read
        if columns:
            reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
        return reader.json(path)
    return spark.read.option("header", True).csv(path)


def number(name: str) -> Column:
    """Empty as null, else a double or null."""
    return F.nullif(F.trim(F.col(name).cast("string")), F.lit("")).try_cast("double")


def interactions(df: DataFrame, domain: str = "tiny") -> DataFrame:
    """Typed interactions; missing timestamp, rating and domain columns are allowed, empty ids are an error."""
    missing = {"user_id", "item_id"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    has = lambda c: number(c) if c in df.columns else F.lit(None).cast("double")
    place = F.coalesce(F.nullif("domain", F.lit("")), F.lit(domain)) if "domain" in df.columns else F.lit(domain)
    filled = lambda c: F.when(F.trim(c) == "", F.raise_error(F.lit(f"empty {c}"))).otherwise(F.col(c)).cast("string")
    return df.select(filled("user_id").alias("user_id"), filled("item_id").alias("item_id"), has("timestamp").alias("ts"), has("rating").alias("rating"), place.alias("domain"))


def items(df: DataFrame) -> DataFrame:
    """Clean titles; category, else genres."""
    names = [F.nullif(c, F.lit("")) for c in ("category", "genres") if c in df.columns]
    category = F.coalesce(*names) if names else F.lit(None).cast("string")
    return df.select(F.col("item_id").cast("string"), T.clean_title(F.col("title")).alias("title"), category.alias("category"))


def delimited(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """``::``-delimited latin-1 lines; the last field keeps what is left."""
    # the text reader takes bytes as UTF-8, so lines are read as CSV cells in their own encoding
    lines = spark.read.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").schema("value string").csv(path)
    line = F.split(F.col("value"), "::", len(names))
    return lines.where(F.trim("value") != "").select(*(F.get(line, F.lit(i)).alias(n) for i, n in enumerate(names)))


def renamed(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Project source fields to ours (ours -> theirs); rows with empty ids or a timestamp of 0 or less go."""
    out = df.select(*(F.col(theirs).alias(ours) for ours, theirs in fields.items()))
    kept = (F.coalesce(F.trim("user_id"), F.lit("")) != "") & (F.coalesce(F.trim("item_id"), F.lit("")) != "")
    return out.where(kept & (F.col("timestamp").try_cast("double") > 0))


def metadata_for(meta: DataFrame, needed: DataFrame, order: str) -> DataFrame:
    """First metadata row (by ``order``) of every needed item."""
    found = meta.join(needed.select("item_id").distinct(), "item_id", "left_semi")
    return found.withColumn("k", F.row_number().over(W.partitionBy("item_id").orderBy(order))).where("k = 1").drop("k")


def field_report(df: DataFrame, expected: list[str], sample: int = 1000) -> DataFrame:
    """Null counts of the expected fields in the first rows (a field that isn't there is null everywhere)."""
    some = df.limit(sample)
    counts = [(F.count_if(F.col(c).isNull()) if c in df.columns else F.count("*")).alias(c) for c in expected]
    return some.agg(F.count("*").alias("rows"), *counts)


def json_cells(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """Cells of the named columns that hold JSON text, decoded to their schemas."""
    return df.withColumns({c: F.from_json(F.col(c), schema) for c, schema in schemas.items()})


def last_scores(df: DataFrame, seq: str) -> DataFrame:
    """(example_id, user_id, item_id, score): the last row of a key wins."""
    return df.groupBy("example_id", "user_id", "item_id").agg(F.max_by(F.col("score").try_cast("double"), seq).alias("score"))


def external_rankings(df: DataFrame, strict: bool = False) -> DataFrame:
    """Examples with candidates from external rankings (example_id, user_id, target, candidates): repeated candidates are an
    error; a target outside its candidates is put first, or dropped where ``strict``."""
    ok = F.size(F.array_distinct("candidates")) == F.size("candidates")
    checked = df.withColumn("candidates", F.when(ok, F.col("candidates")).otherwise(F.raise_error(F.lit("repeated candidates"))))
    inside = F.array_contains("candidates", F.col("target"))
    if strict:
        return checked.where(inside)
    return checked.withColumn("candidates", F.when(inside, F.col("candidates")).otherwise(F.array_prepend("candidates", F.col("target"))))
