"""Views of the driver's tables in the engine's terms: interactions, items, catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id (strings), ts (seconds), rating, domain and the two keys that break ties."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("item_id"),
        F.unix_timestamp("o_orderdate").cast("double").alias("ts"),
        F.col("l_quantity").cast("double").alias("rating"),
        "l_orderkey",
        "l_linenumber",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, title, category, brand; the title names brand and type, as part names repeat."""
    part = read(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
    )


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer")
    return customer.select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("domain"))
