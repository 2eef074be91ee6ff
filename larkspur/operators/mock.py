"""Deterministic stand-ins for model outputs, from SHA-256 of an example's id (no model is called)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.candidates import hash_number


def draw(name: str, modulus: int) -> Column:
    return hash_number(F.concat(F.lit(f"{name}:"), "example_id")) % modulus


def share(name: str) -> Column:
    """One of 0, 0.01 ... 1."""
    return draw(name, 101) / F.lit(100.0)


def sometimes(name: str, value: Column) -> Column:
    """Null for one example in four."""
    return F.when(draw(f"null-{name}", 4) != 0, value)


def outputs(examples: DataFrame) -> DataFrame:
    """Confidence rows of examples: correctness is likelier where confidence is high."""
    rows = examples.withColumn("confidence", share("c"))
    return (
        rows.withColumn("correct", F.when(draw("y", 100) < F.col("confidence") * 100, 1).otherwise(0))
        .withColumn("seq", F.col("example_id"))
        .withColumn("preference", share("p"))
        .withColumn("verbal", F.col("confidence"))
        .withColumn("generation", sometimes("g", share("g")))
        .withColumn("grounding", sometimes("r", share("r")))
        .withColumn("ambiguity", sometimes("a", share("a")))
        .withColumn("alignment", sometimes("h", share("h")))
        .withColumn("novelty", sometimes("n", share("n")))
        .withColumn("label", sometimes("l", F.col("correct")))
        .withColumn("is_grounded", draw("z", 5) != 0)
        .withColumn("group", draw("grp", 200))
    )
