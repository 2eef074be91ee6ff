"""JSON of any shape as VARIANT columns: kinds, aliases and nested values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def member(v: Column, name: str) -> Column:
    """A member of an object, as a variant; SQL null where it isn't there (or ``v`` is no object)."""
    return F.try_variant_get(v, f"$['{name}']", "variant")


def kind(v: Column) -> Column:
    """object, array, string, number, boolean or null; SQL null stays null."""
    told = F.schema_of_variant(v)
    return (
        F.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").when(told == "STRING", "string")
        .when(told == "BOOLEAN", "boolean").when(told == "VOID", "null").when(told.isNotNull(), "number")
    )


def text(v: Column) -> Column:
    """The text of a string, number or boolean, null for others."""
    return F.when(kind(v).isin("string", "number", "boolean"), F.try_variant_get(v, "$", "string"))


def items(v: Column) -> Column:
    """The elements of an array, null for others."""
    return F.when(kind(v) == "array", F.try_variant_get(v, "$", "array<variant>"))


def first_text(v: Column, names: list[str]) -> Column:
    """The text of the first member of these names that is there and not empty."""
    return F.coalesce(*(F.nullif(text(member(v, n)), F.lit("")) for n in names))


def nested(v: Column, name: str) -> Column:
    """What every member called ``name`` at any depth begins with, in order of the keys: a number whole, else the first sign of its JSON.

    JSON written from a variant has no blanks outside strings, and quotes inside strings are escaped, so a quoted name before a
    colon is a key.
    """
    return F.regexp_extract_all(F.to_json(v), F.lit(rf'"{name}":(-?[0-9][-+0-9.eE]*|.)'), F.lit(1))
