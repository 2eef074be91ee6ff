"""Text functions as Columns; Java patterns carry (?U) where Unicode classes are meant."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def clean_title(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[\x00-\x1f\x7f]", " "), r"\s+", " "))


def normalize_ascii(x: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), PUNCTUATION, " " * len(PUNCTUATION)), r"(?U)\s+", " "))


def normalize_title(x: Column) -> Column:
    """Lower case, & as 'and', other non-word characters as spaces, without one leading article."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "&", " and "), r"(?U)[^\w]+", " "))
    return F.regexp_replace(flat, r"^(a|an|the) ", "")


def folded_title(title: str) -> str:
    """As ``normalize_title``, of compatibility forms (NFKC) and with full case folding."""
    flat = unicodedata.normalize("NFKC", title).casefold().replace("&", " and ")
    return re.sub(r"^(a|an|the)\s+", "", re.sub(r"[^\w]+", " ", flat).strip(), flags=re.IGNORECASE)


@lru_cache
def _fold_udf():
    return F.pandas_udf(lambda titles: titles.map(folded_title), "string")


def fold_title(x: Column) -> Column:
    """``folded_title`` of a column without nulls, in Arrow batches: no built-in function normalises Unicode."""
    return _fold_udf()(x)


def tokens(x: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, with repetition."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(x: Column, least: int = 1) -> Column:
    return F.array_distinct(F.filter(F.split(x, " "), lambda t: F.length(t) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(0.0))


def jaccard_or_one(a: Column, b: Column) -> Column:
    """As ``jaccard``, but two empty sets are equal."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(jaccard(a, b))


def trigrams(x: Column) -> Column:
    flat = F.regexp_replace(x, " ", "")
    return F.array_distinct(F.when(F.length(flat) >= 3, F.transform(F.sequence(F.lit(1), F.length(flat) - 2), lambda i: flat.substr(i, F.lit(3)))).otherwise(F.array(flat)))


def item_text(policy: str) -> Column:
    """Texts of an item (title, category, brand) by policy."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    if policy == "title_category":
        return F.concat_ws(" | ", some("title"), some("category"))
    if policy == "labelled":
        return F.concat_ws(" ", some("title"), F.concat(F.lit("category="), some("category")), F.concat(F.lit("brand="), some("brand")))
    return F.coalesce("title", F.lit(""))


def normalize_split(x: Column) -> Column:
    return F.when(F.lower(x).isin("val", "validation"), "valid").otherwise(F.lower(x))


def confidence(x: Column) -> Column:
    """A number, or percent where it has % or exceeds 1; null unless it lands in [0, 1]."""
    number = F.regexp_replace(F.trim(x), "%$", "").try_cast("double")
    scaled = F.when(F.trim(x).endswith("%") | (number > 1), number / 100).otherwise(number)
    return F.when(scaled.between(0, 1), scaled)


def yes_no(x: Column) -> Column:
    """Fixed synonym lists: yes, no, or null."""
    word = F.lower(F.trim(F.regexp_replace(x, r"[.!]+$", "")))
    return F.when(word.isin("yes", "y", "true", "1"), "yes").when(word.isin("no", "n", "false", "0"), "no")


def first_json(x: Column) -> Column:
    """The JSON object in an answer: all of it, else a fenced block, else from the first to the last brace."""
    whole = F.when(F.trim(x).startswith("{") & F.trim(x).endswith("}"), F.trim(x))
    fenced = F.nullif(F.regexp_extract(x, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(whole, fenced, braces)
