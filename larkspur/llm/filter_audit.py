"""How filters of a corpus interact: mask histograms, with DataFrame functions only.

Every document gets a bit mask of the filters it fails. Documents are then needed no more: for each part of the
corpus the 2**k cells of a mask histogram (k filters) hold all that any order of the filters can remove. Orders are
enumerated from the cells.

A text that repeats is told from its digest (SHA-256); the least doc_id of each digest is found by a grouping that
is summed up before it is shuffled, and met again by (doc_id, digest), so that a text which a third of all documents
share goes to no single task. The masks are written to the shared folder once; texts are read once.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, stored, table

#: The filter of repeated texts: its condition needs other documents, so it is no expression of one.
REPEATED = "E"
MOST = 8  # filters; their orders are enumerated


def text_filters() -> dict[str, Column]:
    """Failure conditions of a text, in columns ``text`` (not null) and ``words`` (an array)."""
    n = F.size("words")
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct("words")) < 80 * n,
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > 10 * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, filters: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, part, mask) of every row of ``docs`` (doc_id, text, lang): bit i is set if filter i fails it, the last bit if a smaller doc_id has its text.

    Null texts count as empty, and are copies of empty ones; a null language is the part ''. Rows
    of one doc_id and one text aren't copies of each other. Rows without doc_id are never copies, and nothing is a copy of them.
    """
    filters = text_filters() if filters is None else filters
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", GAP), ""))
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    rows = stored(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask")))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(True).alias("first"))
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()
    met = rows.join(firsts, ["doc_id", "digest"], "left")
    return met.select("doc_id", "part", (F.col("mask") + F.when(again, 1 << len(filters)).otherwise(0)).cast("int").alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each cell, and how many are labelled good or toxic (by any label row of their doc_id)."""
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return masks.join(marked, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def interactions(cells: DataFrame, filters: str) -> DataFrame:
    """One row per part, order of ``filters`` (a letter each, by bit) and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A part has 2**k cells at most, and k! orders of k steps: neither grows with the documents.
    """
    if len(filters) > MOST:
        raise ValueError(f"at most {MOST} filters, as all their orders are enumerated")
    orders = F.array(*(F.lit("".join(order)) for order in itertools.permutations(filters)))
    steps = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    place = {letter: F.instr("filter_order", letter) for letter in filters}
    bits = lambda holds: sum((F.when(holds(place[letter]), 1 << i).otherwise(0) for i, letter in enumerate(filters)), F.lit(0))
    steps = steps.withColumns({"own": bits(lambda at: at == F.col("step")), "before": bits(lambda at: at < F.col("step"))})
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    count = lambda holds, of="n": F.sum(F.when(holds, F.col(of)).otherwise(0)).cast("long")
    per = steps.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~earlier).alias("kept"),
        count(fails & ~earlier).alias("removed"),
        count(fails & earlier).alias("redundant"),
        count(F.col("mask") == F.col("own")).alias("unique_fails"),
        count(fails & ~earlier, "good").alias("good_lost"),
        count(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    per = per.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    shapley = per.groupBy("part", "letter").agg(F.sum("removed").cast("long").alias("shapley"))
    return per.join(shapley, ["part", "letter"]).drop("letter")


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None) -> DataFrame:
    """Interactions of ``filters`` (letter -> failure condition, as in ``text_filters``) and of repeated texts (letter E) for every part of ``docs``.

    ``docs``: doc_id, text, lang; ``labels``: doc_id, quality, toxic. Other columns are ignored. Every row counts as a
    document, also repeated ones. An empty table has no parts and gives no rows; without labels nothing good or toxic is lost.
    """
    filters = text_filters() if filters is None else filters
    cells = stored(mask_cells(failure_masks(docs, filters), labels))
    return interactions(cells, "".join(filters) + REPEATED).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
m AS (SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
  FROM d JOIN firsts USING (text)),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM f AS a, f AS b, f AS x, f AS y, f AS z WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, 1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1) AS own,
    list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', substr(filter_order, i, 1)) - 1))) AS earlier
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
per AS (SELECT part, filter_order, step, letter,
    sum(CASE WHEN mask & own = 0 AND mask & coalesce(earlier, 0)::BIGINT = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0)::BIGINT = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0)::BIGINT <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0)::BIGINT = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0)::BIGINT = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM per
"""
