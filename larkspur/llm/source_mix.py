"""Mixing sources to target weights by hierarchical budgets.

The token budget flows down a tree of domains, languages and sources. At every node the
children's shares follow their weights, but none gets more than it can supply (its tokens
times the allowed epochs): what one child can't use goes to its siblings, and only what all
siblings together can't use is missing at their parent, whose own siblings then take it. This
is water filling, solved in closed form with window sums over the (small) tree.

A leaf with budget b and s tokens repeats all its documents floor(b / s) times; the rest is
a prefix, in tokens, of one more epoch in seeded order. The prefix is found by sums over
hash ranges of the leaf, so that no task orders a whole leaf: only the one range in
which the prefix ends is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, if_small, stored, table

#: Default tree: domain of a source, weights of domains and languages; sources weigh 1.
DOMAINS = {"web": range(0, 5), "news": range(5, 10), "reference": range(10, 15), "forum": range(15, 20)}
DOMAIN_WEIGHTS = {"web": 0.4, "news": 0.25, "reference": 0.25, "forum": 0.1}
LANG_WEIGHTS = {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}
OTHER_WEIGHT = 0.05
SEED, SHARE, EPOCHS = 17, 0.8, 2.0
RANGE_DOCS = 2048  # documents in a hash range, about


def domain_of(source: Column) -> Column:
    found = F.lit("other")
    for name, numbers in DOMAINS.items():
        found = F.when(source.isin([f"src{n}" for n in numbers]), name).otherwise(found)
    return found


def weight_of(name: Column, weights: dict[str, float]) -> Column:
    found = F.lit(OTHER_WEIGHT)
    for key, weight in weights.items():
        found = F.when(name == key, weight).otherwise(found)
    return found


def fill(nodes: DataFrame, parent: list[str], order: str) -> DataFrame:
    """``nodes`` with ``budget``: the parent's ``given`` shared by ``weight``, each at most ``cap``.

    In ascending order of cap / weight, the level reached by sharing what is left among the nodes not
    yet passed rises up to the first node that isn't full; the highest level is the water level.
    """
    ratio = F.try_divide("cap", "weight")
    up = W.partitionBy(*parent).orderBy(ratio.asc_nulls_last(), order)
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(up.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = F.try_divide(F.col("given") - before, left)
    nodes = nodes.withColumn("__l", level)
    nodes = nodes.withColumn("__l", F.max("__l").over(W.partitionBy(*parent)))
    return nodes.withColumn("budget", F.least("cap", F.coalesce(F.col("__l"), F.lit(0.0)) * F.col("weight"))).drop("__l")


def leaf_budgets(leaves: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``leaves`` (domain, lang, source, docs, supply) with ``budget``; all of them get ``share`` of the supply."""
    caps = leaves.withColumn("cap", F.col("supply") * F.lit(float(epochs)))
    total = caps.agg((F.sum("supply") * F.lit(float(share))).alias("given"))
    domains = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).join(total, F.lit(True)).withColumn("weight", weight_of(F.col("domain"), DOMAIN_WEIGHTS))
    domains = fill(domains.withColumn("root", F.lit(0)), ["root"], "domain").select("domain", F.col("budget").alias("given"))
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain").withColumn("weight", weight_of(F.col("lang"), LANG_WEIGHTS))
    langs = fill(langs, ["domain"], "lang").select("domain", "lang", F.col("budget").alias("given"))
    sources = caps.join(langs, ["domain", "lang"]).withColumn("weight", F.lit(1.0))
    return fill(sources, ["domain", "lang"], "source").select("domain", "lang", "source", "docs", "supply", "budget")


def seeded(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A number in [0, 1) with 52 bits from SHA-256 of seed, epoch and document."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix_sources(docs: DataFrame, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` with domain, tokens and copies (how often the row is taken, maybe 0).

    ``docs``: doc_id, text, lang, source. Tokens are words; null and empty texts have none and come with
    the prefix at no cost; null languages and sources count as ''. Rows with one doc_id have one place in
    an epoch and are taken in order of their tokens. An empty table gives an empty result.
    """
    # the columns of ``docs`` travel in one struct, so that no name of theirs meets one of these
    kept = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("domain", "tokens", "copies")]
    rows = docs.select(
        F.struct(*kept).alias("row"), docs["doc_id"].alias("doc_id"), F.coalesce(docs["lang"], F.lit("")).alias("lang"), F.coalesce(docs["source"], F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
    ).withColumn("domain", domain_of(F.col("source")))
    narrow = stored(rows.drop("row"))
    leaf = ["domain", "lang", "source"]
    leaves = narrow.groupBy(*leaf).agg(F.count("*").alias("docs"), F.sum("tokens").alias("supply"))
    plan = leaf_budgets(leaves, share, epochs).withColumn("whole", F.coalesce(F.floor(F.try_divide("budget", "supply")), F.lit(0)))
    plan = plan.withColumn("rest", F.floor("budget") - F.col("whole") * F.col("supply")).withColumn("ranges", F.ceil(F.col("docs") / RANGE_DOCS))
    plan = stored(plan.select(*leaf, "whole", "rest", "ranges"))
    placed = lambda df: df.withColumn("u", seeded(seed, F.col("whole"), F.col("doc_id"))).withColumn("range", F.floor(F.col("u") * F.col("ranges")))
    # a leaf may hold most rows, so they aren't dealt by leaf
    sums = placed(narrow.join(if_small(plan, 10_000), leaf)).groupBy(*leaf, "range").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    through = F.sum("n").over(W.partitionBy(*leaf).orderBy("range"))
    # the first range that the prefix doesn't take whole
    ends = sums.withColumn("through", through).where(F.col("through") > F.col("rest")).groupBy(*leaf).agg(
        F.min(F.struct("range", (F.col("through") - F.col("n")).alias("before"))).alias("end")
    )
    plan = stored(plan.join(ends, leaf, "left").select(*leaf, "whole", "rest", "ranges", F.col("end.range").alias("end"), "end.before"))
    joined = placed(rows.join(if_small(plan, 10_000), leaf))
    inner = joined.where(F.col("end").isNull() | (F.col("range") != F.col("end")))
    inner = inner.withColumn("copies", F.col("whole") + F.when(F.col("end").isNull() | (F.col("range") < F.col("end")), 1).otherwise(0))
    order = W.partitionBy(*leaf).orderBy("u", "doc_id", "tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = joined.where(F.col("range") == F.col("end")).withColumn("through", F.col("before") + F.sum("tokens").over(order))
    edge = edge.withColumn("copies", F.col("whole") + F.when(F.col("through") <= F.col("rest"), 1).otherwise(0))
    out = ["row.*", "domain", "tokens", F.col("copies").cast("long").alias("copies")]
    return inner.select(*out).unionByName(edge.select(*out))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "tokens", "copies")


def _sql_fill(nodes: str, parent: str, order: str) -> str:
    return f"""SELECT *, least(cap, level * weight) AS budget FROM (SELECT *, max(l) OVER (PARTITION BY {parent}) AS level FROM (
    SELECT *, (given - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / weight, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (PARTITION BY {parent} ORDER BY cap / weight, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM {nodes}))"""


def _sql_case(column: str, weights: dict) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{k}' THEN {v}::DOUBLE" for k, v in weights.items())} ELSE {OTHER_WEIGHT}::DOUBLE END"


OP4_SQL = f"""
WITH d AS (SELECT doc_id, lang, source, CASE {" ".join(f"WHEN source IN ({', '.join(repr(f'src{n}') for n in ns)}) THEN '{k}'" for k, ns in DOMAINS.items())} ELSE 'other' END AS domain,
  len(regexp_extract_all(text, '{WORD}')) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::DOUBLE AS supply, sum(tokens) * {EPOCHS}::DOUBLE AS cap FROM d GROUP BY ALL),
n1 AS (SELECT domain, 0 AS root, sum(cap) AS cap, {_sql_case("domain", DOMAIN_WEIGHTS)} AS weight, (SELECT sum(supply) * {SHARE}::DOUBLE FROM leaves) AS given FROM leaves GROUP BY domain),
b1 AS ({_sql_fill("n1", "root", "domain")}),
n2 AS (SELECT l.domain, l.lang, sum(l.cap) AS cap, {_sql_case("l.lang", LANG_WEIGHTS)} AS weight, any_value(b1.budget) AS given FROM leaves l JOIN b1 USING (domain) GROUP BY l.domain, l.lang),
b2 AS ({_sql_fill("n2", "domain", "lang")}),
n3 AS (SELECT l.domain, l.lang, l.source, l.supply, l.cap, 1::DOUBLE AS weight, b2.budget AS given FROM leaves l JOIN b2 USING (domain, lang)),
b3 AS ({_sql_fill("n3", "domain, lang", "source")}),
p AS (SELECT domain, lang, source, floor(budget / supply)::BIGINT AS whole, floor(budget)::BIGINT - floor(budget / supply)::BIGINT * supply::BIGINT AS rest FROM b3)
SELECT d.doc_id, d.domain, d.lang, d.source, d.tokens, p.whole + CASE WHEN sum(d.tokens) OVER (PARTITION BY d.domain, d.lang, d.source
  ORDER BY ('0x' || substr(sha256('{SEED}:' || p.whole || ':' || d.doc_id), 1, 13))::BIGINT, d.doc_id ROWS UNBOUNDED PRECEDING) <= p.rest THEN 1 ELSE 0 END AS copies
FROM d JOIN p USING (domain, lang, source)
"""
