"""Queries on title baselines, fallback orders, labels, strict enrichment and exposure inequality."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import baselines, metrics
from larkspur.plans.confidence import CONF, rows
from larkspur.plans.data import EX, INTER, ITEMS, POP, test_examples, train_popularity
from larkspur.plans.ranking import CAND, POP_SCORE, PRED, predicted, scored
from larkspur.sources import views

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _items(spark, sf_dir):
    return views.items(spark, sf_dir).select("item_id", "title").join(train_popularity(spark, sf_dir), "item_id")


_ORDERED = "o AS MATERIALIZED (SELECT item_id, title, popularity, row_number() OVER (ORDER BY popularity DESC, title, item_id) AS spot FROM pops)"


@query("popular_title", f"""WITH {EX}, {ITEMS}, {POP}, {_ORDERED}, t AS (SELECT example_id, history FROM ex WHERE split = 'test'),
  b AS (SELECT example_id, coalesce(min(spot) FILTER (NOT list_contains(history, item_id)), 1) AS spot FROM t, o GROUP BY example_id)
  SELECT example_id, item_id, title, ln(1 + popularity) / ln(1 + (SELECT max(popularity) FROM o)) AS confidence FROM b JOIN o USING (spot)""")
def popular_title(spark, sf_dir):
    return baselines.popular_title(test_examples(spark, sf_dir).select("example_id", "history"), _items(spark, sf_dir))


@query("ranked_title", f"""{PRED}, s AS (SELECT r.example_id, item_id, k, ln(1 + score) AS score FROM r JOIN test t USING (example_id) WHERE method = 'popularity' AND k % 3 <> 0 AND NOT list_contains(t.history, item_id)),
  b AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY k) AS p, max(score) OVER (PARTITION BY example_id) AS top, count(*) OVER (PARTITION BY example_id) AS n FROM s),
  z AS (SELECT example_id, sum(exp(score - top)) AS total FROM b GROUP BY example_id)
  SELECT example_id, item_id, CAST(k AS INTEGER) AS selected_rank, CASE WHEN n >= 2 THEN exp(score - top) / total ELSE 1 / (1 + exp(-score)) END AS confidence FROM b JOIN z USING (example_id) WHERE p = 1""")
def ranked_title(spark, sf_dir):
    """Places 1, 2, 4, 5, ... of the popularity ranking as a ranking from outside, with each item repeated at its end."""
    ranked = baselines_rank(scored(spark, sf_dir, "popularity")).where("k % 3 != 0").select("example_id", F.col("k").alias("rank"), "item_id", F.log1p("score").alias("score"))
    ranked = ranked.unionByName(ranked.withColumn("rank", F.col("rank") + 1000))
    return baselines.ranked_title(ranked, test_examples(spark, sf_dir), views.items(spark, sf_dir))


def baselines_rank(rows):
    from pyspark.sql import Window as W

    return rows.withColumn("k", F.row_number().over(W.partitionBy("example_id").orderBy(F.desc("score"), "item_id")))


@query("fallback_order", f"""{CAND}, s AS ({POP_SCORE}) SELECT example_id, item_id, CAST(row_number() OVER (PARTITION BY example_id ORDER BY score DESC, CAST(('0x' || substr(sha256('0::' || item_id), 1, 8)) AS BIGINT), item_id) AS INTEGER) AS place FROM s""")
def fallback_order(spark, sf_dir):
    return baselines.fallback_order(scored(spark, sf_dir, "popularity")).select("example_id", "item_id", "place")


@query("case_labels", f"""{CONF} SELECT CASE WHEN NOT is_grounded THEN 'ungrounded' WHEN correct = 1 THEN 'correct' ELSE 'wrong' END || CASE WHEN confidence >= 0.7::DOUBLE THEN '_high' WHEN confidence < 0.5 THEN '_low' ELSE '_intermediate' END || '_confidence' AS label,
  bucket, count(*) AS n, avg(confidence) AS mean_confidence FROM conf GROUP BY ALL""")
def case_labels(spark, sf_dir):
    return rows(spark, sf_dir).groupBy(baselines.primary_label().alias("label"), "bucket").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))


@query("exposure_inequality", f"""WITH {INTER}, {ITEMS}, c AS (SELECT items.item_id, count(inter.item_id) AS v FROM items LEFT JOIN inter USING (item_id) GROUP BY items.item_id),
  r AS (SELECT v, row_number() OVER (ORDER BY v, item_id) AS i, count(*) OVER () AS n, sum(v) OVER () AS total FROM c)
  SELECT 2 * sum(i * v) / CAST(max(n) * max(total) AS DOUBLE) - (max(n) + 1) / CAST(max(n) AS DOUBLE) AS gini, -sum(CASE WHEN v > 0 THEN v / CAST(total AS DOUBLE) * ln(v / CAST(total AS DOUBLE)) END) AS entropy FROM r""")
def exposure_inequality(spark, sf_dir):
    counts = views.interactions(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("c"))
    counts = views.items(spark, sf_dir).select("item_id").join(counts, "item_id", "left").select(F.coalesce("c", F.lit(0)).alias("exposures"))
    return baselines.inequality(counts)


@query("coverage_by_domain", f"""{PRED}, d AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_mktsegment AS domain FROM customer), x AS (SELECT r.*, domain FROM r JOIN test t USING (example_id) JOIN d ON d.user_id = t.user_id)
  SELECT domain, count(DISTINCT item_id) FILTER (k <= 5) / CAST(count(DISTINCT item_id) AS DOUBLE) AS coverage, count(DISTINCT item_id) FILTER (k <= 5) / CAST((SELECT count(*) FROM items) AS DOUBLE) AS catalog_coverage FROM x WHERE method = 'popularity' GROUP BY domain""")
def coverage_by_domain(spark, sf_dir):
    return metrics.coverage(predicted(spark, sf_dir, ("popularity",)), 5, views.items(spark, sf_dir), ["domain"]).select("domain", "coverage", "catalog_coverage")
