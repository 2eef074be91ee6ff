"""Queries on enriched examples, panels and override thresholds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators import enrich, mock
from larkspur.operators.rounds import checkpointed
from larkspur.plans.confidence import CONF, PANEL, rows
from larkspur.plans.data import EX, ITEMS, POP, test_examples
from larkspur.plans.ranking import BUCKET, CAND, buckets, scored
from larkspur.sources import sinks, views

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def catalog(spark, sf_dir):
    return views.items(spark, sf_dir).join(buckets(spark, sf_dir).select("item_id", "popularity", "bucket"), "item_id")


@query("catalog_fields", f"""WITH {EX}, {ITEMS}, {POP}, {BUCKET}, h AS (SELECT example_id, unnest(history) AS item_id, unnest(range(len(history))) AS p FROM ex WHERE split = 'test'),
  t AS (SELECT example_id, string_agg(title, '|' ORDER BY p) AS titles FROM h JOIN items USING (item_id) GROUP BY example_id)
  SELECT ex.example_id, r.title AS target_title, r.popularity AS target_popularity, bucket AS target_bucket, coalesce(titles, '') AS titles FROM ex JOIN ranks r ON r.item_id = target JOIN b ON b.item_id = target LEFT JOIN t ON t.example_id = ex.example_id WHERE split = 'test'""")
def catalog_fields(spark, sf_dir):
    out = enrich.with_catalog(test_examples(spark, sf_dir), catalog(spark, sf_dir))
    return out.select("example_id", "target_title", "target_popularity", "target_bucket", F.array_join("history_titles", "|").alias("titles"))


@query("candidate_panel", f"""{PANEL}, {BUCKET}, z AS (SELECT panel.*, bucket, CASE WHEN place <= 5 THEN place WHEN place = 10 THEN 6 WHEN place = 20 THEN 7 WHEN place = 50 THEN 8 END AS slot, panel.h % 13 = 0 AS grounded FROM panel JOIN b USING (item_id)),
  y AS (SELECT *, row_number() OVER (PARTITION BY example_id, slot IS NULL ORDER BY popularity DESC, item_id) AS hd, row_number() OVER (PARTITION BY example_id, slot IS NULL ORDER BY CASE WHEN bucket = 'tail' THEN 0 ELSE 1 END, popularity, item_id) AS tl FROM z),
  x AS (SELECT *, coalesce(slot, CASE WHEN hd = 1 THEN 9 END, CASE WHEN tl = 1 THEN 10 END, CASE WHEN grounded THEN 11 END, 100 + place) AS s FROM y)
  SELECT example_id, item_id, CAST(row_number() OVER (PARTITION BY example_id ORDER BY s, item_id) AS INTEGER) AS panel_place FROM x QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY s, item_id) <= 15""")
def candidate_panel(spark, sf_dir):
    order = W.partitionBy("example_id").orderBy(F.desc(F.round("score", 9)), "item_id")
    one = F.conv(F.substring(F.sha2(F.concat_ws(":", "example_id", "item_id"), 256), 1, 8), 16, 10).cast("long")
    ranked = scored(spark, sf_dir, "markov").drop("popularity").withColumn("place", F.row_number().over(order)).withColumn("grounded", one % 13 == 0)
    return enrich.panel(ranked.join(buckets(spark, sf_dir).select("item_id", "popularity", "bucket"), "item_id")).select("example_id", "item_id", "panel_place")


@query("token_candidates", f"""{CAND}, tk AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9_]+'), lambda x: length(x) >= 3))) AS t FROM items),
  hw AS (SELECT example_id, unnest(history) AS item_id, unnest(range(1, len(history) + 1)) AS p, len(history) AS m FROM test), w AS (SELECT example_id, t, sum(p / m::DOUBLE) AS w FROM hw JOIN tk USING (item_id) GROUP BY ALL),
  s AS (SELECT example_id, item_id, round(sum(w), 9) AS score FROM w JOIN tk USING (t) GROUP BY ALL),
  o AS (SELECT example_id, s.item_id, score, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, popularity DESC, title, s.item_id) AS place FROM s JOIN test USING (example_id) JOIN pops ON pops.item_id = s.item_id WHERE s.item_id <> target AND NOT list_contains(history, s.item_id))
  SELECT example_id, item_id, score, CAST(place AS INTEGER) AS place FROM o WHERE place <= 20""")
def token_candidates(spark, sf_dir):
    return enrich.token_candidates(test_examples(spark, sf_dir), catalog(spark, sf_dir)).withColumn("score", F.round("score", 9))


def _override(spark, sf_dir):
    third = lambda n: mock.draw(n, 3) / F.lit(2.0)
    return rows(spark, sf_dir).select("example_id", "split", "confidence", "preference", mock.share("pi").alias("p_improve"), mock.share("ph").alias("p_harm"), third("nb").alias("ndcg_before"), third("na").alias("ndcg_after"))


@query("threshold_grid", f"""{CONF}, d AS (SELECT CAST(('0x' || substr(sha256('pi:' || example_id), 1, 8)) AS BIGINT) % 101 / CAST(100 AS DOUBLE) AS pi, CAST(('0x' || substr(sha256('ph:' || example_id), 1, 8)) AS BIGINT) % 101 / CAST(100 AS DOUBLE) AS ph,
  CAST(('0x' || substr(sha256('nb:' || example_id), 1, 8)) AS BIGINT) % 3 / CAST(2 AS DOUBLE) AS nb, CAST(('0x' || substr(sha256('na:' || example_id), 1, 8)) AS BIGINT) % 3 / CAST(2 AS DOUBLE) AS na FROM conf),
  g AS (SELECT i AS improve, h AS harm, pi >= i AND ph <= h AS take, nb, na FROM d, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) a(i), (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE)) c(h))
  SELECT improve, harm, avg(CASE WHEN take THEN na ELSE nb END) AS ndcg, count(*) FILTER (take) AS accepts, coalesce(count(*) FILTER (take AND na < nb) / CAST(nullif(count(*) FILTER (take), 0) AS DOUBLE), 0) AS harm_rate,
  count(*) FILTER (take) >= 50 AND coalesce(count(*) FILTER (take AND na < nb) / CAST(nullif(count(*) FILTER (take), 0) AS DOUBLE), 0) <= 0.35::DOUBLE AS allowed FROM g GROUP BY ALL""")
def threshold_grid(spark, sf_dir):
    return enrich.threshold_grid(_override(spark, sf_dir), [0.3, 0.5, 0.7], [0.2, 0.4, 0.6], 0.35, 50)


@query("override_model")
def override_model(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    data = _override(spark, sf_dir).withColumn("better", F.when(F.col("ndcg_after") > F.col("ndcg_before"), 1).otherwise(0))
    data = checkpointed(data.select("example_id", "split", "confidence", "preference", "p_improve", "p_harm", "better"))  # the fit reads its rows several times
    model = enrich.override_model(data.where("split = 'valid'"), ["confidence", "preference", "p_improve", "p_harm"], "better")
    return model.transform(data.where("split = 'test'")).select("example_id", F.round(vector_to_array("probability")[1], 6).alias("p_improve_fit"))


@query("metric_rows", f"""{CONF}, m AS (SELECT bucket, avg(confidence) AS mean_confidence, avg(CAST(correct AS DOUBLE)) AS accuracy FROM conf GROUP BY bucket)
  SELECT bucket AS scope, 'mean_confidence' AS metric, mean_confidence AS value FROM m UNION ALL SELECT bucket, 'accuracy', accuracy FROM m""")
def metric_rows(spark, sf_dir):
    wide = rows(spark, sf_dir).groupBy("bucket").agg(F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return sinks.metric_rows(wide, ["bucket"])
