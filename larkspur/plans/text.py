"""Queries on grounding, parsing and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import audit, failures, grounding, metrics, mock, parsing
from larkspur.operators.rounds import checkpointed
from larkspur.plans.data import ITEMS, test_examples, train_popularity
from larkspur.plans.ranking import CAND, PRED, predicted
from larkspur.sources import views

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def titles(spark, sf_dir) -> DataFrame:
    """Titles with noise: as written, in capitals with punctuation, with a word dropped or two added."""
    items = views.items(spark, sf_dir)
    kind = F.pmod(F.col("item_id").cast("int"), F.lit(4))
    words = F.split("title", " ")
    noisy = (
        F.when(kind == 0, F.col("title")).when(kind == 1, F.concat(F.upper("title"), F.lit("!")))
        .when(kind == 2, F.array_join(F.slice(words, 2, 100), " ")).otherwise(F.concat(F.col("title"), F.lit(" deluxe edition")))
    )
    return items.select(F.col("item_id").alias("title_id"), noisy.alias("title"))


TITLES = """tt AS (SELECT item_id AS title_id, CASE CAST(item_id AS INTEGER) % 4 WHEN 0 THEN title WHEN 1 THEN upper(title) || '!' WHEN 2 THEN array_to_string(string_split(title, ' ')[2:], ' ') ELSE title || ' deluxe edition' END AS title
  FROM items)"""
_FLAT = "trim(regexp_replace(regexp_replace(lower({}), '[!\"#$%&''()*+,./:;<=>?@\\[\\\\\\]^_`{{|}}~-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("ground_titles", f"""WITH {ITEMS}, {TITLES}, c AS (SELECT item_id, lower(title) AS k, {_FLAT.format("title")} AS f FROM items), t AS (SELECT title_id, lower(title) AS k, {_FLAT.format("title")} AS f FROM tt),
  ex AS (SELECT k, min(item_id) AS id FROM c GROUP BY k), fl AS (SELECT f, min(item_id) AS id FROM c GROUP BY f),
  j AS (SELECT t.*, ex.id AS e, fl.id AS l FROM t LEFT JOIN ex USING (k) LEFT JOIN fl ON fl.f = t.f),
  ct AS (SELECT item_id, list_distinct(string_split(f, ' ')) AS b FROM c), jt AS (SELECT title_id, list_distinct(string_split(f, ' ')) AS a FROM j WHERE e IS NULL AND l IS NULL),
  o AS (SELECT title_id, item_id, len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) AS s FROM jt, ct WHERE list_has_any(a, b)),
  n AS (SELECT * FROM o WHERE s >= 0.5 QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY s DESC, item_id) = 1)
  SELECT j.title_id, coalesce(e, l, n.item_id) AS item_id, CASE WHEN e IS NOT NULL THEN 'exact' WHEN l IS NOT NULL THEN 'normalized' WHEN n.item_id IS NOT NULL THEN 'token_overlap' ELSE 'no_match' END AS status,
    CASE WHEN e IS NOT NULL THEN 1 WHEN l IS NOT NULL THEN 0.98::DOUBLE ELSE coalesce(s, 0) END AS score FROM j LEFT JOIN n USING (title_id)""")
def ground_titles(spark, sf_dir):
    return grounding.ground(titles(spark, sf_dir), views.items(spark, sf_dir))


@query("ground_blocked", f"""WITH {ITEMS}, {TITLES}, norm AS (SELECT title_id AS id, true AS q, trim(regexp_replace(regexp_replace(lower(title), '&', ' and ', 'g'), '[^a-z0-9_]+', ' ', 'g')) AS f FROM tt
    UNION ALL SELECT item_id, false, trim(regexp_replace(regexp_replace(lower(title), '&', ' and ', 'g'), '[^a-z0-9_]+', ' ', 'g')) FROM items),
  p AS (SELECT id, q, length(f) AS n, replace(f, ' ', '') AS z, f FROM norm),
  k AS (SELECT id, q, n, unnest(list_distinct(list_filter(string_split(f, ' '), lambda x: length(x) >= 2))) AS g, 4 AS w FROM p UNION ALL SELECT id, q, n, '#' || unnest(list_distinct(list_transform(range(1, length(z) - 1), lambda i: substr(z, i, 3)))), 1 FROM p),
  s AS (SELECT a.id AS title_id, b.id AS item_id, CAST(sum(a.w) AS BIGINT) AS weight, abs(any_value(a.n) - any_value(b.n)) AS gap FROM k a JOIN k b ON a.g = b.g AND a.q AND NOT b.q GROUP BY ALL)
  SELECT title_id, item_id, weight, CAST(row_number() OVER (PARTITION BY title_id ORDER BY weight DESC, gap, item_id) AS INTEGER) AS place FROM s QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY weight DESC, gap, item_id) <= 20""")
def ground_blocked(spark, sf_dir):
    return grounding.blocked(titles(spark, sf_dir), views.items(spark, sf_dir), 20).select("title_id", "item_id", "weight", "place")


@query("ground_fuzzy")
def ground_fuzzy(spark, sf_dir):
    return grounding.ground_fuzzy(titles(spark, sf_dir), views.items(spark, sf_dir), k=2).select("title_id", "item_id", "status", "score", "ambiguity")


@query("grounding_candidates")
def grounding_candidates(spark, sf_dir):
    items = views.items(spark, sf_dir).join(train_popularity(spark, sf_dir).select("item_id", "popularity"), "item_id", "left")
    return grounding.catalog_candidates(titles(spark, sf_dir), items)


def _failures(spark, sf_dir) -> DataFrame:
    """Failures of ``ground_fuzzy``; the item that a title was made from is its target, the best candidate's score its confidence."""
    items = views.items(spark, sf_dir).join(train_popularity(spark, sf_dir).select("item_id", "popularity"), "item_id", "left")
    asked = titles(spark, sf_dir)
    found = grounding.ground_fuzzy(asked, items, k=2).select("title_id", "status", "item_id", F.get("candidates", F.lit(0))["score"].alias("confidence"))
    rows = asked.join(found, "title_id").join(items.select(F.col("item_id").alias("title_id"), F.col("title").alias("target_title")), "title_id", "left")
    return failures.classified(checkpointed(rows), items)


@query("grounding_failures")
def grounding_failures(spark, sf_dir):
    rows = _failures(spark, sf_dir)
    return rows.select("title_id", "status", "top_score", "second_score", "margin", "target_ratio", F.array_join("categories", ",").alias("categories"), F.array_join("actions", ",").alias("actions"))


@query("catalog_summary", f"""WITH {ITEMS}, c AS (SELECT regexp_replace(trim(regexp_replace(replace(lower(title), '&', ' and '), '[^a-z0-9_]+', ' ', 'g')), '^(a|an|the) ', '') AS f, title, category FROM items), g AS (SELECT count(*) AS c FROM c WHERE f <> '' GROUP BY f HAVING count(*) > 1)
  SELECT (SELECT count(*) FROM c) AS items, (SELECT count(*) FROM c WHERE trim(title) = '') AS empty_titles, (SELECT count(*) FROM g) AS duplicate_groups, (SELECT coalesce(sum(c), 0)::BIGINT FROM g) AS duplicate_items,
    (SELECT coalesce(sum(c), 0) FROM g) / (SELECT count(*) FROM c)::DOUBLE AS duplicate_share, (SELECT count(DISTINCT category) FROM c) AS buckets""")
def catalog_summary(spark, sf_dir):
    items = views.items(spark, sf_dir).withColumn("bucket", F.col("category"))
    return failures.catalog_summary(items).withColumn("buckets", F.size("buckets").cast("long"))


def answers(spark, sf_dir) -> DataFrame:
    """Mock answers in five styles, by the example's hash."""
    ex = test_examples(spark, sf_dir).select("example_id", "target")
    kind, c = mock.draw("kind", 5), mock.draw("c", 101)
    body = F.concat(F.lit('{"title": "Item '), "target", F.lit('", "confidence": "'), c.cast("string"), F.lit('%", "answer": "Yes"}'))
    raw = (
        F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("I think "), body, F.lit(" fits.")))
        .when(kind == 3, F.concat(F.lit("Title: Item "), "target", F.lit("\nConfidence: "), c.cast("string"), F.lit("%\nAnswer: no."))).otherwise(F.lit("I cannot answer."))
    )
    return ex.withColumn("raw", raw)


@query("parse_observations", f"""{CAND}, h AS (SELECT example_id, target, CAST(('0x' || substr(sha256('kind:' || example_id), 1, 8)) AS BIGINT) % 5 AS kind, CAST(('0x' || substr(sha256('c:' || example_id), 1, 8)) AS BIGINT) % 101 AS c FROM test)
  SELECT example_id, CASE kind WHEN 0 THEN 'strict' WHEN 1 THEN 'fenced' WHEN 2 THEN 'embedded' WHEN 3 THEN 'lines' ELSE 'failed' END AS strategy, CASE WHEN kind < 4 THEN 'Item ' || target END AS title, CASE WHEN kind < 4 THEN c / CAST(100 AS DOUBLE) END AS confidence,
  CASE WHEN kind < 3 THEN 'yes' WHEN kind = 3 THEN 'no' END AS verdict FROM h""")
def parse_observations(spark, sf_dir):
    return parsing.observations(answers(spark, sf_dir)).select("example_id", "strategy", "title", "confidence", "verdict")


@query("parse_rankings", f"""{CAND}, h AS (SELECT example_id, target, CAST(('0x' || substr(sha256('kind:' || example_id), 1, 8)) AS BIGINT) % 4 AS kind FROM test)
  SELECT example_id, CASE kind WHEN 1 THEN 'duplicate_label' WHEN 2 THEN 'unknown_label' WHEN 3 THEN 'unparsed' END AS error, CASE WHEN kind = 0 THEN target || ',x1' END AS items FROM h""")
def parse_rankings(spark, sf_dir):
    ex = test_examples(spark, sf_dir).select("example_id", "target")
    kind = mock.draw("kind", 4)
    answer = lambda a, b: F.lit(f'{{"ranking": [{{"label": "{a}", "score": 0.9}}, {{"label": "{b}", "score": 0.4}}]}}')
    raw = F.when(kind == 0, answer("A", "B")).when(kind == 1, answer("A", "A")).when(kind == 2, answer("A", "Z")).otherwise(F.lit("none"))
    labels = F.map_from_arrays(F.array(F.lit("A"), F.lit("B")), F.array(F.col("target"), F.lit("x1")))
    return parsing.rankings(ex.withColumn("raw", raw).withColumn("labels", labels)).select("example_id", "error", F.array_join("items", ",").alias("items"))


@query("artifact_check", f"""{PRED}, l AS (SELECT example_id, CAST(split_part(example_id, ':', 1) AS INTEGER) AS u, list(item_id ORDER BY k) AS items FROM top WHERE method = 'popularity' GROUP BY ALL),
  r0 AS (SELECT u, CASE WHEN u % 7 = 0 THEN 'x' || example_id ELSE example_id END AS example_id, CASE WHEN u % 13 = 0 THEN list_append(items, 'none') ELSE items END AS items FROM l), rk AS (SELECT example_id, items FROM r0 UNION ALL SELECT example_id, items FROM r0 WHERE u % 11 = 0),
  i AS (SELECT CASE WHEN CAST(user_id AS INTEGER) % 5 = 0 THEN 'y' || example_id ELSE example_id END AS example_id, history FROM ex WHERE split = 'test')
  SELECT (SELECT count(*) FROM i WHERE example_id NOT IN (SELECT example_id FROM rk)) AS missing, (SELECT count(*) FROM rk WHERE example_id NOT IN (SELECT example_id FROM i)) AS extra,
  (SELECT count(*) FROM (SELECT example_id FROM rk GROUP BY example_id HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM (SELECT unnest(items) AS item_id FROM rk) WHERE item_id NOT IN (SELECT item_id FROM items)) AS "unknown",
  (SELECT CAST(coalesce(sum(len(list_intersect(items, history))), 0) AS BIGINT) FROM rk JOIN i USING (example_id)) AS overlap""")
def artifact_check(spark, sf_dir):
    """All rankings and inputs; some keys are altered, rows repeated and items unknown, so that every count has something to find."""
    user = F.substring_index("example_id", ":", 1).cast("int")
    rankings = predicted(spark, sf_dir, ("popularity",)).select(user.alias("u"), "example_id", F.col("predicted").alias("items"))
    rankings = rankings.withColumn("example_id", F.when(F.col("u") % 7 == 0, F.concat(F.lit("x"), "example_id")).otherwise(F.col("example_id")))
    rankings = rankings.withColumn("items", F.when(F.col("u") % 13 == 0, F.array_append("items", "none")).otherwise(F.col("items")))
    rankings = rankings.unionByName(rankings.where("u % 11 = 0"))
    inputs = test_examples(spark, sf_dir).select("example_id", "history", user.alias("u"))
    inputs = inputs.withColumn("example_id", F.when(F.col("u") % 5 == 0, F.concat(F.lit("y"), "example_id")).otherwise(F.col("example_id")))
    return audit.artifact_check(rankings.select("example_id", "items"), inputs.select("example_id", "history"), views.items(spark, sf_dir))


@query("attribution", f"""{PRED}, l AS (SELECT method, example_id, list(item_id ORDER BY k) AS p FROM top GROUP BY ALL), z AS (SELECT method, example_id, rank, p FROM hit JOIN l USING (method, example_id)), a AS (SELECT * FROM z WHERE method = 'markov'), b AS (SELECT * FROM z WHERE method = 'popularity')
  SELECT a.example_id, CAST((a.rank IS NOT NULL)::INT - (b.rank IS NOT NULL)::INT AS INTEGER) AS d_hit, coalesce(1 / CAST(a.rank AS DOUBLE), 0) - coalesce(1 / CAST(b.rank AS DOUBLE), 0) AS d_mrr, a.p = b.p AS same_top FROM a JOIN b USING (example_id)""")
def attribution(spark, sf_dir):
    r = predicted(spark, sf_dir).withColumn("rank", metrics.rank_of(k=10))
    return audit.attribution(r.where("method = 'markov'"), r.where("method = 'popularity'"))


@query("conversation_cases", """WITH c AS (SELECT role, conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY role ORDER BY length(text) DESC, conv_id, turn) AS k FROM conversations) SELECT role, conv_id, turn, n, CAST(k AS INTEGER) AS place FROM c WHERE k <= 20""")
def conversation_cases(spark, sf_dir):
    c = views.read(spark, sf_dir, "conversations").select("role", "conv_id", "turn", F.length("text").cast("long").alias("n"))
    return audit.top_cases(c, "role", 20, [F.desc("n"), "conv_id", "turn"])
