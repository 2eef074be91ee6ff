"""Queries on rows for review and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import candidates as C
from larkspur.operators import records
from larkspur.plans.confidence import CONF, rows
from larkspur.plans.data import EX, ITEMS, test_examples
from larkspur.plans.ranking import BUCKET, CAND, POP_SCORE, buckets, scored, test_candidates
from larkspur.sources import views

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _h(text: str) -> str:
    return f"CAST(('0x' || substr(sha256({text}), 1, 8)) AS BIGINT)"


def _cases(spark, sf_dir):
    """Confidence rows with a generated item: another example's target, by the same mock draw as in the SQL."""
    answers = C.hash_number(F.concat(F.lit("v:"), "example_id"))
    made = F.element_at(F.array(F.lit("head"), F.lit("mid"), F.lit("tail"), F.lit("unknown")), (answers % 4 + 1).cast("int"))
    return rows(spark, sf_dir).select(
        "example_id", "confidence", "correct", "is_grounded", "ambiguity", "bucket", "popularity", F.when(answers % 3 == 0, "fuzzy").otherwise("exact").alias("status"),
        (answers % 2 == 0).alias("verified"), made.alias("made_bucket"), (answers % 50).alias("made_popularity"),
    )


_CASES = f"""{CONF}, v AS (SELECT *, {_h("'v:' || example_id")} AS v FROM conf), k AS (SELECT *, ['head', 'mid', 'tail', 'unknown'][v % 4 + 1] AS made, v % 50 AS mp,
  CASE WHEN NOT is_grounded THEN 'ungrounded' WHEN correct = 1 THEN 'correct' ELSE 'wrong' END || CASE WHEN confidence >= 0.7::DOUBLE THEN '_high' WHEN confidence < 0.5 THEN '_low' ELSE '_intermediate' END || '_confidence' AS label_ FROM v),
tagged AS (SELECT example_id, list_sort(list_distinct([x FOR x IN [label_, CASE WHEN v % 2 = 0 AND correct = 0 THEN 'self_verified_wrong' END, CASE WHEN NOT is_grounded THEN 'grounding_failure' END,
  CASE WHEN is_grounded AND v % 3 = 0 THEN 'fuzzy_grounding' END, CASE WHEN ambiguity >= 0.5 THEN 'grounding_ambiguous' END, CASE WHEN bucket IN ('head', 'mid', 'tail') THEN 'target_' || bucket END,
  CASE WHEN made <> 'unknown' THEN 'generated_' || made END, CASE WHEN mp > 0 AND mp >= 2 * greatest(popularity, 1) THEN 'generated_more_popular_than_target' END,
  CASE WHEN made = 'head' AND bucket = 'tail' THEN 'generated_head_target_tail' END, CASE WHEN made = 'head' AND correct = 0 AND confidence >= 0.7::DOUBLE THEN 'wrong_high_confidence_generated_head' END,
  CASE WHEN bucket = 'tail' AND correct = 1 AND confidence < 0.5 THEN 'correct_low_confidence_tail' END] IF x IS NOT NULL])) AS tags FROM k)"""
_ADVICE = ", ".join(f"('{tag}', '{todo}')" for tag, many in records.ACTIONS.items() for todo in many)


@query("case_tags", f"{_CASES} SELECT example_id, array_to_string(tags, ',') AS tags FROM tagged")
def case_tags(spark, sf_dir):
    return _cases(spark, sf_dir).select("example_id", F.array_join(records.tags(), ",").alias("tags"))


@query("case_actions", f"""{_CASES}, todo(tag, action) AS (VALUES {_ADVICE}), t AS (SELECT example_id, unnest(tags) AS tag FROM tagged), a AS (SELECT DISTINCT example_id, action FROM t JOIN todo USING (tag)),
  x AS (SELECT tagged.example_id, coalesce(action, '{records.OTHERWISE}') AS action FROM tagged LEFT JOIN a USING (example_id)) SELECT action, count(*) AS n FROM x GROUP BY action""")
def case_actions(spark, sf_dir):
    tagged = _cases(spark, sf_dir).withColumn("tags", records.tags())
    return tagged.select(F.explode(records.actions()).alias("action")).groupBy("action").agg(F.count("*").alias("n"))


@query("quadrants", f"""{CONF} SELECT bucket, count(*) FILTER (correct = 1 AND confidence >= 0.7::DOUBLE) AS correct_high, count(*) FILTER (correct = 1 AND confidence < 0.5) AS correct_low,
  count(*) FILTER (correct = 0 AND confidence >= 0.7::DOUBLE) AS wrong_high, count(*) FILTER (correct = 0 AND confidence < 0.5) AS wrong_low, count(*) AS n FROM conf GROUP BY bucket""")
def quadrants(spark, sf_dir):
    return records.quadrants(rows(spark, sf_dir), ["bucket"])


_PLACED = f"{CAND}, s AS ({POP_SCORE}), p AS (SELECT example_id, item_id, score, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, item_id) AS spot, {_h("'f:' || example_id || ':' || item_id")} AS h FROM s)"


def _placed(spark, sf_dir):
    from larkspur.plans.baselines import baselines_rank

    return baselines_rank(scored(spark, sf_dir, "popularity")).withColumnRenamed("k", "at").withColumn("h", C.hash_number(F.concat(F.lit("f:"), "example_id", F.lit(":"), "item_id")))


@query("filled_ranking", f"""{_PLACED} SELECT example_id, item_id, CAST(row_number() OVER (PARTITION BY example_id ORDER BY CASE WHEN h % 3 = 0 THEN h END NULLS LAST, spot, item_id) AS INTEGER) AS place,
  CASE WHEN h % 3 = 0 THEN CAST(h % 100 AS DOUBLE) / 100 ELSE 0 END AS score FROM p""")
def filled_ranking(spark, sf_dir):
    """A mock answer ranks a third of the candidates by a hash, repeats them at the end, names an item outside and one that isn't grounded."""
    placed = _placed(spark, sf_dir)
    picked = placed.where("h % 3 = 0").select("example_id", F.col("h").alias("rank"), "item_id", ((F.col("h") % 100) / 100).alias("score"))
    again = picked.select("example_id", F.col("rank") + F.lit(2**33), "item_id", F.lit(1.0))
    outside = placed.where("at = 1").select("example_id", F.lit(0).cast("long"), F.explode(F.array(F.lit("no such item"), F.lit(None).cast("string"))), F.lit(1.0))
    return records.filled_ranking(picked.union(again).union(outside), placed.select("example_id", "item_id", "at"))


@query("panel_stats", f"""{_PLACED}, n AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY spot) AS f, CASE WHEN h % 3 = 0 THEN CAST(h AS DOUBLE) END AS answer FROM p WHERE spot <= 15),
  o AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY answer DESC NULLS LAST, f) AS place, max(answer) OVER (PARTITION BY example_id) IS NOT NULL AS answered FROM n),
  t AS (SELECT test.example_id, f, answered, CASE WHEN answer IS NOT NULL THEN place END AS place FROM test LEFT JOIN o ON o.example_id = test.example_id AND o.item_id = test.target)
  SELECT avg(CASE WHEN f IS NULL THEN 0 ELSE 1 END) AS in_panel, avg(f) FILTER (answered) AS fallback_place, avg(coalesce(place, 999)) FILTER (answered) AS answer_place, avg(CASE WHEN place = 1 THEN 1 ELSE 0 END) FILTER (answered) AS top_hit FROM t""")
def panel_stats(spark, sf_dir):
    panels = _placed(spark, sf_dir).where("at <= 15").select("example_id", "item_id", F.col("at").alias("place"), F.col("at").alias("fallback"), F.when(F.col("h") % 3 == 0, F.col("h").cast("double")).alias("score"))
    return records.panel_stats(panels, test_examples(spark, sf_dir))


@query("labelled_panel", f"""{_PLACED} SELECT example_id, string_agg(chr(CAST(64 + spot AS INTEGER)) || '=' || item_id, ' ' ORDER BY spot) AS labels, string_agg(spot || '. ' || title, chr(10) ORDER BY spot) AS lines FROM p JOIN items USING (item_id) WHERE spot <= 15 GROUP BY example_id""")
def labelled_panel(spark, sf_dir):
    panels = _placed(spark, sf_dir).where("at <= 15").select("example_id", "item_id", F.col("at").alias("place")).join(views.items(spark, sf_dir).select("item_id", "title"), "item_id")
    told = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), " ")
    return records.labelled_panel(panels).select("example_id", told.alias("labels"), "lines")


@query("chat_rows", f"""{CAND} SELECT cand.example_id, cand.item_id, '[{{"role":"user","content":"After ' || t.history[-1] || ', is ' || cand.item_id || ' next?"}},{{"role":"assistant","content":"' || CASE WHEN cand.item_id = t.target THEN 'Yes.' ELSE 'No.' END || '"}}]' AS messages
  FROM cand JOIN test t ON t.example_id = cand.example_id""")
def chat_rows(spark, sf_dir):
    prompt = F.concat(F.lit("After "), F.element_at("history", -1), F.lit(", is "), F.col("item_id"), F.lit(" next?"))
    return records.chat_rows(test_candidates(spark, sf_dir), prompt)


@query("strict_enrichment", f"""WITH {EX}, {ITEMS}, t AS (SELECT * FROM ex WHERE split = 'test'), h AS (SELECT example_id, unnest(history) AS item_id, generate_subscripts(history, 1) AS spot FROM t),
  n AS (SELECT example_id, string_agg(title, '|' ORDER BY spot) AS titles FROM h JOIN items USING (item_id) GROUP BY example_id) SELECT t.example_id, title AS target_title, titles FROM t JOIN items ON item_id = target JOIN n ON n.example_id = t.example_id""")
def strict_enrichment(spark, sf_dir):
    out = records.strictly_enriched(test_examples(spark, sf_dir), views.items(spark, sf_dir))
    return out.select("example_id", "target_title", F.array_join("titles", "|").alias("titles"))


@query("candidate_summary", f"""{CAND}, {BUCKET}, p AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY item_id) AS place FROM cand),
  g AS (SELECT *, {_h("'g:' || example_id")} AS g FROM test), a AS (SELECT example_id, target, history, g, CASE g % 4 WHEN 0 THEN NULL WHEN 1 THEN history[-1] ELSE target END AS item_id FROM g)
  SELECT bucket, count(*) AS n, count(place) AS chosen, count(*) FILTER (a.item_id IS NOT NULL AND place IS NULL) AS elsewhere, count(*) FILTER (a.item_id IS NULL) AS ungrounded, 0::BIGINT AS target_excluded,
    count(*) FILTER (list_contains(history, a.item_id)) AS from_history, count(place) / CAST(count(*) AS DOUBLE) AS chosen_rate, avg(place) AS mean_place,
    count(*) FILTER (place IS NOT NULL AND a.item_id <> target AND g % 101 >= 70) AS wrong_high
  FROM a JOIN b ON b.item_id = a.target LEFT JOIN p ON p.example_id = a.example_id AND p.item_id = a.item_id GROUP BY bucket""")
def candidate_summary(spark, sf_dir):
    drawn = test_candidates(spark, sf_dir, listed=True).select("example_id", "target", "history", F.array_sort("candidates").alias("cands"))  # 31 at most
    g = C.hash_number(F.concat(F.lit("g:"), "example_id"))
    item = F.when(g % 4 == 1, F.element_at("history", -1)).when(g % 4 > 1, F.col("target"))
    answers = drawn.withColumn("g", g).withColumn("item_id", item)
    answers = answers.select(
        "item_id", F.nullif(F.array_position("cands", F.col("item_id")), F.lit(0)).alias("place"), F.array_contains("cands", F.col("target")).alias("target_in_candidates"), "target",
        F.array_contains("history", F.col("item_id")).alias("from_history"), (F.col("g") % 101 / 100).alias("confidence"), F.coalesce(F.col("item_id") == F.col("target"), F.lit(False)).cast("int").alias("correct"),
    )
    known = buckets(spark, sf_dir).select(F.col("item_id").alias("target"), "bucket")
    return records.candidate_summary(answers.join(known, "target"), ["bucket"])
