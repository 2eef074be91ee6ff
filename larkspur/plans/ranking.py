"""Queries on candidates, rankers and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators import candidates, filters, metrics, popularity, rankers, splits
from larkspur.operators.rounds import checkpointed
from larkspur.plans.data import EX, ITEMS, POP, test_examples, train_popularity
from larkspur.sources import views

QUERIES, SQL = {}, {}
DRAWS = 30


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def test_candidates(spark, sf_dir, listed: bool = False) -> DataFrame:
    """A row for each test example and candidate; ``listed``: one for each example, with all its candidates."""
    test = test_examples(spark, sf_dir).select("example_id", "user_id", "target", "history")
    return (candidates.drawn_lists if listed else candidates.drawn)(test, splits.item_index(views.items(spark, sf_dir)), DRAWS)


def known_candidates(spark, sf_dir, methods=("popularity", "markov"), lists: DataFrame | None = None) -> DataFrame:
    """A row for each test example, its candidates with what the rankers know of them. The timelines are ordered once, for the examples, the counts and the moves."""
    lists = checkpointed(splits.listed(views.interactions(spark, sf_dir))) if lists is None else lists
    known = popularity.with_catalog(popularity.train_counts_of(splits.unlisted(lists)), views.items(spark, sf_dir))
    test = splits.held_out_of(lists).select("example_id", "user_id", "target", "history")
    return candidates.drawn_known(test, splits.item_index(views.items(spark, sf_dir)), known, DRAWS, rankers.transitions_of(lists) if "markov" in methods else None)


def scored(spark, sf_dir, method: str) -> DataFrame:
    if method in ("popularity", "markov"):
        rows = known_candidates(spark, sf_dir, [method]).select("example_id", "user_id", "target", "history", F.explode("candidates").alias("c"))
        return rows.select("example_id", "user_id", "target", "history", "c.item_id", "c.popularity", rankers.list_score(method)(F.col("c")).alias("score"))
    rows = test_candidates(spark, sf_dir)
    if method == "last_item":
        return rankers.by_last_item(rows)
    if method == "cooccurrence":
        return rankers.by_cooccurrence(test_candidates(spark, sf_dir, listed=True), splits.timeline(views.interactions(spark, sf_dir)))
    if method == "bm25":
        return rankers.by_bm25(test_candidates(spark, sf_dir, listed=True), views.items(spark, sf_dir))
    return rankers.by_hash(rows)


def predicted(spark, sf_dir, methods=("popularity", "markov")) -> DataFrame:
    """Prediction rows of several methods, with the slice columns of each example."""
    rows = known_candidates(spark, sf_dir, methods)
    rows = rows.select("example_id", "user_id", "target", filters.history_bucket(F.size("history")).alias("history_bucket"), "candidates")
    return rankers.list_predictions(rows, list(methods)).join(views.domains(spark, sf_dir), "user_id")


CAND = f"""WITH {EX}, {ITEMS}, {POP}, cat AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS m FROM items),
test AS (SELECT * FROM ex WHERE split = 'test'),
draws AS (SELECT example_id, CAST(('0x' || substr(sha256('13:' || example_id || ':' || j), 1, 8)) AS BIGINT) AS h FROM test, range({DRAWS}) AS r(j)),
cand AS (SELECT DISTINCT d.example_id, cat.item_id FROM draws d JOIN cat ON cat.i = d.h % cat.m JOIN test t ON t.example_id = d.example_id WHERE NOT list_contains(t.history, cat.item_id)
  UNION SELECT example_id, target FROM test)"""
POP_SCORE = "SELECT cand.example_id, cand.item_id, CAST(popularity AS DOUBLE) AS score FROM cand JOIN pops USING (item_id)"
MOVES = """seqs AS (SELECT list_append(history, target) AS s FROM ex WHERE split = 'train'),
moves AS (SELECT s[k] AS src, s[k + 1] AS dst, count(*) AS n FROM seqs, LATERAL (SELECT unnest(range(1, len(s))) AS k) GROUP BY ALL)"""
MARKOV_SCORE = """SELECT c.example_id, c.item_id, coalesce(CAST(moves.n AS DOUBLE), popularity * CAST(1e-6 AS DOUBLE)) AS score FROM cand c JOIN test t USING (example_id) JOIN pops p ON p.item_id = c.item_id
  LEFT JOIN moves ON src = t.history[-1] AND dst = c.item_id"""
PRED = f"""{CAND}, {MOVES}, scored AS (SELECT 'popularity' AS method, * FROM ({POP_SCORE}) UNION ALL SELECT 'markov', * FROM ({MARKOV_SCORE})),
r AS (SELECT *, row_number() OVER (PARTITION BY method, example_id ORDER BY score DESC, item_id) AS k FROM scored),
top AS (SELECT * FROM r WHERE k <= 10), hit AS (SELECT method, t.example_id, t.user_id, t.target, len(t.history) AS h, min(r.k) FILTER (r.item_id = t.target AND r.k <= 10) AS rank FROM r JOIN test t USING (example_id) GROUP BY ALL)"""


def _ranks(name: str, score_sql: str, extra: str = ""):
    sql = f"{CAND}{extra}, s AS ({score_sql}) SELECT example_id, item_id, score, CAST(row_number() OVER (PARTITION BY example_id ORDER BY round(score, 9) DESC, item_id) AS INTEGER) AS place FROM s"

    @query(f"rank_{name}", sql)
    def ranked(spark, sf_dir):
        order = W.partitionBy("example_id").orderBy(F.desc(F.round("score", 9)), "item_id")
        return scored(spark, sf_dir, name).select("example_id", "item_id", "score", F.row_number().over(order).alias("place"))

    return ranked


_ranks("popularity", POP_SCORE)
_ranks("markov", MARKOV_SCORE, f", {MOVES}")
_ranks("last_item", "SELECT c.example_id, c.item_id, CASE WHEN c.item_id = t.history[-1] THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM cand c JOIN test t USING (example_id)")
_ranks("hash", "SELECT example_id, item_id, CAST(1 AS DOUBLE) / row_number() OVER (PARTITION BY example_id ORDER BY sha256('13:' || example_id || ':' || item_id)) AS score FROM cand")
_ranks(
    "cooccurrence",
    """SELECT c.example_id, c.item_id, coalesce(sum(n * CAST(p AS DOUBLE) / m), CAST(0 AS DOUBLE)) AS score FROM cand c LEFT JOIN (
    SELECT example_id, unnest(history) AS src, unnest(range(1, len(history) + 1)) AS p, len(history) AS m FROM test) h ON h.example_id = c.example_id LEFT JOIN pairs ON pairs.src = h.src AND dst = c.item_id GROUP BY ALL""",
    ", pairs AS (SELECT src, dst, count(*) AS n FROM (SELECT unnest(history) AS src, target AS dst FROM ex WHERE split = 'train') GROUP BY ALL)",
)
_ranks(
    "bm25",
    """SELECT c.example_id, c.item_id, coalesce(sum(q * w), CAST(0 AS DOUBLE)) AS score FROM cand c LEFT JOIN wt ON wt.item_id = c.item_id LEFT JOIN asked a ON a.example_id = c.example_id AND a.t = wt.t GROUP BY ALL""",
    """, wd AS (SELECT item_id, regexp_extract_all(lower(title), '[a-z0-9]+') AS ws FROM items), tf AS (SELECT item_id, len(ws) AS dl, unnest(ws) AS t, 1 AS o FROM wd),
    tfs AS (SELECT item_id, dl, t, count(*) AS tf FROM tf GROUP BY ALL), dfs AS (SELECT t, count(*) AS df FROM tfs GROUP BY t), tot AS (SELECT count(*) AS nd, avg(len(ws)) AS avgdl FROM wd),
    wt AS (SELECT item_id, t, ln(CAST(1 AS DOUBLE) + (nd - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl)) AS w FROM tfs JOIN dfs USING (t), tot),
    hw AS (SELECT example_id, unnest(history) AS item_id FROM test), aw AS (SELECT example_id, unnest(ws) AS t FROM hw JOIN wd USING (item_id)), asked AS (SELECT example_id, t, count(*) AS q FROM aw GROUP BY ALL)""",
)


@query("drawn_candidates", f"{CAND} SELECT example_id, item_id FROM cand")
def drawn_candidates(spark, sf_dir):
    return test_candidates(spark, sf_dir).select("example_id", "item_id")


@query("hash_sample", f"{CAND} SELECT example_id, item_id, CAST(row_number() OVER (PARTITION BY example_id ORDER BY sha256(example_id || ':' || item_id), item_id) AS INTEGER) AS place FROM cand QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY sha256(example_id || ':' || item_id), item_id) <= 5")
def hash_sample(spark, sf_dir):
    return candidates.hash_sample(test_candidates(spark, sf_dir), F.col("example_id"), "item_id", 5, ["example_id"]).select("example_id", "item_id", "place")


BUCKET = "b AS (SELECT item_id, CASE WHEN pop_rank <= ceil(n_items * 0.2) THEN 'head' WHEN pop_rank > n_items - ceil(n_items * 0.2) THEN 'tail' ELSE 'mid' END AS bucket FROM ranks)"


def buckets(spark, sf_dir) -> DataFrame:
    return popularity.buckets_head_tail(popularity.ranked(train_popularity(spark, sf_dir)))


@query("listwise_panel", f"""{CAND}, n AS (SELECT c.example_id, c.item_id, popularity, c.item_id = t.target AS is_target FROM cand c JOIN test t ON t.example_id = c.example_id JOIN pops p ON p.item_id = c.item_id),
  o AS (SELECT *, max(is_target::INT) OVER (PARTITION BY example_id) AS mine, row_number() OVER (PARTITION BY example_id, is_target ORDER BY popularity DESC, sha256(example_id || ':head:' || item_id), item_id) AS top,
    row_number() OVER (PARTITION BY example_id, is_target ORDER BY popularity, sha256(example_id || ':tail:' || item_id), item_id) AS low FROM n),
  q AS (SELECT *, CASE WHEN is_target THEN 0 WHEN top <= 6 - mine THEN 1 ELSE 2 END AS part FROM o)
  SELECT example_id, item_id, CAST(row_number() OVER w AS INTEGER) AS place FROM q WINDOW w AS (PARTITION BY example_id ORDER BY part, CASE WHEN part = 1 THEN top ELSE low END) QUALIFY row_number() OVER w <= 12""")
def listwise_panel(spark, sf_dir):
    rows = scored(spark, sf_dir, "popularity").where("popularity is not null")
    return candidates.listwise_panel(rows).select("example_id", "item_id", "place")


@query("ranking_metrics", f"""{PRED} SELECT method, CAST(j AS INTEGER) AS k, count(*) AS n, avg(CASE WHEN rank <= j THEN 1.0::DOUBLE ELSE 0 END) AS recall, avg(CASE WHEN rank <= j THEN 1.0::DOUBLE / rank ELSE 0 END) AS mrr,
  avg(CASE WHEN rank <= j THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS ndcg FROM hit, (VALUES (1), (5), (10)) v(j) GROUP BY ALL""")
def ranking_metrics(spark, sf_dir):
    return metrics.ranking(predicted(spark, sf_dir), [1, 5, 10], ["method"])


@query("metrics_by_slice", f"""{PRED}, s AS (SELECT hit.*, c_mktsegment AS domain, CASE WHEN h <= 2 THEN 'cold_user' WHEN h <= 5 THEN 'warm_user' ELSE 'heavy_user' END AS history_bucket FROM hit JOIN customer ON CAST(c_custkey AS VARCHAR) = user_id),
  g AS (SELECT CASE WHEN method IS NOT NULL THEN 'method' WHEN history_bucket IS NOT NULL THEN 'history_bucket' WHEN domain IS NOT NULL THEN 'domain' ELSE 'all' END AS slice, coalesce(domain, history_bucket, method, 'all') AS value,
  count(*) AS n, avg(CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS recall, avg(CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS ndcg FROM s GROUP BY GROUPING SETS ((), (domain), (history_bucket), (method))) SELECT * FROM g""")
def metrics_by_slice(spark, sf_dir):
    return metrics.sliced(predicted(spark, sf_dir), ["domain", "history_bucket", "method"], 10)


@query("coverage", f"""{PRED} SELECT t.method, t.top / CAST(s.seen AS DOUBLE) AS coverage, t.top / CAST((SELECT count(*) FROM items) AS DOUBLE) AS catalog_coverage, CAST(1 AS DOUBLE) AS row_coverage, (SELECT count(DISTINCT user_id) FROM test) AS users
  FROM (SELECT method, count(DISTINCT item_id) AS top FROM top WHERE k <= 5 GROUP BY method) t JOIN (SELECT method, count(DISTINCT item_id) AS seen FROM scored GROUP BY method) s USING (method)""")
def coverage(spark, sf_dir):
    return metrics.coverage(predicted(spark, sf_dir), 5, views.items(spark, sf_dir), ["method"])


@query("validity", f"{PRED} SELECT method, CAST(1 AS DOUBLE) AS valid, CAST(0 AS DOUBLE) AS hallucinated, count(DISTINCT example_id) AS n FROM top GROUP BY method")
def validity(spark, sf_dir):
    return metrics.validity(predicted(spark, sf_dir), ["method"])


@query("diversity", f"""{PRED}, c AS (SELECT method, example_id, category, count(*) AS c FROM top JOIN items USING (item_id) WHERE k <= 5 GROUP BY ALL),
  e AS (SELECT method, example_id, sum(c) AS n, sum(c * (c - 1)) AS same, count(*) AS cats, -sum(c / m * log2(c / m)) AS ent FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY method, example_id) AS DOUBLE) AS m FROM c) GROUP BY ALL)
  SELECT method, avg(CASE WHEN n > 1 THEN 1 - same / CAST(n * (n - 1) AS DOUBLE) ELSE 0 END) AS ild, avg(CAST(cats AS DOUBLE)) AS categories, avg(ent) AS entropy FROM e GROUP BY method""")
def diversity(spark, sf_dir):
    return metrics.diversity(predicted(spark, sf_dir), views.items(spark, sf_dir), 5, ["method"])


@query("novelty", f"""{PRED}, tt AS (SELECT sum(popularity) AS total, count(*) AS size FROM pops) SELECT method, avg(-log2((popularity + 1) / CAST(total + size AS DOUBLE))) AS self_information, avg(CAST(pop_rank AS DOUBLE)) AS popularity_rank
  FROM top JOIN ranks USING (item_id), tt WHERE k <= 5 GROUP BY method""")
def novelty(spark, sf_dir):
    return metrics.novelty(predicted(spark, sf_dir), popularity.ranked(train_popularity(spark, sf_dir)), 5, ["method"])


@query("long_tail", f"""{PRED}, {BUCKET}, h AS (SELECT method, bucket, avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate FROM hit JOIN b ON b.item_id = target GROUP BY ALL),
  c AS (SELECT method, bucket, count(DISTINCT item_id) AS c FROM top JOIN b USING (item_id) WHERE k <= 5 GROUP BY ALL), z AS (SELECT bucket, count(*) AS size FROM b GROUP BY bucket)
  SELECT h.method, h.bucket, hit_rate, coalesce(c / CAST(size AS DOUBLE), 0) AS bucket_coverage FROM h LEFT JOIN c ON c.method = h.method AND c.bucket = h.bucket LEFT JOIN z ON z.bucket = h.bucket""")
def long_tail(spark, sf_dir):
    return metrics.long_tail(predicted(spark, sf_dir), buckets(spark, sf_dir), 5, ["method"])


@query("seed_aggregate", """WITH v AS (SELECT c_mktsegment AS domain, c_nationkey % 5 AS seed, avg(c_acctbal) AS value FROM customer GROUP BY ALL)
  SELECT domain, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, count(*) AS seeds, 1.96::DOUBLE * coalesce(stddev_samp(value), 0) / sqrt(count(*)) AS ci95 FROM v GROUP BY domain""")
def seed_aggregate(spark, sf_dir):
    runs = views.read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("domain"), (F.col("c_nationkey") % 5).alias("seed")).agg(F.avg("c_acctbal").alias("value"))
    return metrics.over_seeds(runs, ["domain"])


@query("latency_percentiles", """SELECT event_type, count(*) AS n, sum(value) AS total, list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.5::DOUBLE, 0) AS BIGINT) + 1] AS p50, list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.95::DOUBLE, 0) AS BIGINT) + 1] AS p95 FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    e = views.read(spark, sf_dir, "events")
    ranks = metrics.nearest_ranks(e, "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).join(ranks, "event_type", "left").select("event_type", "n", "total", "p50", "p95")


@query("mf_als")
def mf_als(spark, sf_dir):
    inter = views.interactions(spark, sf_dir)
    model = rankers.factorised(inter)
    rows = test_candidates(spark, sf_dir).select("example_id", "item_id", F.col("user_id").cast("int").alias("user"), F.col("item_id").cast("int").alias("item"))
    return model.transform(rows).select("example_id", "item_id", F.coalesce(F.nanvl("prediction", F.lit(0.0)), F.lit(0.0)).cast("double").alias("score"))
