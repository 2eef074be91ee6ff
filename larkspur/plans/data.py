"""Queries on cleaning, popularity, sequences and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import filters, popularity, splits
from larkspur.sources import atomic, views

INTER = """inter AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_id, CAST(epoch(o_orderdate) AS DOUBLE) AS ts,
  CAST(l_quantity AS DOUBLE) AS rating, l_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
ITEMS = """items AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, concat_ws(' ', p_name, p_brand, p_type) AS title, p_name AS name, p_type AS category, p_brand AS brand FROM part)"""
SEQ = f"""{INTER}, seq AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id, l_orderkey, l_linenumber) - 1 AS idx,
  count(*) OVER (PARTITION BY user_id) AS n FROM inter)"""
EX = f"""{SEQ}, ex AS (SELECT user_id || ':' || idx AS example_id, user_id, idx, n, ts, item_id AS target,
  coalesce(list(item_id) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS history,
  CASE WHEN idx = n - 1 THEN 'test' WHEN idx = n - 2 AND n >= 3 THEN 'valid' WHEN idx >= 1 AND idx < greatest(1, n - 2) THEN 'train' END AS split FROM seq WHERE n > 1)"""
POP = """pop AS (SELECT item_id, count(*) AS popularity FROM (SELECT unnest(list_append(history, target)) AS item_id FROM ex WHERE split = 'train') GROUP BY item_id),
pops AS (SELECT items.item_id, title, category, brand, coalesce(popularity, 0) AS popularity FROM items LEFT JOIN pop USING (item_id)),
ranks AS (SELECT *, row_number() OVER (ORDER BY popularity DESC, item_id) AS pop_rank, count(*) OVER () AS n_items FROM pops)"""
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leave_one_out(views.interactions(spark, sf_dir))


def test_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.held_out(views.interactions(spark, sf_dir))


def train_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train counts of every catalog item."""
    counts = popularity.train_counts_of(splits.timeline(views.interactions(spark, sf_dir)))
    return popularity.with_catalog(counts, views.items(spark, sf_dir))


@query("clean_items", r"""SELECT CAST(p_partkey AS VARCHAR) AS item_id, trim(regexp_replace(regexp_replace('  ' || p_name || chr(9) || chr(7) || p_brand, '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')) AS title,
  coalesce(nullif(p_type, ''), 'unknown') AS category FROM part""")
def clean_items(spark, sf_dir):
    part = views.read(spark, sf_dir, "part")
    raw = F.concat(F.lit("  "), "p_name", F.lit("\t\x07"), "p_brand")
    return part.select(F.col("p_partkey").cast("string").alias("item_id"), T.clean_title(raw).alias("title"), F.coalesce(F.nullif("p_type", F.lit("")), F.lit("unknown")).alias("category"))


@query("item_text_policies", f"""WITH {ITEMS} SELECT item_id, title AS title_only, title || ' | ' || category AS title_category, title || ' category=' || category || ' brand=' || brand AS labelled FROM items""")
def item_text_policies(spark, sf_dir):
    items = views.items(spark, sf_dir)
    return items.select("item_id", *(T.item_text(p).alias(p) for p in ("title_only", "title_category", "labelled")))


@query("user_min_count", f"WITH {INTER} SELECT user_id, item_id, ts, count(*) OVER (PARTITION BY user_id) AS n FROM inter QUALIFY count(*) OVER (PARTITION BY user_id) >= 40")
def user_min_count(spark, sf_dir):
    return filters.users_with(views.interactions(spark, sf_dir), 40).select("user_id", "item_id", "ts", "n")


@query("k_core")
def k_core(spark, sf_dir):
    return filters.k_core(views.interactions(spark, sf_dir), 30, 28).select("user_id", "item_id", "ts")


@query("items_seen", f"WITH {INTER}, {ITEMS} SELECT item_id, title FROM items WHERE item_id IN (SELECT item_id FROM inter WHERE rating >= 50)")
def items_seen(spark, sf_dir):
    inter = views.interactions(spark, sf_dir).where("rating >= 50")
    return filters.items_in(views.items(spark, sf_dir), inter).select("item_id", "title")


@query("repeat_policy", f"""WITH {EX} SELECT example_id, list_contains(history, target) AS repeats, len(list_filter(history, lambda x: x = target)) AS times, len(history) - len(list_distinct(history)) AS duplicates,
  len(list_distinct(history)) AS distinct_items FROM ex WHERE split = 'test'""")
def repeat_policy(spark, sf_dir):
    ex = examples(spark, sf_dir).where("split = 'test'")
    return filters.repeat_features(ex).select("example_id", "repeats", "times", "duplicates", "distinct_items")


@query("round_robin_select", f"""WITH {EX}, {ITEMS}, {POP}, b AS (SELECT item_id, CASE WHEN pop_rank <= ceil(n_items * 0.2) THEN 'head' WHEN pop_rank > n_items - ceil(n_items * 0.2) THEN 'tail' ELSE 'mid' END AS bucket FROM ranks),
  t AS (SELECT example_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY ts, user_id, example_id) AS k FROM ex JOIN b ON target = item_id WHERE split = 'test')
  SELECT example_id, bucket, k FROM t ORDER BY k, CASE bucket WHEN 'head' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END LIMIT 90""")
def round_robin_select(spark, sf_dir):
    bucket = popularity.buckets_head_tail(popularity.ranked(train_popularity(spark, sf_dir))).select(F.col("item_id").alias("target"), "bucket")
    return filters.round_robin(examples(spark, sf_dir).where("split = 'test'").join(bucket, "target"), 90).select("example_id", "bucket", "k")


@query("item_popularity", f"WITH {INTER} SELECT item_id, count(*) AS popularity FROM inter GROUP BY item_id")
def item_popularity(spark, sf_dir):
    return popularity.item_counts(views.interactions(spark, sf_dir))


_RANKED = f"WITH {EX}, {ITEMS}, {POP} "


@query("train_popularity_rank", _RANKED + "SELECT item_id, popularity, pop_rank FROM ranks")
def train_popularity_rank(spark, sf_dir):
    return popularity.ranked(train_popularity(spark, sf_dir)).drop("n_items")


@query("buckets_20_30_50", _RANKED + "SELECT item_id, CASE WHEN pop_rank <= ceil(n_items * 0.2) THEN 'head' WHEN pop_rank <= ceil(n_items * 0.2) + ceil(n_items * 0.3) THEN 'mid' ELSE 'tail' END AS bucket FROM ranks")
def buckets_20_30_50(spark, sf_dir):
    return popularity.buckets_by_fraction(popularity.ranked(train_popularity(spark, sf_dir))).select("item_id", "bucket")


@query("buckets_20_20", _RANKED + "SELECT item_id, CASE WHEN pop_rank <= ceil(n_items * 0.2) THEN 'head' WHEN pop_rank > n_items - ceil(n_items * 0.2) THEN 'tail' ELSE 'mid' END AS bucket FROM ranks")
def buckets_20_20(spark, sf_dir):
    return popularity.buckets_head_tail(popularity.ranked(train_popularity(spark, sf_dir))).select("item_id", "bucket")


@query("buckets_quantile", _RANKED + """, s AS (SELECT list_sort(list(popularity)) AS l, count(*) AS n FROM pops)
  SELECT item_id, CASE WHEN popularity >= l[CAST(floor(n * 0.8) AS BIGINT) + 1] THEN 'head' WHEN popularity >= l[CAST(floor(n * 0.5) AS BIGINT) + 1] THEN 'mid' ELSE 'tail' END AS bucket FROM pops, s""")
def buckets_quantile(spark, sf_dir):
    return popularity.buckets_by_quantile(train_popularity(spark, sf_dir)).select("item_id", "bucket")


@query("buckets_extremes", _RANKED + """, s AS (SELECT max(popularity) AS hi, min(popularity) FILTER (popularity > 0) AS lo FROM pops)
  SELECT item_id, CASE WHEN popularity >= hi THEN 'head' WHEN popularity <= coalesce(lo, 0) THEN 'tail' ELSE 'mid' END AS bucket FROM pops, s""")
def buckets_extremes(spark, sf_dir):
    return popularity.buckets_by_extremes(train_popularity(spark, sf_dir)).select("item_id", "bucket")


@query("popularity_percentile", _RANKED + "SELECT item_id, cume_dist() OVER (ORDER BY popularity) AS percentile FROM pops")
def popularity_percentile(spark, sf_dir):
    return popularity.percentile(train_popularity(spark, sf_dir)).select("item_id", "percentile")


@query("train_counts", f"WITH {EX} SELECT item_id, count(*) AS popularity FROM (SELECT unnest(list_append(history, target)) AS item_id FROM ex WHERE split = 'train') GROUP BY item_id")
def train_counts(spark, sf_dir):
    return popularity.train_counts(examples(spark, sf_dir))


_EXAMPLE = "example_id, user_id, split, target, len(history) AS n_history, array_to_string(history, ',') AS history"


@query("loo_examples", f"WITH {EX} SELECT {_EXAMPLE} FROM ex WHERE split IS NOT NULL")
def loo_examples(spark, sf_dir):
    return examples(spark, sf_dir).select("example_id", "user_id", "split", "target", F.size("history").cast("long").alias("n_history"), F.array_join("history", ",").alias("history"))


@query("loo_last_train", f"WITH {EX} SELECT example_id, split FROM ex WHERE split IN ('valid', 'test') OR (split = 'train' AND idx >= n - 4)")
def loo_last_train(spark, sf_dir):
    return splits.leave_one_out(views.interactions(spark, sf_dir), train_limit=2).select("example_id", "split")


@query("rolling_examples", f"""WITH {SEQ} SELECT user_id || ':' || idx AS example_id, item_id AS target, greatest(idx - 10, 0) AS history_start,
  array_to_string(list(item_id) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), ',') AS history FROM seq QUALIFY idx >= 3""")
def rolling_examples(spark, sf_dir):
    return splits.rolling(views.interactions(spark, sf_dir)).select("example_id", "target", F.col("history_start").cast("long"), F.array_join("history", ",").alias("history"))


@query("chronological_split", f"""WITH {SEQ}, r AS (SELECT user_id || ':' || idx AS example_id, row_number() OVER (ORDER BY ts, user_id, user_id || ':' || idx) - 1 AS k, count(*) OVER () AS m FROM seq WHERE idx >= 3)
  SELECT example_id, CASE WHEN k < floor(m * 0.8) THEN 'train' WHEN k < floor(m * (CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE))) THEN 'valid' ELSE 'test' END AS split FROM r""")
def chronological_split(spark, sf_dir):
    return splits.chronological(splits.rolling(views.interactions(spark, sf_dir))).select("example_id", "split")


@query("leave_last", f"""WITH {SEQ} SELECT user_id || ':' || idx AS example_id, item_id AS target, CASE WHEN idx = n - 1 THEN 'test' WHEN idx = n - 2 AND n >= 5 THEN 'val' ELSE 'train' END AS split,
  array_to_string(list(item_id) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), ',') AS history FROM seq QUALIFY n > 3 AND idx >= 3 AND (idx = n - 1 OR (idx = n - 2 AND n >= 5) OR idx < greatest(3, n - 2))""")
def leave_last(spark, sf_dir):
    return splits.leave_last(views.interactions(spark, sf_dir), 3, 6, 2).select("example_id", "target", "split", F.array_join("history", ",").alias("history"))


@query("user_sequences", f"""WITH {INTER} SELECT user_id, array_to_string(list(item_id ORDER BY ts, item_id, l_orderkey, l_linenumber), ',') AS items, sum(rating) AS ratings FROM inter GROUP BY user_id""")
def user_sequences(spark, sf_dir):
    rows = splits.user_sequences(views.interactions(spark, sf_dir))
    return rows.select("user_id", F.array_join("items", ",").alias("items"), F.aggregate("ratings", F.lit(0.0), lambda a, x: a + x).alias("ratings"))


@query("item_index", f"WITH {INTER} SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) AS INTEGER) AS item_index FROM (SELECT DISTINCT item_id FROM inter)")
def item_index(spark, sf_dir):
    return splits.item_index(views.interactions(spark, sf_dir))


@query("padded_sequences", f"""WITH {SEQ}, ix AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS i FROM (SELECT DISTINCT item_id FROM inter)),
  h AS (SELECT user_id || ':' || idx AS example_id, i AS target_index, idx, list(i) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM seq JOIN ix USING (item_id) QUALIFY idx >= 1),
  f AS (SELECT example_id, target_index, list_filter(l, lambda x: x <> target_index) AS l FROM h), g AS (SELECT example_id, target_index, l[greatest(len(l) - 8, 0) + 1:] AS l FROM f)
  SELECT example_id, CAST(target_index AS INTEGER) AS target_index, array_to_string(list_concat(list_transform(range(8 - len(l)), lambda x: 0), l), ',') AS history_indices FROM g""")
def padded_sequences(spark, sf_dir):
    return splits.padded_sequences(views.interactions(spark, sf_dir)).select("example_id", "target_index", F.array_join("history_indices", ",").alias("history_indices"))


@query("longest_train_prefix", f"WITH {EX} SELECT user_id, array_to_string(list_append(history, target), ' ') AS prefix FROM ex WHERE split = 'train' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY idx DESC) = 1")
def longest_train_prefix(spark, sf_dir):
    return splits.longest_train_prefix(examples(spark, sf_dir)).select("user_id", F.array_join("prefix", " ").alias("prefix"))


@query("repeated_titles", f"""WITH {ITEMS} SELECT lower(name) AS title_key, count(*) AS n, array_to_string(list(item_id ORDER BY item_id), ',') AS item_ids FROM items GROUP BY lower(name) HAVING count(*) > 1""")
def repeated_titles(spark, sf_dir):
    return filters.repeated_titles(views.items(spark, sf_dir).withColumn("title", F.col("name")))


@query("history_buckets", f"""WITH {EX} SELECT CASE WHEN len(history) <= 2 THEN 'cold_user' WHEN len(history) <= 5 THEN 'warm_user' ELSE 'heavy_user' END AS history_bucket, split, count(*) AS n FROM ex WHERE split IS NOT NULL GROUP BY ALL""")
def history_buckets(spark, sf_dir):
    return examples(spark, sf_dir).groupBy(filters.history_bucket(F.size("history")).alias("history_bucket"), "split").agg(F.count("*").alias("n"))


@query("sequence_alignment", f"""WITH {EX} SELECT count(*) AS n, count(*) FILTER (len(history) <> idx) AS misplaced, 0::BIGINT AS late, count(*) FILTER (split = 'test') AS tests FROM ex WHERE split IS NOT NULL""")
def sequence_alignment(spark, sf_dir):
    """Every history equals the timeline before its target, and nothing in it is later than the target."""
    inter = views.interactions(spark, sf_dir)
    times = splits.timeline(inter).select("user_id", "idx", F.lag("ts").over(W.partitionBy("user_id").orderBy("idx")).alias("ts_before"))
    both = examples(spark, sf_dir).join(times, ["user_id", "idx"])
    return both.agg(
        F.count("*").alias("n"), F.count_if(F.size("history") != F.col("idx")).alias("misplaced"), F.count_if(F.col("ts_before") > F.col("ts")).alias("late"), F.count_if(F.col("split") == "test").alias("tests")
    )


@query("atomic_interactions", f"""WITH {EX}, m AS (SELECT user_id, max(idx) AS at_most FROM ex WHERE split = 'train' GROUP BY user_id)
  SELECT 'train' AS split, user_id, item_id, ts AS timestamp, CAST(idx AS INTEGER) AS place FROM seq JOIN m USING (user_id) WHERE idx <= at_most UNION ALL SELECT split, user_id, target, ts, CAST(idx AS INTEGER) FROM ex WHERE split IN ('valid', 'test')""")
def atomic_interactions(spark, sf_dir):
    timeline = splits.timeline(views.interactions(spark, sf_dir))
    return atomic.interaction_rows(examples(spark, sf_dir), timeline).select("split", "user_id", "item_id", "timestamp", F.col("place").cast("int").alias("place"))


@query("sequence_rows", f"""WITH {EX} SELECT split, user_id, target AS item_id, array_to_string(history[greatest(len(history) - 49, 1):], ' ') AS item_id_list, ts AS timestamp FROM ex WHERE split IS NOT NULL AND len(history) > 0""")
def sequence_rows(spark, sf_dir):
    rows = atomic.sequence_rows(examples(spark, sf_dir), splits.timeline(views.interactions(spark, sf_dir)))
    return rows.withColumn("item_id_list", F.array_join("item_id_list", " "))
