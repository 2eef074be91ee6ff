"""Rankers: fit by aggregation, score candidates by joins.

Candidates are rows (example_id, target, item_id, history, ...); a ranker adds ``score``. Order is
score descending, then item_id; unseen scores are 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import retrieval
from larkspur.operators.rounds import set_checkpoint_dir


def by_popularity(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    return candidates.join(counts.select("item_id", "popularity"), "item_id", "left").withColumn("score", F.coalesce("popularity", F.lit(0)).cast("double")).drop("popularity")


def by_last_item(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("score", F.when(F.col("item_id") == F.element_at("history", -1), 1.0).otherwise(0.0))


def by_hash(candidates: DataFrame, seed: int = 13) -> DataFrame:
    """A seeded order: 1 / (place + 1)."""
    order = W.partitionBy("example_id").orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), "example_id", "item_id"), 256))
    return candidates.withColumn("score", 1.0 / F.row_number().over(order))


def transitions(timeline: DataFrame) -> DataFrame:
    """(src, dst, n): neighbours within all train sequences of leave-one-out.

    The pair at idx, idx + 1 is in every train example from idx + 1 to n - 3, so it counts n - 3 - idx times.
    """
    following = F.lead("item_id").over(W.partitionBy("user_id").orderBy("idx"))
    pairs = timeline.withColumn("dst", following).where(F.col("idx") <= F.col("n") - 4)
    return pairs.groupBy(F.col("item_id").alias("src"), "dst").agg(F.sum(F.col("n") - 3 - F.col("idx")).alias("n"))


def transitions_of(lists: DataFrame) -> DataFrame:
    """``transitions`` from ``splits.listed`` rows."""
    n = F.size("items")
    steps = F.transform(F.sequence(F.lit(0), n - 4), lambda i: F.struct(F.get("items", i).alias("src"), F.get("items", i + 1).alias("dst"), (n - 3 - i).alias("n")))
    return lists.where(n >= 4).select(F.inline(steps)).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def list_score(method: str):
    """The score of one of ``candidates.drawn_known`` by popularity or markov, as ``by_popularity`` and ``by_markov`` tell it."""
    seen = lambda c: F.coalesce(c["popularity"], F.lit(0))
    if method == "popularity":
        return lambda c: seen(c).cast("double")
    return lambda c: F.coalesce(c["n"].cast("double"), seen(c) * F.lit(1e-6))


def list_predictions(lists: DataFrame, methods: list[str], k: int = 10) -> DataFrame:
    """``predictions`` of several methods from ``candidates.drawn_known`` rows: each example's list is ordered inside its row. All other columns stay."""

    def told(method: str):
        score = list_score(method)
        ranked = F.slice(F.sort_array(F.transform("candidates", lambda c: F.struct((-score(c)).alias("s"), c["item_id"].alias("item_id")))), 1, k)
        return F.struct(F.lit(method).alias("method"), ranked.alias("t"))

    kept = [c for c in lists.columns if c != "candidates"]
    rows = lists.select(*kept, F.sort_array(F.array_compact("candidates.item_id")).alias("candidates"), F.explode(F.array(*map(told, methods))).alias("x"))
    return rows.select(*kept, "candidates", F.col("x.t.item_id").alias("predicted"), F.transform("x.t.s", lambda s: -s).alias("scores"), F.col("x.method").alias("method"))


def by_markov(candidates: DataFrame, moves: DataFrame, counts: DataFrame) -> DataFrame:
    """Count of the move from the last item, else popularity times 1e-6."""
    rows = candidates.withColumn("src", F.element_at("history", -1)).join(moves.withColumnRenamed("dst", "item_id"), ["src", "item_id"], "left")
    rows = rows.join(counts.select("item_id", "popularity"), "item_id", "left")
    score = F.coalesce(F.col("n").cast("double"), F.coalesce("popularity", F.lit(0)) * F.lit(1e-6))
    return rows.withColumn("score", score).drop("src", "n", "popularity")


MOST_TRAILS = 2000  # of one item in one row


def by_cooccurrence(lists: DataFrame, timeline: DataFrame) -> DataFrame:
    """(example_id, item_id, score) of each candidate: sum over the history of count(item, candidate) weighted by place / length.

    ``lists``: example_id, all different, history, candidates. ``timeline``: of whole users; a pair counts for each train example of leave-one-out with the item in its history and the
    candidate as target, so each item is followed by what comes after it up to n - 3. These trails meet the candidates by item, and no row for a pair is made but of those that are found.
    """
    steps = timeline.where("idx <= n - 3 and item_id is not null").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("idx", "item_id"))).alias("s"))
    trails = steps.select("user_id", F.col("s.item_id").alias("s"), F.posexplode("s.item_id").alias("i", "src")).where(F.col("i") < F.size("s") - 1)
    trails = trails.select("user_id", "src", F.slice("s", F.col("i") + 2, F.size("s")).alias("dst"))
    parts = trails.groupBy("src").agg(F.ceil(F.count("*") / MOST_TRAILS).alias("parts"))
    held = trails.join(parts, "src").groupBy("src", F.pmod(F.xxhash64("user_id"), "parts").alias("part")).agg(F.flatten(F.collect_list("dst")).alias("dst"))
    asked = lists.select("example_id", "candidates", F.size("history").alias("m"), F.posexplode("history").alias("p", "src"))
    found = asked.join(held, "src").select("example_id", "p", "m", "dst", F.explode(F.array_intersect("candidates", "dst")).alias("item_id"))
    n = F.size(F.filter("dst", lambda x: x == F.col("item_id")))
    scores = found.groupBy("example_id", "item_id").agg(F.sum(n * (F.col("p") + 1) / F.col("m")).alias("score"))
    rows = lists.select("example_id", F.explode("candidates").alias("item_id"))
    return rows.join(scores, ["example_id", "item_id"], "left").fillna(0.0, ["score"])


EXAMPLES = 512  # that are taken from Arrow at once


def by_bm25(lists: DataFrame, items: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(example_id, item_id, score) of each candidate: BM25 of its title for the tokens (with repetition) of the history's titles.

    ``lists``: example_id, all different, history, candidates. History and candidates meet the catalog in one join and come back to one row per example.
    """
    # a title's tokens travel as one text and their weights as one list: a history item brings its tokens back, a candidate its different tokens and their weights
    terms = retrieval.bm25_weights(items, k1, b).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("terms"))
    terms = terms.select("item_id", F.array_join("terms.t", " ").alias("ts"), F.col("terms.w").alias("ws"))
    words = items.select("item_id", F.array_join(T.tokens(F.col("title")), " ").alias("words")).join(terms, "item_id", "left")
    as_rows = lambda name, past: F.transform(name, lambda i: F.struct(i.alias("item_id"), F.lit(past).alias("past")))
    tall = lists.select("example_id", F.explode(F.concat(as_rows("history", True), as_rows("candidates", False))).alias("x")).select("example_id", "x.*")
    asked = F.collect_list(F.when(F.col("past"), F.col("words")))
    mine = F.collect_list(F.when(~F.col("past"), F.struct("item_id", F.coalesce("ts", F.lit("")).alias("ts"), F.coalesce("ws", F.array().cast("array<double>")).alias("ws"))))
    rows = tall.join(words, "item_id", "left").groupBy("example_id").agg(asked.alias("asked"), mine.alias("mine"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, EXAMPLES):
                out = []
                for row in batch.slice(start, EXAMPLES).to_pylist():
                    often = Counter(" ".join(row["asked"]).split())
                    out += [(row["example_id"], c["item_id"], sum((often[t] * w for t, w in zip(c["ts"].split(), c["ws"], strict=True) if t in often), 0.0)) for c in row["mine"]]
                if out:
                    kinds = [pa.string(), pa.string(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["example_id", "item_id", "score"])

    return rows.mapInArrow(score, "example_id string, item_id string, score double")


def predictions(scored: DataFrame, k: int = 10) -> DataFrame:
    """One row per example: candidates, the top ``k`` items and their scores."""
    order = W.partitionBy("example_id").orderBy(F.desc("score"), "item_id")
    ranked = scored.withColumn("k", F.row_number().over(order))
    top = F.array_sort(F.collect_list(F.when(F.col("k") <= k, F.struct("k", "item_id", "score"))))
    out = ranked.groupBy("example_id", "user_id", "target").agg(F.array_sort(F.collect_list("item_id")).alias("candidates"), top.alias("t"))
    return out.select("example_id", "user_id", "target", "candidates", F.col("t.item_id").alias("predicted"), F.col("t.score").alias("scores"))


def imported(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores from elsewhere (example_id or user_id, item_id, score): by example, else by user, else 0; the last row of a key (``seq``) wins."""
    last = scores.groupBy("example_id", "user_id", "item_id").agg(F.max_by("score", "seq").alias("s"))
    mine = last.where("example_id is not null").select("example_id", "item_id", F.col("s").alias("s1"))
    users = last.where("example_id is null").select("user_id", "item_id", F.col("s").alias("s2"))
    return candidates.join(mine, ["example_id", "item_id"], "left").join(users, ["user_id", "item_id"], "left").withColumn("score", F.coalesce("s1", "s2", F.lit(0.0))).drop("s1", "s2")


BLOCK_ROWS = 6_000_000  # interactions behind the pairs of one block, which a task of the factorisation holds at once


def factorised(inter: DataFrame, rank: int = 8, seed: int = 7):
    """Implicit-feedback matrix factorisation over hashed ids (ALS).

    There are as many blocks as keep each at BLOCK_ROWS, ten at least (ids are dealt evenly), so a task's memory doesn't grow with the input. The first
    factors are drawn by block. Item factors are written after every pass, which frees what was shuffled for them.
    """
    from pyspark.ml.recommendation import ALS

    set_checkpoint_dir(inter.sparkSession)
    blocks = max(10, -(-inter.count() // BLOCK_ROWS))
    rows = inter.groupBy("user_id", "item_id").agg(F.count("*").cast("float").alias("n"))
    rows = rows.select(F.col("user_id").cast("int").alias("user"), F.col("item_id").cast("int").alias("item"), "n")
    als = ALS(rank=rank, maxIter=5, implicitPrefs=True, userCol="user", itemCol="item", ratingCol="n", seed=seed, coldStartStrategy="nan", checkpointInterval=1)
    return als.setNumBlocks(blocks).fit(rows)
