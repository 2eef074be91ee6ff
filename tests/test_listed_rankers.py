"""Rankers on lists of candidates, and retrieval from titles that items share, against plain rules."""

import math
import random
import re
from collections import Counter

from larkspur.operators import rankers, retrieval, splits

LISTS = "example_id string, history array<string>, candidates array<string>"


def lists(rng, ids, n=12):
    return [(f"e{j}", rng.choices(ids, k=rng.randint(0, 9)), sorted(rng.sample(ids, 6))) for j in range(n)] + [("gone", ["none", ids[0]], ["new", ids[1]])]


def bm25(items):
    words = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in items}
    df, mean = Counter(w for x in words.values() for w in set(x)), sum(map(len, words.values())) / len(words)
    weight = lambda i, w, tf: math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words[i]) / mean))
    return lambda history, i: sum(Counter(w for h in history for w in words.get(h, ()))[w] * weight(i, w, tf) for w, tf in Counter(words.get(i, ())).items())


def titled(n=40):
    rng = random.Random(8)
    words = ["red", "blue", "ring", "bolt", "x1", "x2"]
    return [(f"i{j:02d}", " ".join(rng.choices(words, k=rng.randint(0, 3)))) for j in range(n)]


def test_cooccurrence_of_lists(spark, monkeypatch):
    monkeypatch.setattr(rankers, "MOST_TRAILS", 3, raising=False)
    rng = random.Random(2)
    ids = [f"i{n}" for n in range(8)]
    rows = [(f"u{u}", rng.choice([*ids, None]), float(t), t, 1) for u in range(15) for t in range(rng.randint(1, 12))]
    timeline = splits.timeline(spark.createDataFrame(rows, "user_id string, item_id string, ts double, l_orderkey long, l_linenumber int"))
    pairs = Counter()
    for u in {r[0] for r in rows}:
        s = [r[1] for r in rows if r[0] == u]
        pairs.update((a, s[j]) for j in range(1, len(s) - 2) for a in s[:j] if a is not None and s[j] is not None)
    asked = lists(rng, ids)
    want = {(e, c, round(sum(pairs[h, c] * p / len(past) for p, h in enumerate(past, 1)), 9)) for e, past, found in asked for c in found}
    df = rankers.by_cooccurrence(spark.createDataFrame(asked, LISTS), timeline)
    assert {(r.example_id, r.item_id, round(r.score, 9)) for r in df.collect()} == want


def test_bm25_of_lists(spark):
    items = titled()
    score, asked = bm25(items), lists(random.Random(6), [i for i, _ in items])
    df = rankers.by_bm25(spark.createDataFrame(asked, LISTS), spark.createDataFrame(items, "item_id string, title string"))
    got = [(r.example_id, r.item_id, round(r.score, 9)) for r in df.collect()]
    assert set(got) == {(e, c, round(score(past, c), 9)) for e, past, found in asked for c in found} and len(got) == sum(len(c) for _, _, c in asked)


def test_retrieval_of_shared_titles(spark, monkeypatch):
    items, indexed, real = titled(), [], retrieval.index
    monkeypatch.setattr(retrieval, "index", lambda weights: indexed.append(weights.select("item_id").distinct().count()) or real(weights))
    score, asked = bm25(items), lists(random.Random(6), [i for i, _ in items])
    want = set()
    for e, past, _ in asked:
        ranked = sorted((-round(score(past, i), 9), i) for i, _ in items)[:9]
        want |= {(e, i, -s, place) for place, (s, i) in enumerate(ranked, 1)}
    df = retrieval.by_bm25(spark.createDataFrame(asked, LISTS), spark.createDataFrame(items, "item_id string, title string"), 9)
    assert {(r.example_id, r.item_id, round(r.score, 9), r.place) for r in df.collect()} == want
    assert indexed == [len({tuple(sorted(t.split())) for _, t in items if t})] and indexed[0] < 30


def test_bm25_moves_titles_as_one_text(spark):
    items = spark.createDataFrame([("a", "Red ring, red"), ("b", "ring"), ("c", ""), ("d", None), ("e", "blue steel ring 7")], "item_id string, title string")
    lists = spark.createDataFrame([("x", ["a", "b", "gone"], ["a", "c", "e"]), ("y", [], ["b", "new"]), ("z", ["e", "e"], ["d", "e"])], "example_id string, history array<string>, candidates array<string>")
    df = rankers.by_bm25(lists, items)
    weight = {(r.item_id, r.t): r.w for r in retrieval.bm25_weights(items).collect()}
    w = lambda item, **often: round(sum(n * weight.get((item, t), 0.0) for t, n in often.items()), 9)
    x, z = {"red": 2, "ring": 2}, {"blue": 2, "steel": 2, "ring": 2, "7": 2}
    want = {("x", "a"): w("a", **x), ("x", "c"): 0.0, ("x", "e"): w("e", **x), ("y", "b"): 0.0, ("y", "new"): 0.0, ("z", "d"): 0.0, ("z", "e"): w("e", **z)}
    assert {(r.example_id, r.item_id): round(r.score, 9) for r in df.collect()} == want and want["x", "a"] > want["x", "e"] > 0
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" in plan and "flatten(" not in plan  # no list of a title's tokens for each history item


def test_item_blocks_are_not_joined_to_their_meetings(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", 3)
    monkeypatch.setattr(retrieval, "EXAMPLE_BLOCK", 2)
    plans, real = [], retrieval.checkpointed
    monkeypatch.setattr(retrieval, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    items = [(f"i{n:02d}", f"w{n % 4} v{n % 5} u{n % 3}") for n in range(30)]
    rows = [(f"e{n}", [f"i{n:02d}", f"i{2 * n:02d}"]) for n in range(9)]
    got = retrieval.by_bm25(spark.createDataFrame(rows, "example_id string, history array<string>"), spark.createDataFrame(items, "item_id string, title string"), 5).collect()
    frame = spark.createDataFrame(items, "item_id string, title string")
    weight, title = {}, dict(items)
    for r in retrieval.bm25_weights(frame).collect():
        weight[r.item_id, r.t] = r.w
    want = set()
    for e, history in rows:
        asked = Counter(t for i in history for t in title[i].split())
        scores = sorted((-round(sum(n * weight.get((i, t), 0.0) for t, n in asked.items()), 9), i) for i, _ in items)[:5]
        want |= {(e, i, -s + 0.0, place) for place, (s, i) in enumerate(scores, 1)}
    assert {(r.example_id, r.item_id, round(r.score, 9), r.place) for r in got} == want
    met = next(plan for plan in plans if "MapInArrow" in plan)
    assert "Union" in met and "items" in met  # blocks of items and their meetings come by one shuffle
