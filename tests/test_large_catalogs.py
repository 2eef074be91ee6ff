"""Candidates from catalogs that no task can hold."""

import hashlib
import random

import pytest

from larkspur.operators import candidates, enrich


def test_token_candidates_against_plain_rules(spark, monkeypatch):
    monkeypatch.setattr(enrich, "MEMBER_BLOCK", 20, raising=False)
    monkeypatch.setattr(enrich, "EXAMPLE_BLOCK", 4, raising=False)
    rng = random.Random(4)
    words = ["red", "blue", "steel", "brass", "ox", "Box", "case"]
    items = [(f"i{n:02d}", " ".join(rng.sample(words, rng.randint(1, 2))), rng.randint(0, 3)) for n in range(60)] + [("j", None, 1), ("k", "a b", 9)]
    ids = [i for i, _, _ in items]
    examples = [(f"e{n}", rng.choice(ids), rng.choices([*ids, "gone"], k=rng.randint(0, 40))) for n in range(12)]
    tokens = {i: {w for w in (t or "").lower().split() if len(w) >= 3} for i, t, _ in items}
    want = set()
    for e, target, history in examples:
        weight = {}
        for p, i in enumerate(history, 1):
            for w in tokens.get(i, ()):
                weight[w] = weight.get(w, 0) + p / len(history)
        rows = [(-round(sum(weight.get(w, 0) for w in tokens[i]), 9), -p, t, i) for i, t, p in items if i != target and i not in history and any(w in weight for w in tokens[i])]
        want |= {(e, i, -s, place) for place, (s, _, _, i) in enumerate(sorted(rows)[:7], 1)}
    a = spark.createDataFrame(examples, "example_id string, target string, history array<string>")
    b = spark.createDataFrame(items, "item_id string, title string, popularity long")
    df = enrich.token_candidates(a, b, 7)
    assert {(r.example_id, r.item_id, round(r.score, 9), r.place) for r in df.collect()} == want
    assert "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString()  # no join on tokens, whose rows are pairs of example and item


def test_token_candidates_lay_out_no_catalog_for_each_task_at_the_driver(spark):
    items = [(f"i{n:03d}", f"word{n % 50} other{n % 7} long title", n % 5) for n in range(300)]
    a = spark.createDataFrame([(f"e{n}", "i001", ["i002", f"i{n:03d}"]) for n in range(50)], "example_id string, target string, history array<string>")
    df = enrich.token_candidates(a, spark.createDataFrame(items, "item_id string, title string, popularity long"), 7)
    plan = df._jdf.queryExecution()
    assert df.count() == 50 * 7 and "Join" not in plan.optimizedPlan().toString() and "Broadcast" not in plan.executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 2, 18, 19, 20, 511, 512, 513, 1023, 1025, 5000, 40000])
def test_first_places_of_a_shuffle(n):
    for seed in (0, 7, 2**33 + n, 2**63 + 5):
        whole = list(range(n))
        random.Random(seed).shuffle(whole)
        assert candidates.shuffled_first(seed, n, 19) == whole[:19]


def test_seeded_beyond_what_attached_takes(spark, monkeypatch):
    monkeypatch.setattr(candidates, "MOST_ITEMS", 3)
    rng = random.Random(3)
    items = [f"i{n}" for n in range(700)]
    examples = [(f"e{n}", rng.choice(items), rng.choices(items, k=rng.randint(0, 50))) for n in range(20)] + [("odd", "outside", None), ("all", "i1", items)]
    df = spark.createDataFrame(examples, "example_id string, target string, history array<string>")
    catalog = spark.createDataFrame([(i,) for i in [*items, *items[:5], None]], "item_id string")
    want = {}
    for e, target, history in examples:
        others = [i for i in sorted(items) if i not in (history or ()) and i != target]
        random.Random(int(hashlib.sha256(f"13:{e}".encode()).hexdigest()[:16], 16)).shuffle(others)
        want[e] = sorted({target, *others[:9]})
    assert {r.example_id: r.candidates for r in candidates.seeded(df, catalog, 10).collect()} == want
