"""The two-stage calibrator on rows of known probabilities, seeded candidates and prompt contexts against plain Python."""

import hashlib
import json
import random

import numpy as np
import pytest

from larkspur.operators import calibrator, candidates, prompts


def rows(spark, n, seed, shift=-2.0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 2))
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.5 * x[:, 1] + shift)))
    y = rng.random(n) < p
    data = [(float(a), float(b), int(t), float(q)) for (a, b), t, q in zip(x, y, p, strict=True)]
    return spark.createDataFrame(data, "a double, b double, y int, p double").cache()


def test_probabilities_mean_what_they_say(spark):
    """Balanced classes move probabilities; Platt's step moves them back to the true ones."""
    train, valid, test = rows(spark, 3000, 1), rows(spark, 3000, 2), rows(spark, 3000, 3)
    head = calibrator.fit_head(train, valid, ["a", "b"], "y")
    assert head.kind == "calibrated"
    got = head.probability(test, "q")
    assert got.columns == ["a", "b", "y", "p", "q"]
    found = got.toPandas()
    assert np.abs(found.q - found.p).mean() < 0.03 and abs(found.q.mean() - found.y.mean()) < 0.02
    plain = calibrator.Head("balanced", head.prior, head.model).probability(test, "q").toPandas()
    assert plain.q.mean() > 1.5 * found.y.mean()


def test_platt_equals_newton(spark):
    """Slope and shift against plain Newton steps on softened targets."""
    rng = np.random.default_rng(4)
    f = rng.standard_normal(400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.7 * f - 1)))).astype(float)
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w, x = np.zeros(2), np.stack([f, np.ones(400)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (t - p))
    got = calibrator.platt(spark.createDataFrame([(float(a), float(b)) for a, b in zip(f, y, strict=True)], "margin double, label double"))
    assert got == pytest.approx(tuple(w), abs=1e-4)


def test_one_class(spark):
    some, none = rows(spark, 200, 5), rows(spark, 200, 6).withColumn("y", calibrator.F.lit(0))
    head = calibrator.fit_head(none, some, ["a", "b"], "y")
    assert (head.kind, head.prior) == ("constant", 0.01) and head.probability(some, "q").first()["q"] == 0.01
    assert calibrator.fit_head(some, none, ["a", "b"], "y").kind == "balanced"
    assert calibrator.fit_head(some.limit(0), some, ["a", "b"], "y").kind == "constant"


def test_replay(spark):
    rows = spark.createDataFrame([(0.9, 0.1, 0.0, 1.0), (0.9, 0.6, 1.0, 0.0), (0.2, 0.1, 0.5, 1.0), (0.8, 0.2, 0.5, 0.5)], "p_improve double, p_harm double, ndcg_before double, ndcg_after double")
    point = calibrator.chosen_thresholds(rows, [0.5, 0.95], [0.3, 0.7], 0.35, 1)
    assert [tuple(r) for r in point.collect()] == [(0.5, 0.3)]
    done = calibrator.replayed(rows, point)
    assert sorted((r.p_harm, r.overrides, r.ndcg) for r in done.collect()) == [(0.1, False, 0.5), (0.1, True, 1.0), (0.2, True, 0.5), (0.6, False, 1.0)]
    assert tuple(calibrator.replay_summary(done).first()) == (4, 2, 0.75, 0.5, 1, 0)
    never = calibrator.chosen_thresholds(rows, [0.5], [0.3], 0.35, 99)
    assert never.count() == 0 and [r.overrides for r in calibrator.replayed(rows, never).collect()] == [False] * 4


def test_seeded_candidates_equal_plain_python(spark):
    rng = random.Random(3)
    items = [f"i{n}" for n in range(120)]
    examples = [(f"e{n}", rng.choice(items), rng.sample(items, rng.randint(0, 50))) for n in range(40)] + [("odd", "outside", None)]
    df = spark.createDataFrame(examples, "example_id string, target string, history array<string>")
    catalog = spark.createDataFrame([(i,) for i in [*items, *items[:5], None]], "item_id string")
    for size, keep in ((10, False), (None, False), (1, True), (500, True)):
        want = {}
        for e, target, history in examples:
            pool = sorted({i for i in items if keep or i not in set(history or ()) or i == target} | {target})
            others = [i for i in pool if i != target]
            random.Random(int(hashlib.sha256(f"7:{e}".encode()).hexdigest()[:16], 16)).shuffle(others)
            want[e] = pool if size is None else sorted({target, *others[: size - 1]})
        for parts in (1, 7):
            got = candidates.attached(df.repartition(parts), catalog, size, 7, keep)
            assert {r.example_id: r.candidates for r in got.collect()} == want
    with pytest.raises(ValueError, match="one candidate"):
        candidates.attached(df, catalog, 0)


def test_catalogs_beyond_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(candidates, "MOST_ITEMS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        candidates.attached(spark.createDataFrame([], "example_id string, target string, history array<string>"), spark.range(4).selectExpr("string(id) AS item_id"), 2)


def test_prompt_context(spark):
    items = spark.createDataFrame([("a", 'A "x"', "c1", "b1"), ("b", "B", None, None), ("t", "T", "c", "b"), ("b", "B", None, None)], "item_id string, title string, category string, brand string")
    examples = spark.createDataFrame(
        [("e1", ["b", "t", "a", "zz", "b"], "t", ["t", "b", "qq", "a"]), ("e2", [], None, None), ("e3", None, "", ["a"]), ("e4", ["zz"], "t", ["t"])],
        "example_id string, history array<string>, target string, candidates array<string>",
    )
    got = {r.example_id: r for r in prompts.prompt_context(examples, items).collect()}
    one = got["e1"]
    assert one.history_item_ids == ["b", "a", "b"] and json.loads(one.history_titles) == ["B", 'A "x"', "B"]
    assert one.prompt_candidate_item_ids == ["b", "a"] and json.loads(one.candidate_titles) == ["B", 'A "x"']
    assert (one.history_excluded_item_ids, one.excluded_item_ids, one.target_excluded_from_prompt) == (["t"], ["t"], True)
    for name in ("e2", "e4"):
        assert (got[name].history_item_ids, got[name].history_titles, got[name].prompt_candidate_item_ids) == ([], "[]", [])
    assert got["e3"].prompt_candidate_item_ids == ["a"] and got["e3"].excluded_item_ids == [] and not got["e3"].target_excluded_from_prompt
    labelled = prompts.prompt_context(examples, items, "title_category", prompts.F.array(prompts.F.lit("b"), prompts.F.lit("a")))
    row = {r.example_id: r for r in labelled.collect()}["e1"]
    assert row.history_item_ids == ["t"] and json.loads(row.history_titles) == ["T | c"] and row.history_excluded_item_ids == ["b", "a", "b"] and not row.target_excluded_from_prompt
