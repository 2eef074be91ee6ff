"""Ranking, calibration and selective-risk metrics against values worked out by hand."""

import math

import pytest

from larkspur.operators import calibration, metrics

SCHEMA = "example_id string, user_id string, target string, candidates array<string>, predicted array<string>"


def predictions(spark, *rows):
    return spark.createDataFrame([(str(k), f"u{k}", t, c, p) for k, (t, c, p) in enumerate(rows)], SCHEMA)


def one(df):
    return df.collect()[0]


def test_ranking_hits_misses_and_duplicates(spark):
    assert one(metrics.ranking(predictions(spark, ("i1", ["i1", "i2"], ["i1", "i2"])), [1]))[1:] == (1, 1.0, 1.0, 1.0)
    missed = one(metrics.ranking(predictions(spark, ("i1", ["i1"], ["i2", "i3"]), ("i1", ["i1"], [])), [5]))
    assert (missed.recall, missed.mrr, missed.ndcg) == (0.0, 0.0, 0.0)
    repeated = one(metrics.ranking(predictions(spark, ("i2", ["i1", "i2"], ["i1", "i1", "i2"])), [2]))
    assert (repeated.recall, repeated.mrr) == (1.0, 0.5)


def test_validity_of_empty_lists(spark):
    r = one(metrics.validity(predictions(spark, ("i1", ["i1"], []), ("i1", ["i1"], ["i1"]), ("i1", ["i1"], ["i9"]))))
    assert (round(r.valid, 6), round(r.hallucinated, 6)) == (0.333333, 0.333333)


def test_diversity_and_novelty(spark):
    items = spark.createDataFrame([("i1", "a"), ("i2", "a"), ("i3", "b")], "item_id string, category string")
    r = one(metrics.diversity(predictions(spark, ("i1", [], ["i1", "i2", "i3"])), items, 3))
    assert r.ild == pytest.approx(2 / 3) and r.categories == 2.0
    ranks = spark.createDataFrame([("i1", 2, 1, 3), ("i2", 0, 2, 3), ("i3", 0, 3, 3)], "item_id string, popularity long, pop_rank long, n_items long")
    r = one(metrics.novelty(predictions(spark, ("i1", [], ["i1", "i3"])), ranks, 2))
    assert r.self_information == pytest.approx((-math.log2(3 / 5) - math.log2(1 / 5)) / 2)


def test_seed_aggregate(spark):
    r = one(metrics.over_seeds(spark.createDataFrame([("m", 0.5), ("m", 1.0)], "m string, value double"), ["m"]))
    assert (r["mean"], r.seeds) == (0.75, 2)
    assert one(metrics.over_seeds(spark.createDataFrame([("m", 0.5)], "m string, value double"), ["m"]))["std"] == 0.0


def confidences(spark, cs, ys):
    return spark.createDataFrame([(c, y, str(k)) for k, (c, y) in enumerate(zip(cs, ys, strict=True))], "confidence double, correct int, seq string")


def test_calibration_errors(spark):
    right = one(calibration.calibration_error(confidences(spark, [0.9, 0.8, 0.2, 0.1], [1, 1, 0, 0]), 2, calibration.bin_right))
    assert right.ece == pytest.approx(0.15)
    left = one(calibration.calibration_error(confidences(spark, [0.9, 0.1], [1, 0]), 2))
    assert left.ece == pytest.approx(0.1) and left.brier == pytest.approx(0.01)
    edges = {r.bin: r.n for r in calibration.all_bins(calibration.reliability(confidences(spark, [0.0, 1.0], [0, 1]), 5), 5).collect()}
    assert edges == {0: 1, 1: 0, 2: 0, 3: 0, 4: 1}


def test_selective_risk(spark):
    r = one(calibration.area_under_risk(confidences(spark, [0.9, 0.8, 0.2, 0.1], [1, 0, 1, 0])))
    assert r.aurc == pytest.approx((0 + 0.5 + 1 / 3 + 0.5) / 4) and r.excess == pytest.approx(0.125)


def test_rates_are_null_without_rows(spark):
    r = one(calibration.threshold_rates(confidences(spark, [0.9, 0.4, 0.8, 0.2], [1, 1, 0, 0]), 0.5, 0.7))
    assert (r.cbu, r.wbc) == (0.5, 0.5)
    assert one(calibration.threshold_rates(confidences(spark, [0.9], [1]), 0.5, 0.7)).wbc is None


def test_nearest_ranks_of_large_groups(spark):
    import random

    rng = random.Random(6)
    rows = [("a", float(rng.randrange(50))) for _ in range(3000)] + [("b", rng.random()) for _ in range(3000)] + [("c", 1.0), ("c", 2.0), ("d", 7.0), ("d", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = metrics.nearest_ranks(df, "g", "v", {"p50": 0.5, "p95": 0.95}, parts=7)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for g in "abcd":
        v = sorted(x for k, x in rows if k == g and x is not None)
        want[g] = tuple(v[round((len(v) - 1) * q)] for q in (0.5, 0.95))
    assert {r.g: (r.p50, r.p95) for r in found.collect()} == want
