"""Factorisation in rotating blocks against one sequential pass."""

import numpy as np

from larkspur.operators import factorise


def sequential(pairs, n_users, n_items, epochs):
    rng = np.random.default_rng(1)
    users, items = (np.hstack([rng.uniform(-0.01, 0.01, (n, 8)), np.zeros((n, 1))]) for n in (n_users, n_items))
    for _ in range(epochs):
        factorise.steps(users, items, pairs, factorise.STEP, factorise.RIDGE)
    return users, items


def test_error_is_near_a_sequential_pass(spark):
    """Held-out error within 10 % of plain steps over all pairs in order."""
    rng = np.random.default_rng(6)
    pairs = np.unique(np.stack([rng.integers(0, 60, 1500), rng.integers(0, 40, 1500)], 1), axis=0)
    pairs = rng.permutation(pairs)
    train, held = pairs[:900], pairs[900:]
    users, items = sequential(train, 60, 40, 4)
    plain = [(1 - (users[u][:-1] @ items[i][:-1] + users[u][-1] + items[i][-1])) ** 2 for u, i in held]
    rows = [(f"u{u}", f"i{i}") for u, i in train.tolist()]
    catalog = spark.createDataFrame([(f"i{i}",) for i in range(40)] + [("never",)], "item_id string")
    model = factorise.fit(spark.createDataFrame([*rows, *rows[:50], (None, "i1"), ("u1", None)], "user_id string, item_id string"), catalog, epochs=4, parts=3)
    asked = spark.createDataFrame([(f"u{u}", f"i{i}") for u, i in held.tolist()], "user_id string, item_id string")
    ours = [(1 - r.score) ** 2 for r in model.score(asked).collect()]
    assert len(ours) == len(held) and abs(np.mean(ours) / np.mean(plain) - 1) < 0.1
    bias = {r["id"]: r["bias"] for r in model.items.collect()}
    assert len(bias) == 41 and bias["never"] == 0
    odd = model.score(spark.createDataFrame([("new", "i3"), ("u1", "nowhere"), ("new", "nowhere")], "user_id string, item_id string"))
    assert {(r.user_id, r.item_id): r.score for r in odd.collect()} == {("new", "i3"): bias["i3"], ("u1", "nowhere"): 0.0, ("new", "nowhere"): 0.0}


def test_every_pair_is_used_once_an_epoch(spark):
    """With a step of 1 on biases alone and no factors to speak of, one epoch moves each bias by its pairs only."""
    pairs = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "user_id string, item_id string")
    model = factorise.fit(pairs, spark.createDataFrame([("x",)], "item_id string"), epochs=1, step=0.5, ridge=0.0, parts=2)
    for r in [*model.users.collect(), *model.items.collect()]:
        assert abs(r["bias"] - 0.5) < 1e-3


def test_without_pairs(spark):
    none = spark.createDataFrame([], "user_id string, item_id string")
    model = factorise.fit(none, spark.createDataFrame([("x",)], "item_id string"), epochs=1, parts=2)
    assert model.users.count() == 0 and [r["bias"] for r in model.items.collect()] == [0.0]


def test_blocks_of_the_implicit_fit_follow_the_rows(spark, monkeypatch):
    from larkspur.operators import rankers

    inter = spark.createDataFrame([(str(n % 37), str(n * 7 % 41)) for n in range(600)], "user_id string, item_id string")
    monkeypatch.setattr(rankers, "BLOCK_ROWS", 30, raising=False)
    model = rankers.factorised(inter)
    assert model.userFactors.rdd.getNumPartitions() == model.itemFactors.rdd.getNumPartitions() == 20
    assert {r.id for r in model.userFactors.collect()} == set(range(37)) and {r.id for r in model.itemFactors.collect()} == set(range(41))
    monkeypatch.setattr(rankers, "BLOCK_ROWS", 10**6, raising=False)
    assert rankers.factorised(inter).userFactors.rdd.getNumPartitions() == 10
