"""Leave-one-out, rolling and chronological splits on a log small enough to check by hand."""

from larkspur.operators import filters, popularity, splits

LOG = [
    ("u1", "i2", 90.0), ("u1", "i1", 100.0), ("u1", "i3", 110.0), ("u1", "i4", 120.0),
    ("u2", "i1", 1.0), ("u2", "i2", 2.0), ("u2", "i3", 3.0), ("u2", "i4", 4.0),
    ("u4", "i1", 1.0), ("u4", "i5", 2.0), ("u5", "i1", 7.0),
]


def log(spark):
    rows = [(u, i, t, 1.0, k, 0) for k, (u, i, t) in enumerate(LOG)]
    return spark.createDataFrame(rows, "user_id string, item_id string, ts double, rating double, l_orderkey long, l_linenumber int")


def test_leave_one_out(spark):
    rows = {r.example_id: (r.split, r.history, r.target) for r in splits.leave_one_out(log(spark)).collect()}
    assert rows == {
        "u1:1": ("train", ["i2"], "i1"), "u1:2": ("valid", ["i2", "i1"], "i3"), "u1:3": ("test", ["i2", "i1", "i3"], "i4"),
        "u2:1": ("train", ["i1"], "i2"), "u2:2": ("valid", ["i1", "i2"], "i3"), "u2:3": ("test", ["i1", "i2", "i3"], "i4"), "u4:1": ("test", ["i1"], "i5"),
    }


def test_train_popularity_counts_histories_and_targets(spark):
    counts = {r.item_id: r.popularity for r in popularity.train_counts(splits.leave_one_out(log(spark))).collect()}
    assert counts == {"i1": 2, "i2": 2}


def test_min_count_and_k_core(spark):
    assert {r.user_id for r in filters.users_with(log(spark), 4).collect()} == {"u1", "u2"}
    core = filters.k_core(log(spark), 4, 2).collect()
    assert {r.user_id for r in core} == {"u1", "u2"} and {r.item_id for r in core} == {"i1", "i2", "i3", "i4"}
    assert filters.k_core(log(spark), 5, 2).count() == 0


def test_chronological_covers_all(spark):
    rows = splits.chronological(splits.rolling(log(spark), 1, 2), 0.5, 0.25).collect()
    counts = {s: sum(r.split == s for r in rows) for s in ("train", "valid", "test")}
    assert counts == {"train": 3, "valid": 2, "test": 2}
    assert max(r.ts for r in rows if r.split == "train") <= min(r.ts for r in rows if r.split == "test")


def test_buckets(spark):
    counts = spark.createDataFrame([("i1", 9), ("i2", 7), ("i3", 5), ("i4", 2), ("i5", 1)], "item_id string, popularity long")
    got = {r.item_id: r.bucket for r in popularity.buckets_by_fraction(popularity.ranked(counts)).collect()}
    assert got == {"i1": "head", "i2": "mid", "i3": "mid", "i4": "tail", "i5": "tail"}
    tied = spark.createDataFrame([("i2", 2), ("i1", 2), ("i3", 1)], "item_id string, popularity long")
    assert {r.item_id: r.pop_rank for r in popularity.ranked(tied).collect()} == {"i1": 1, "i2": 2, "i3": 3}
