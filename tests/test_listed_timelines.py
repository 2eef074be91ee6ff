"""Candidates with known facts and predictions from one row per user and example, against the row forms."""

from pyspark.sql import functions as F

from larkspur.operators import candidates, fusion_grid, popularity, rankers, splits
from larkspur.sources import atomic

ROWS = [("u", "a", 3.0, 1, 1), ("u", "b", None, 2, 1), ("u", None, 1.0, 3, 1), ("u", "a", 3.0, 4, 1), ("u", "c", 4.0, 5, 1), ("u", "b", 5.0, 6, 1), ("v", "x", 1.0, 7, 1),
        ("w", "x", 1.0, 8, 1), ("w", "y", 1.0, 8, 2), (None, "p", 1.0, 9, 1), (None, "q", 2.0, 10, 1)]


def made_once(df, text):
    return df._jdf.queryExecution().optimizedPlan().toString().count(text)


def same(a, b):
    return sorted(map(tuple, a.select(b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_lists_tell_what_timelines_tell(spark):
    inter = spark.createDataFrame(ROWS, "user_id string, item_id string, ts double, l_orderkey long, l_linenumber int")
    lists, seq = splits.listed(inter), splits.timeline(inter)
    for least in (1, 2):
        assert same(splits.held_out_of(lists, least), splits.held_out(inter, least))
    assert same(popularity.train_counts_of(splits.unlisted(lists)), popularity.train_counts_of(seq))
    assert same(rankers.transitions_of(lists), rankers.transitions(seq))


def test_known_candidates_are_the_drawn_ones(spark):
    items = [f"i{k}" for k in range(9)]
    rows = [("a:1", "a", "i1", ["i0", "i2"]), ("b:1", "b", "i8", items[:8]), ("c:1", "c", "new", []), ("d:1", "d", None, ["i3", "i3"])]
    examples = spark.createDataFrame(rows, "example_id string, user_id string, target string, history array<string>")
    indexed = spark.createDataFrame([(k + 1, i) for k, i in enumerate(items)], "item_index int, item_id string")
    counts = spark.createDataFrame([(i, k % 3) for k, i in enumerate(items)], "item_id string, popularity long")
    moves = spark.createDataFrame([("i2", "i1", 7), ("i3", "i5", 2), ("i7", "i8", 1)], "src string, dst string, n long")
    lists, drawn = candidates.drawn_known(examples, indexed, counts, 5, moves), candidates.drawn(examples.where("example_id != 'c:1'"), indexed, 5)
    both = rankers.list_predictions(lists, ["popularity", "markov"], 3).where("example_id != 'c:1'")
    assert same(both.where("method = 'popularity'").drop("method", "history"), rankers.predictions(rankers.by_popularity(drawn, counts), 3))
    assert same(both.where("method = 'markov'").drop("method", "history"), rankers.predictions(rankers.by_markov(drawn, moves, counts), 3))


def test_panels_read_their_rows_once(spark):
    rows = [("e", "train", "a", "a", 1, True, True, 4.0, 0.1, 0.5, 3), ("e", "train", "b", "a", 2, True, True, 2.0, 0.3, None, 0), ("e", "train", "c", "a", 3, False, True, 9.0, 0.3, 0.1, 0), ("f", "test", "a", "a", 5, True, False, 1.0, 0.1, 0.5, 3)]
    df = spark.createDataFrame(rows, "example_id string, pack string, item_id string, target string, place int, in_panel boolean, parsed boolean, fallback_score double, preference double, confidence double, popularity long")
    out = fusion_grid.panels(df.where("pack != 'never'"))
    assert made_once(out, "never") == 1
    got = {r.example_id: r for r in out.collect()}
    assert {(p.item_id, p.fb, p.pr, p.conf, p.pp, p.raw) for p in got["e"].panel} == {("a", 1.0, 0.0, 0.5, 1.0, 0.1), ("b", 0.0, 1.0, 0.0, 0.0, 0.3)}
    assert got["e"].slots == [1, 2] and got["e"].own_place == 1 and (got["f"].panel, got["f"].slots, got["f"].own_place) == (None, None, 5)


def test_sequence_rows_move_no_history(spark):
    inter = spark.createDataFrame([(f"u{n % 5}", f"i{n % 7}", float(n // 3), n, 1) for n in range(60)], "user_id string, item_id string, ts double, l_orderkey long, l_linenumber int")
    examples, line = splits.leave_one_out(inter), splits.timeline(inter)
    # one user starts late, one has another item at a place, one has no timeline
    line = line.where("user_id != 'u4' and (user_id != 'u2' or idx >= 3)").withColumn("item_id", F.when(F.expr("user_id = 'u3' and idx = 5"), "other").otherwise(F.col("item_id")))
    known = {(r.user_id, r.idx, r.item_id): r.ts for r in line.collect()}
    want = sorted((r.split, r.user_id, r.target, r.history[-4:], known.get((r.user_id, r.idx, r.target), float(len(r.history[-4:])))) for r in examples.collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = atomic.sequence_rows(examples, line, 4)
        assert sorted(tuple(r) for r in df.collect()) == want and len(want) == 55
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert not any("Exchange" in row and ", at#" in row for row in plan.splitlines())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
