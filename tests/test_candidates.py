import hashlib
import random
import re

from larkspur.operators import candidates, evidence, splits


def test_drawn_against_plain_python(spark):
    items = [f"i{k}" for k in range(9)]
    rows = [("a:1", "i1", ["i0", "i2"]), ("b:1", "i8", items[:8]), ("c:1", "new", []), ("d:1", "i3", ["i3", "i3"])]
    examples = spark.createDataFrame(rows, "example_id string, target string, history array<string>")
    indexed = spark.createDataFrame([(k + 1, i) for k, i in enumerate(items)], "item_index int, item_id string")
    want = set()
    for example_id, target, history in rows:
        places = [int(hashlib.sha256(f"13:{example_id}:{j}".encode()).hexdigest()[:8], 16) % 9 for j in range(5)]
        want |= {(example_id, items[p]) for p in places if items[p] not in history} | {(example_id, target)}
    df = candidates.drawn(examples, indexed, 5).select("example_id", "item_id")
    got = [tuple(r) for r in df.collect()]
    assert set(got) == want and len(got) == len(want)
    assert {(r[0], r[1]) for r in candidates.drawn(examples, indexed.where("false"), 5).select("example_id", "item_id").collect()} == {(e, t) for e, t, _ in rows}


def test_draws_travel_without_the_history(spark):
    examples = spark.createDataFrame([("a:1", "i1", ["i0"])], "example_id string, target string, history array<string>")
    indexed = spark.createDataFrame([(1, "i0"), (2, "i1")], "item_index int, item_id string")
    plan = candidates.drawn(examples, indexed, 5).select("example_id", "item_id")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(k for k, line in enumerate(plan) if re.search(r"Join Inner, .*item_index", line))
    below = [line for line in plan[at + 1 :] if re.search(r"Project|Generate", line)]
    assert below and not any("history" in line for line in below)


def test_held_out_is_the_test_part_of_leave_one_out(spark):
    rows = [("u", "a", 3.0, 1, 1), ("u", "b", None, 2, 1), ("u", None, 1.0, 3, 1), ("u", "a", 3.0, 4, 1), ("v", "x", 1.0, 5, 1), ("w", "x", 1.0, 6, 1), ("w", "y", 1.0, 6, 2), (None, "p", 1.0, 7, 1), (None, "q", 2.0, 8, 1)]
    inter = spark.createDataFrame(rows, "user_id string, item_id string, ts double, l_orderkey long, l_linenumber int")
    for least in (1, 2):
        whole = splits.leave_one_out(inter, least).where("split = 'test'")
        got = splits.held_out(inter, least).select(whole.columns)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_repetition_makes_no_row_for_a_pair(spark):
    items = spark.createDataFrame([("a", "red door x1", "C", "b"), ("b", "red lamp", "c", "B"), ("c", "blue sea", "d", "z")], "item_id string, title string, category string, brand string")
    rows = spark.createDataFrame([("e", "a"), ("e", "b"), ("e", "new"), ("f", "a"), ("g", "c")], "example_id string, item_id string")
    histories = spark.createDataFrame([("e", ["b", "gone"]), ("f", []), ("g", ["b"] * 60 + ["a"])], "example_id string, history array<string>")
    df = evidence.repetition(rows, items, histories)
    got = {(r.example_id, r.item_id): round(r.history_risk, 9) for r in df.collect()}
    assert got == {("e", "a"): 0.42, ("e", "b"): 1.0, ("e", "new"): 0.0, ("f", "a"): 0.0, ("g", "c"): 0.0}
    exploded = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate explode" in line]
    assert len(exploded) == 1 and "history" in exploded[0]


def test_repetition_tells_pairs_in_arrays(spark):
    rng = random.Random(8)
    words = [f"word{n}" for n in range(9)]
    items = [(f"i{n}", rng.choice(["A", "b", None]), rng.choice(["x", "Y", None]), rng.choice([" ".join(rng.sample(words, rng.randint(0, 9))), None])) for n in range(40)]
    fields = {i: (c and c.lower(), b and b.lower(), set(w for w in (t or "").split() if len(w) > 2)) for i, c, b, t in items} | {"gone": (None, None, set())}
    histories = [(f"e{n}", rng.choices([*fields], k=rng.choice([0, 1, 7, 70]))) for n in range(30)] + [("none", None)]
    rows = [(e, rng.choice([*fields]), n) for e, _ in [*histories, ("unknown", None)] for n in range(rng.randint(1, 6))]
    want, past = [], dict(histories)
    for e, i, n in rows:
        c, b, t = fields[i]
        last = [fields[x] for x in (past.get(e) or [])[-50:]]
        parts = [(0.55 if c and c == x[0] else 0.0) + (0.25 if b and b == x[1] else 0.0) + min(0.2, 0.04 * len(t & x[2])) for x in last]
        want.append((e, i, n, 1.0 if i in (past.get(e) or []) else round(min(1.0, sum(parts) / max(len(parts), 1)), 11)))
    df = evidence.repetition(
        spark.createDataFrame(rows, "example_id string, item_id string, n int"), spark.createDataFrame(items, "item_id string, category string, brand string, title string"),
        spark.createDataFrame(histories, "example_id string, history array<string>"),
    )
    assert sorted((r.example_id, r.item_id, r.n, round(r.history_risk, 11)) for r in df.collect()) == sorted(want)
    assert "array_intersect" not in df._jdf.queryExecution().optimizedPlan().toString()  # a set made anew for each pair
