"""Groundings of titles that many rows share: each different text is compared once."""

import random

from larkspur.operators import grounding, similarity

TITLES, ITEMS = "title_id string, title string", "item_id string, title string"


def counted(monkeypatch, module, name):
    """The rows of both tables that a function of a module is asked with."""
    seen, real = [], getattr(module, name)

    def spy(titles, items, *more, **named):
        seen.append((titles.count(), items.count()))
        return real(titles, items, *more, **named)

    monkeypatch.setattr(module, name, spy)
    return seen


def catalog():
    """60 items of 6 titles, ids in no order."""
    rng = random.Random(3)
    names = ["red ring large", "red rings large", "blue ring small", "cold bolt promo", "cold bolts promo", "old plate"]
    ids = [f"i{n:02d}" for n in range(60)]
    rng.shuffle(ids)
    return [(i, names[n % 6]) for n, i in enumerate(ids)]


def test_overlaps_of_different_titles_alone(spark, monkeypatch):
    items, seen = catalog(), counted(monkeypatch, grounding, "token_overlaps")
    titles = [(f"t{n}", "red ring" if n % 2 else "cold bolt Promo!") for n in range(20)]
    got = {r.title_id: (r.item_id, r.status) for r in grounding.ground(spark.createDataFrame(titles, TITLES), spark.createDataFrame(items, ITEMS)).collect()}
    first = lambda name: min(i for i, x in items if x == name)
    assert got == {i: (first("red ring large"), "token_overlap") if x == "red ring" else (first("cold bolt promo"), "normalized") for i, x in titles}
    assert seen == [(1, 6)]


def test_blocked_meets_each_text_once(spark, monkeypatch):
    items, seen = catalog() + [("j1", ""), ("j2", "!"), ("j3", None), ("j4", "re")], counted(monkeypatch, similarity, "meetings")
    monkeypatch.setattr(similarity, "ITEM_BLOCK", 2)
    titles = [(f"t{n}", x) for n, x in enumerate(["red ring", "RED ring", "cold bolts promo", "", "re", None, "zzz"] * 3)]
    flat = lambda x: x.lower().replace("!", "").strip()
    want = set()
    for i, t in titles:
        rows = []
        for item, x in items:
            if t is not None and x is not None:
                a, b = similarity.grams(flat(t)), similarity.grams(flat(x))
                weight = sum(a[g] for g in a.keys() & b.keys())
                if weight:
                    rows.append((-weight, abs(len(flat(t)) - len(flat(x))), item))
        want |= {(i, item, -w, place) for place, (w, _, item) in enumerate(sorted(rows)[:13], 1)}
    got = grounding.blocked(spark.createDataFrame(titles, TITLES), spark.createDataFrame(items, ITEMS), 13).collect()
    assert {(r.title_id, r.item_id, r.weight, r.place) for r in got} == want and len(got) == len(want)
    assert seen == [(5, 8)]


def test_fuzzy_compares_each_name_once(spark, monkeypatch):
    items, seen = catalog(), counted(monkeypatch, similarity, "meetings")
    titles = [(f"t{n}", "red ringz large") for n in range(9)]
    got = grounding.ground_fuzzy(spark.createDataFrame(titles, TITLES), spark.createDataFrame(items, ITEMS), k=12).collect()
    ranked = sorted((-similarity.ratio("red ringz large", x), i) for i, x in items)[:12]
    assert [[(c.item_id, c.score) for c in r.candidates] for r in got] == [[(i, -s) for s, i in ranked]] * 9
    assert seen == [(1, 6)]


def test_shortlist_meets_each_name_once(spark, monkeypatch):
    items, seen = [(i, x, int(i[1:]) % 4) for i, x in catalog()], counted(monkeypatch, similarity, "meetings")
    a = spark.createDataFrame([("red ringz large",), ("plate",)], "f string")
    b = spark.createDataFrame([(i, x, p) for i, x, p in items], "item_id string, name string, popularity long")
    for shared in (False, True):
        want = set()
        for f in ("red ringz large", "plate"):
            quick = lambda x: 2.0 * int(similarity.common_characters([f], [x])[0, 0]) / (len(f) + len(x))  # noqa: B023, E731
            rows = sorted((-quick(x), -p, i) for i, x, p in items if not shared or set(f.split()) & set(x.split()))
            want |= {(f, i) for _, _, i in rows[:14]}
        assert {(r.f, r.item_id) for r in similarity.quick_shortlist(a, b, 14, shared).collect()} == want
    assert seen == [(2, 6)] * 2


def test_ratio_of_equal_pairs_once(spark):
    rows = spark.createDataFrame([("red ring", f"i{n}", "red rings", n) for n in range(5)] + [("a", "j", "", None)], "f string, item_id string, name string, popularity long")
    df = similarity.with_ratio(rows)
    score = round(similarity.ratio("red ring", "red rings"), 12)
    assert {(r.f, r.item_id, r.popularity, round(r.score, 12)) for r in df.collect()} == {("red ring", f"i{n}", n, score) for n in range(5)} | {("a", "j", None, 0.0)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [f" in plan[plan.index("MapInPandas") :]
