"""Categories of grounding failures against plain Python."""

import difflib
import random
from collections import Counter

from larkspur.functions.text import folded_title as fold
from larkspur.operators import failures


def ratio(a, b):
    return 0.0 if not a or not b else 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


def test_categories_equal_plain_rules(spark):
    rng = random.Random(12)
    words = ["red", "blue", "steel", "brass", "large", "small", "box", "case", "drum", "jar"]
    catalog = [(f"i{n:03d}", " ".join(rng.sample(words, rng.randint(1, 5))), rng.choice([None, 1, 5])) for n in range(80)] + [("e1", "", 2), ("e2", None, 1), ("d1", "The Thing Itself", 1), ("d2", "thing itself", 3)]
    rows = []
    for n in range(60):
        own = rng.choice(catalog[:80])[1]
        title = [own, own + " x", own[::-1], "zzzz qqqq wwww", "", None, "thing itself", "red"][n % 8]
        status, item = [("ungrounded", None), ("ambiguous", None), ("fuzzy", "i001"), ("Parse_Failed", "i002"), (None, None)][n % 5]
        rows.append((f"t{n:02d}", title, rng.choice([own, None, "other thing"]), status, item, rng.choice([None, 0.2, 0.7, 0.9])))
    a = spark.createDataFrame(rows, "title_id string, title string, target_title string, status string, item_id string, confidence double")
    b = spark.createDataFrame(catalog, "item_id string, title string, popularity int")
    found = failures.classified(a, b).cache()
    counts = Counter(fold(t or "") for _, t, _ in catalog)
    want = {}
    for i, title, target, status, item, confidence in rows:
        if item and (status or "").lower() not in failures.FAILED:
            continue
        f, named = fold(title or ""), []
        for item_id, t, p in catalog:
            g = fold(t or "")
            if f and g:
                named.append((-(1.0 if f == g else difflib.SequenceMatcher(None, f, g).quick_ratio()), -(p or 0), item_id, g))
        short = sorted((-ratio(f, g), p, item_id) for _, p, item_id, g in sorted(named)[:60])[:3]
        top, second = (-short[0][0] if short else 0.0), (-short[1][0] if len(short) > 1 else None)
        got = ["high_confidence_ungrounded"] if confidence is not None and confidence >= 0.7 else []
        got += ["duplicate_title_risk"] if f and counts[f] > 1 else []
        got += ["generated_title_too_generic"] if len(f.split()) <= 2 or len(f) < 8 else []
        got += ["near_miss_candidate" if top >= 0.7 else "weak_candidate_overlap" if top >= 0.4 else "no_catalog_support"]
        got += ["target_title_near_generated" if ratio(f, fold(target or "")) >= 0.7 else "target_title_distant"]
        asked = sorted({failures.ACTIONS[c] for c in got if c in failures.ACTIONS}) or ["manual_review"]
        want[i] = (round(top, 9), None if second is None else round(second, 9), got, asked)
    rounded = lambda x: None if x is None else round(x, 9)
    assert {r.title_id: (rounded(r.top_score), rounded(r.second_score), r.categories, r.actions) for r in found.collect()} == want
    tally = Counter(("category", c) for v in want.values() for c in v[2]) + Counter(("action", c) for v in want.values() for c in v[3])
    got = {(r.what, r.name): r.n for r in failures.review(found).collect()}
    assert {k: n for k, n in got.items() if k[0] != "status"} == tally and sum(n for (w, _), n in got.items() if w == "status") == len(want)
    first = [(r.confidence or 0.0, r.top_score, r.title_id) for r in failures.cases(found, 10).collect()]
    assert first == sorted(first, key=lambda x: (-x[0], -x[1], x[2])) and len(first) == 10


def test_catalog_summary(spark):
    rows = spark.createDataFrame([("a", "X y", "head"), ("b", "x Y!", "tail"), ("c", " ", None), ("d", None, "tail"), ("e", "z", "tail")], "item_id string, title string, bucket string")
    r = failures.catalog_summary(rows).first()
    assert (r["items"], r.empty_titles, r.duplicate_groups, r.duplicate_items, r.duplicate_share, r.buckets) == (5, 2, 1, 2, 0.4, {"head": 1, "tail": 3, "unknown": 1})
    assert failures.catalog_summary(rows.limit(0)).first()["duplicate_share"] == 0.0
