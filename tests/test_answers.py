"""Checks of answers and external rankings against plain-Python rules."""

import json
import math

import pytest

from larkspur.operators import answers
from larkspur.sources import external


def walk(value, clamp):
    """The first fault of a confidence, objects in order of their keys."""
    if isinstance(value, dict):
        for key in sorted(value):
            child = value[key]
            if key == "confidence":
                if isinstance(child, bool) or not isinstance(child, int | float):
                    return "confidence must be numeric"
                if not clamp and not (math.isfinite(child) and 0 <= child <= 1):
                    return "confidence must be in [0, 1]"
            elif (fault := walk(child, clamp)) is not None:
                return fault
    elif isinstance(value, list):
        for child in value:
            if (fault := walk(child, clamp)) is not None:
                return fault
    return None


def titled(data, name):
    rows = data.get(name)
    if not isinstance(rows, list):
        return f"{name} must be a list"
    if not rows:
        return f"{name} must be non-empty"
    for i, row in enumerate(rows):
        if not isinstance(row, dict) or not isinstance(row.get("title"), str):
            return f"{name}[{i}].title must be a string"
    return None


def rules(data, task, clamp):
    if not isinstance(data, dict):
        return "no JSON object"
    if (fault := walk(data, clamp)) is not None:
        return fault
    if task == "rerank":
        return titled(data, "ranked_items")
    if task == "candidates":
        return titled(data, "options")
    if task == "generation":
        value = data.get("recommendation")
        if not isinstance(value, str):
            return "recommendation must be a string"
        if not value.strip():
            return "recommendation must be non-empty"
    elif str(data.get("answer") or "").lower() not in ("yes", "no"):
        return "answer must be yes or no"
    return None if "confidence" in data else "confidence is required"


OBJECTS = [
    {"recommendation": "A", "confidence": 0.5}, {"recommendation": "A"}, {"recommendation": 5, "confidence": 1}, {"recommendation": "  ", "confidence": 0}, {"confidence": 0.2}, {},
    {"recommendation": "A", "confidence": "0.5"}, {"recommendation": "A", "confidence": True}, {"recommendation": "A", "confidence": None}, {"recommendation": "A", "confidence": 1.5},
    {"recommendation": "A", "confidence": -1e-3}, {"recommendation": "A", "confidence": {"x": 1}}, {"recommendation": "A", "confidence": [1]}, {"recommendation": 'a "confidence": 7 b', "confidence": 1},
    {"recommendation": "A", "confidence": 1e-2, "more": [{"deep": {"confidence": 2}}]}, {"recommendation": "A", "confidence": 1, "a": {"confidence": "no"}},
    {"answer": "YES", "confidence": 1}, {"answer": "maybe", "confidence": 1}, {"answer": "no"}, {"answer": True, "confidence": 0}, {"answer": None, "confidence": 0},
    {"ranked_items": []}, {"ranked_items": {}}, {"ranked_items": [{"title": "A", "confidence": 0.1}, {"title": "B"}]}, {"ranked_items": [{"title": "A"}, {"title": 3}]}, {"ranked_items": ["A"]},
    {"ranked_items": [{"title": "A", "confidence": 3}]}, {"options": [{"title": "A"}]}, {"options": [{"name": "A"}]}, {"options": "A"}, {"options": []},
]


@pytest.mark.parametrize("task", answers.TASKS)
@pytest.mark.parametrize("clamp", [False, True])
def test_rules_of_every_task(spark, task, clamp):
    rows = [(i, json.dumps(x), rules(x, task, clamp)) for i, x in enumerate(OBJECTS)]
    rows += [(100, "no json at all", "no JSON object"), (101, "[1, 2]", "no JSON object"), (102, None, "no JSON object"), (103, "", "no JSON object"), (104, '{"a": ', "no JSON object")]
    df = spark.createDataFrame(rows, "id int, raw string, want string")
    for r in answers.checked(df, task, clamp=clamp).drop("data").collect():
        assert r.error == r.want and r.ok == (r.want is None) and not r.recovered, r
    with pytest.raises(ValueError, match="isn't one of"):
        answers.checked(df, "other")


def test_closed_list_of_a_cut_answer(spark):
    raw = [
        '{"ranked_items": [{"title": "A ] \\" [", "confidence": 0.5, "tags": ["x", "]"]}], "explanation": "and then it',
        '{"ranked_items": [{"title": "A"}, {"title": "B"',
        '{"ranked_items": [], "explanation": "cut',
        '{"ranked_items": [{"title": "A", "confidence": 7}], "why": "cut',
        '{"ranked_items": [{"name": "A"}], "why": "cut',
    ]
    got = [(r.ok, r.recovered, r.error) for r in answers.checked(spark.createDataFrame(list(enumerate(raw)), "id int, raw string"), "rerank").drop("data").orderBy("id").collect()]
    assert got == [(True, True, None), (False, False, "no JSON object"), (False, False, "no JSON object"), (False, False, "no JSON object"), (False, True, "ranked_items[0].title must be a string")]


def test_external_events(spark):
    lines = [
        {"event_id": "e1", "uid": 7, "target_item_id": "t", "candidates": ["a", "t"], "history": ["h"]},
        {"source_event_id": "e2", "user_id": "u", "pos_item": "t", "items": [{"asin": "a"}, {"iid": 5}, {}]},
        {"user_id": "u", "event_id": "", "positive_item_id": None, "candidate_items": "no list", "candidate_item_ids": [1, 2.5]},
        {},
    ]
    rows = [(json.dumps(x), i) for i, x in enumerate(lines, 1)] + [("   ", 9)]
    df = spark.createDataFrame(rows, "value string, index int")
    histories = spark.createDataFrame([("u", ["k1", "k2"])], "user_id string, history array<string>")
    found = external.events(df, "books", "test", histories=histories)
    got = {r.example_id: tuple(r)[1:] for r in found.collect()}
    assert got == {
        "e1": ("7", "t", ["h"], ["a", "t"], False, 2),
        "e2": ("u", "t", ["k1", "k2"], ["t", "a", "5", ""], True, 3),
        "books_test_3": ("u", "", ["k1", "k2"], ["1", "2.5"], False, 2),
        "books_test_4": ("", "", [], [], False, 0),
    }
    labels = {(r.example_id, r.item_id): r.label for r in external.candidate_rows(found).collect()}
    assert labels["e2", "t"] == 1 and labels["e1", "a"] == 0 and len(labels) == 8
    assert {r.item_id for r in external.known_items(found).collect()} == {"h", "a", "t", "k1", "k2", "5", "", "1", "2.5"}
    with pytest.raises(Exception, match="target missing from candidates in event e2"):
        external.events(df, "books", "test", strict=True).collect()
    twice = spark.createDataFrame([('{"event_id": "e", "items": ["a", "a"]}', 1)], "value string, index int")
    with pytest.raises(Exception, match="duplicate candidates in event e"):
        external.events(twice, "books", "test").collect()
