"""History and candidates of a prompt meet the catalog in one join."""

from larkspur.operators import prompts


def test_lists_meet_the_catalog_once(spark):
    items = spark.createDataFrame([("a", "A"), ("b", None), ("t", "T")], "item_id string, title string").where("title is null or title != 'never'")
    rows = [("e", ["b", "a", "t", None, "a"], "t", ["a", "t", "b"]), ("f", None, "a", ["a"]), ("g", [], "t", None)]
    examples = spark.createDataFrame(rows, "example_id string, history array<string>, target string, candidates array<string>")
    out = prompts.prompt_context(examples, items)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("never") == 1
    got = {r.example_id: (r.history_item_ids, r.history_titles, r.prompt_candidate_item_ids, r.candidate_titles, r.history_excluded_item_ids) for r in out.collect()}
    none = ([], "[]", [], "[]", [])
    assert got["f"] == none and got["g"] == none
    assert got["e"][0] == ["b", "a", "a"] and got["e"][2] == ["a", "b"] and got["e"][4] == ["t"]
