"""Coverage from one pass over its rows."""

from larkspur.operators import metrics


def made_once(df, text):
    return df._jdf.queryExecution().optimizedPlan().toString().count(text)


def test_coverage_reads_its_rows_once(spark):
    rows = [("m", "u", ["a", "b", "c"], ["b", "a"]), ("m", "v", ["a", None], []), ("n", None, ["d"], ["d", "z"]), ("o", "w", ["a"], []), (None, "w", ["a"], ["a"])]
    df = spark.createDataFrame(rows, "method string, user_id string, candidates array<string>, predicted array<string>").where("user_id is null or user_id != 'never'")
    catalog = spark.createDataFrame([(i,) for i in "abcd"], "item_id string")
    out = metrics.coverage(df, 2, catalog, ["method"])
    assert made_once(out, "never") == 1
    assert {r.method: tuple(r)[1:] for r in out.collect()} == {"m": (2 / 3, 0.5, 0.5, 2), "n": (2.0, 0.5, 1.0, 0)}
