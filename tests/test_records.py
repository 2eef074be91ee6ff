"""Rows for review and training on small logs."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import records


def test_unknown_items_fail_strict_enrichment(spark):
    items = spark.createDataFrame([("a", "A"), ("b", None)], "item_id string, title string")
    good = spark.createDataFrame([(1, "a", ["b", "a"]), (2, "b", [])], "example_id int, target string, history array<string>")
    assert sorted(map(tuple, records.strictly_enriched(good, items).collect())) == [(1, "A", [None, "A"]), (2, None, [])]
    bad = spark.createDataFrame([(1, "a", ["z"])], good.schema)
    with pytest.raises(Exception, match="not in the catalog: z"):
        records.strictly_enriched(bad, items).collect()


def test_filled_ranking_keeps_first_places(spark):
    ranked = spark.createDataFrame([(1, 1, None, 0.9), (1, 2, "c", None), (1, 3, "x", 0.8), (1, 4, "a", 0.7), (1, 5, "c", 0.6)], "example_id int, rank int, item_id string, score double")
    candidates = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "b", 4), (2, "d", 1)], "example_id int, item_id string, at int")
    got = records.filled_ranking(ranked, candidates).orderBy("example_id", "place")
    assert [tuple(r) for r in got.collect()] == [(1, "c", 1, 0.0), (1, "a", 2, 0.7), (1, "b", 3, 0.0), (2, "d", 1, 0.0)]


def test_panels_of_more_than_26_have_numbered_labels(spark):
    rows = spark.range(30).select(F.lit(1).alias("example_id"), F.col("id").cast("string").alias("item_id"), (F.col("id") + 1).alias("place"), F.lit("t").alias("title"))
    labels = records.labelled_panel(rows).first()["labels"]
    assert labels["L0"] == "0" and labels["L29"] == "29" and len(labels) == 30
    assert records.labelled_panel(rows.where("place <= 26")).first()["labels"]["Z"] == "25"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "example_id int, item_id string, place int, fallback int, score double, title string, target string")
    stats = records.panel_stats(empty, empty.select("example_id", "target")).first()
    assert tuple(stats) == (None, None, None, None)
    assert records.labelled_panel(empty).count() == 0


def test_a_plain_case_is_monitored(spark):
    row = spark.createDataFrame([(0.6, 1, True, "exact", None, False, None, 3, None, 0)], "confidence double, correct int, is_grounded boolean, status string, ambiguity double, verified boolean, bucket string, popularity int, made_bucket string, made_popularity int")
    got = row.select(records.tags().alias("tags")).withColumn("actions", records.actions()).first()
    assert got["tags"] == ["correct_intermediate_confidence"] and got["actions"] == ["monitor_in_aggregate"]
