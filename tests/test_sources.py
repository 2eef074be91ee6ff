"""Readers and sinks on small files."""

import gzip

import pytest

from larkspur.sources import readers, sinks


def test_csv_and_json_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_id,item_id,timestamp,rating,domain\nu1,i1,5,,\nu2,i2,,4.5,books\n")
    got = [tuple(r) for r in readers.interactions(readers.rows(spark, str(tmp_path / "a.csv"))).orderBy("user_id").collect()]
    assert got == [("u1", "i1", 5.0, None, "tiny"), ("u2", "i2", None, 4.5, "books")]
    with gzip.open(tmp_path / "m.jsonl.gz", "wt") as f:
        f.write('{"item_id": "i1", "title": "  A\\tTitle ", "genres": "Drama"}\n\n')
    items = readers.items(readers.rows(spark, str(tmp_path / "m.jsonl.gz"))).collect()
    assert [tuple(r) for r in items] == [("i1", "A Title", "Drama")]
    with pytest.raises(ValueError, match="missing columns"):
        readers.interactions(spark.createDataFrame([("u",)], "user_id string"))


def test_delimited_and_metadata(spark, tmp_path):
    (tmp_path / "movies.dat").write_bytes(b"1::Caf\xe9 :: Noir::Drama\n")
    row = readers.delimited(spark, str(tmp_path / "movies.dat"), ["id", "title", "rest"]).collect()[0]
    assert tuple(row) == ("1", "Café ", " Noir::Drama")
    meta = spark.createDataFrame([("i1", 2, "b"), ("i1", 1, "a"), ("i9", 3, "c")], "item_id string, seq int, title string")
    needed = spark.createDataFrame([("i1",), ("i1",), ("i2",)], "item_id string")
    assert [r.title for r in readers.metadata_for(meta, needed, "seq").collect()] == ["a"]
    assert tuple(readers.field_report(meta, ["title", "brand"]).collect()[0]) == (3, 0, 3)


def test_external_rankings_and_scores(spark):
    rows = spark.createDataFrame([("e1", "u", "t", ["a", "t"]), ("e2", "u", "t", ["a", "b"])], "example_id string, user_id string, target string, candidates array<string>")
    assert {r.example_id: r.candidates for r in readers.external_rankings(rows).collect()} == {"e1": ["a", "t"], "e2": ["t", "a", "b"]}
    assert [r.example_id for r in readers.external_rankings(rows, strict=True).collect()] == ["e1"]
    scores = spark.createDataFrame([("e", None, "i", "1", 1), ("e", None, "i", "2", 2)], "example_id string, user_id string, item_id string, score string, seq int")
    assert readers.last_scores(scores, "seq").collect()[0].score == 2.0


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u", ["a", "b"], 1.5)], "id string, items array<string>, v double")
    sinks.csv(df, str(tmp_path / "c"), "\t")
    assert tuple(spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "c")).collect()[0]) == ("u", '["a","b"]', "1.5")
    sinks.jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).collect()[0]["items"] == ["a", "b"]
    assert [tuple(r) for r in sinks.artifacts({"x": df}, str(tmp_path / "p"), 7).collect()] == [("x", 1, 7)]
    asked = df.withColumn("request_key", sinks.request_key("id", "v"))
    cache = asked.selectExpr("request_key", "'yes' AS response")
    assert [r.cache_hit for r in sinks.answered(asked, cache).collect()] == [True]
