"""The JSON lines source (filters and limit in the scan) and atomic exports."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, Not
from pyspark.sql.types import StructType

from larkspur.sources import atomic, jsonlines


def write(path, rows, blank=False):
    lines = "".join(json.dumps(r, ensure_ascii=False) + "\n" + ("\n" if blank else "") for r in rows)
    if str(path).endswith(".gz"):
        with gzip.open(path, "wt", encoding="utf-8") as f:
            f.write(lines)
    else:
        path.write_text(lines, encoding="utf-8")


ROWS = [{"id": i, "name": f"näme {i}", "score": i / 4, "ok": i % 2 == 0, "tags": ["a", i]} for i in range(50)]


def test_splits_give_every_line_once(spark, tmp_path):
    write(tmp_path / "a.jsonl", ROWS, blank=True)
    write(tmp_path / "b.jsonl.gz", ROWS[:10])
    (tmp_path / "_hidden").write_text("no json")
    for size in (1, 7, 64, 1 << 20):
        df = jsonlines.json_lines(spark, str(tmp_path), split_bytes=size)
        assert df.count() == 60
        assert sorted(r["id"] for r in df.collect()) == sorted([*range(50), *range(10)])
    row = df.where("id = 3").first()
    assert (row["name"], row["score"], row["ok"], json.loads(row["tags"])) == ("näme 3", 0.75, False, ["a", 3])
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "score": "double", "ok": "boolean", "tags": "string"}


def test_limit_opens_only_first_files(spark, tmp_path):
    write(tmp_path / "a.jsonl", ROWS[:5])
    write(tmp_path / "b.jsonl", ROWS[5:10])
    (tmp_path / "c.jsonl.gz").write_bytes(b"not gzip at all")
    schema = "id long, name string"
    assert [r["id"] for r in jsonlines.json_lines(spark, str(tmp_path), schema, limit=7).collect()] == list(range(7))
    assert jsonlines.json_lines(spark, str(tmp_path), schema, limit=10).count() == 10
    assert jsonlines.json_lines(spark, str(tmp_path), schema, limit=0).count() == 0
    with pytest.raises(Exception, match="gzip"):
        jsonlines.json_lines(spark, str(tmp_path), schema, limit=11).collect()
    # the limit counts what the filter leaves
    assert [r["id"] for r in jsonlines.json_lines(spark, str(tmp_path), schema, limit=2).where("id >= 4").collect()] == [4, 5]


def test_filters_are_taken_into_the_scan(spark, tmp_path):
    write(tmp_path / "a.jsonl", [*ROWS, {"id": None}, {"id": "x"}, {}])
    schema = StructType.fromDDL("id long, name string, ok boolean")
    reader = jsonlines.JsonLinesReader(schema, {"path": str(tmp_path)})
    own = [EqualTo(("ok",), True), GreaterThan(("id",), 40), IsNotNull(("id",))]
    other = [Not(EqualTo(("id",), 3)), EqualTo(("a", "b"), 1)]
    assert list(reader.pushFilters([*own, *other])) == other
    assert [r[0] for part in reader.partitions() for r in reader.read(part)] == [42, 44, 46, 48]
    df = jsonlines.json_lines(spark, str(tmp_path), schema)
    assert df.where("id > 40 and ok").count() == 4
    assert df.where("id is null").count() == 3
    assert df.where("id in (1, 2, 99)").count() == 2


def test_bad_lines_name_their_file(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception, match="bad.jsonl"):
        jsonlines.json_lines(spark, str(tmp_path), "id long").collect()
    (tmp_path / "bad.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="isn't an object"):
        jsonlines.json_lines(spark, str(tmp_path), "id long").collect()


def test_sampled_fields(spark, tmp_path):
    write(tmp_path / "a.jsonl", [{"a": "x", "b": ""}, {"a": None, "c": 1}, {"d": 5}])
    got = {r["field"]: (r["seen"], r["missing"], r["records"]) for r in jsonlines.sampled_fields(spark, str(tmp_path), ["a", "b", "zz"], 2).collect()}
    assert got == {"a": (True, 1, 2), "b": (True, 2, 2), "c": (True, None, 2), "zz": (False, 2, 2)}


def whole(path):
    """The parts of an export, one after another."""
    names = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    return "".join(open(f"{path}/{n}", encoding="utf-8").read() for n in names)


def test_export_is_ordered_and_typed(spark, tmp_path):
    df = spark.range(100).select((99 - F.col("id")).alias("n"), F.lit("a\tb\nc").alias("t"), F.array(F.lit("x"), F.lit("y")).alias("l"))
    path = f"{tmp_path}/d.inter"
    atomic.export(df.repartition(7), path, ["n"])
    lines = whole(path).splitlines()
    assert lines[0] == "n:float\tt:token\tl:token_seq"
    assert lines[1:] == [f"{n}\ta b c\tx y" for n in range(100)]
    assert json.load(open(f"{path}/_rows.json"))["rows"] == 100
    atomic.export(df.limit(3), path, ["n"])  # replaces the export
    assert len(whole(path).splitlines()) == 4
    assert os.listdir(tmp_path) == ["d.inter"]


def test_failed_task_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/d.inter"
    bad = spark.range(100).repartition(5).select(F.when(F.col("id") == 77, F.raise_error(F.lit("boom"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="boom"):
        atomic.export(bad, path)
    assert os.listdir(tmp_path) == []
    atomic.export(spark.range(3), path, ["id"])
    with pytest.raises(Exception, match="boom"):
        atomic.export(bad, path)
    assert whole(path) == "id:float\n0\n1\n2\n"


def test_append_refuses_an_existing_export(spark, tmp_path):
    path = f"{tmp_path}/d.inter"
    atomic.export(spark.range(3), path, ["id"])
    with pytest.raises(Exception, match="d.inter"):
        spark.range(9).write.format("atomic").mode("append").save(path)
    assert whole(path) == "id:float\n0\n1\n2\n" and os.listdir(tmp_path) == ["d.inter"]


def test_target_index(spark):
    rows = [("u:7", ["a"], None, None), ("u:x", ["a"], None, None), ("u", ["a", "b"], None, None), ("u", [], None, None), ("u:7", ["a"], "3", None), ("u:7", ["a"], "q", {"target_index": "5"}), ("u:7", ["a"], "4", {"target_index": "q"})]
    df = spark.createDataFrame(rows, "example_id string, history array<string>, target_index string, metadata map<string,string>")
    assert [r[0] for r in df.select(atomic.target_index(df.columns)).collect()] == [7, None, 2, None, 3, 5, 4]


def test_dataset_export(spark, tmp_path):
    timeline = spark.createDataFrame([("u", f"i{n}", n, 10.0 * n) for n in range(5)] + [("v", "i1", 0, 1.0)], "user_id string, item_id string, idx int, ts double")
    examples = spark.createDataFrame(
        [("u:1", "u", "train", ["i0"], "i1"), ("u:2", "u", "train", ["i0", "i1"], "i2"), ("u:4", "u", "test", ["i0", "i1", "i2", "i3"], "i4"), ("w:9", "w", "train", ["p"], "q")],
        "example_id string, user_id string, split string, history array<string>, target string",
    )
    items = spark.createDataFrame([("i0", "A b", None), ("i1", None, "c\td")], "item_id string, title string, category string")
    atomic.export_dataset(str(tmp_path), "ml", examples, timeline, items, most=2)
    base = f"{tmp_path}/ml/ml"
    train = "u\ti0\t0.0\nu\ti1\t10.0\nu\ti2\t20.0\nw\tp\t0.0\nw\tq\t1.0\n"
    head = "user_id:token\titem_id:token\ttimestamp:float\n"
    assert whole(f"{base}.train.inter") == head + train
    assert whole(f"{base}.test.inter") == whole(f"{base}.valid.inter") == head + "u\ti4\t40.0\n"
    assert whole(f"{base}.inter") == head + train + "u\ti4\t40.0\n" * 2
    assert whole(f"{base}.sasrec_test.inter").splitlines() == ["user_id:token\titem_id:token\titem_id_list:token_seq\ttimestamp:float", "u\ti4\ti2 i3\t40.0"]
    assert whole(f"{base}.item") == "item_id:token\ttitle:token_seq\tcategory:token_seq\ni0\tA b\t\ni1\t\tc d\n"
    assert whole(f"{base}.user") == "user_id:token\nu\nw\n"
