"""Every pipeline stage on nulls in any column, empty and very long texts, repeated rows, empty tables and columns of other names."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["row", "rid", "__rid", "__drop", "gone", "k1", "label", "score", "copies", "domain", "tokens", "toxic_score", "kept", "id", "u", "ids", "decoded"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def awkward():
    a, b = prose(1, 120), prose(2, 80)
    rows = [(1, a, "en", "src1", len(a)), (2, a, "en", "src2", len(a)), (2, a, "en", "src2", len(a)), (3, a + " more", "de", "src1", 5), (4, b, None, "src3", None), (5, b + "\n" + a, "fr", None, 1)]
    rows += [(6, None, "en", "src1", None), (7, "", "en", "src1", 0), (None, prose(3, 60), "en", "src1", 1), (None, None, None, None, None), (8, prose(4, 30_000), "es", "src9", 1)]
    rows += [(9, "\n\n \t\n", "en", "src1", 5), (10, "x", "en", "src1", 1), (11, "ÄÖ \U0001f600 \x1c\x85 ok", "en", "src1", 9)]
    return rows


def run(spark, name, rows, extra=False):
    docs = spark.createDataFrame(rows, SCHEMA)
    if extra:
        docs = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    return STAGES[name](spark, docs, SF), docs


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, name):
    out, docs = run(spark, name, [])
    assert out.count() == 0
    assert name == "byte_bpe" or out.columns == docs.columns


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "near_dedup", "source_mix"])
def test_other_columns_stay_as_they_are(spark, name):
    out, docs = run(spark, name, awkward(), extra=True)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    assert plain(r[:5] for r in rows) == plain(run(spark, name, awkward())[0].collect())


def test_toxicity_keeps_clean_rows(spark):
    out, _ = run(spark, "toxicity", awkward())
    assert plain(out.collect()) == plain(awkward())


def test_line_dedup_keeps_rows_and_first_lines(spark):
    rows = awkward()
    out = run(spark, "line_dedup", rows)[0].collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out if r.doc_id is not None}
    a, b = prose(1, 120), prose(2, 80)
    assert got[1].text == a and got[1].n_chars == len(a)
    assert got[2].text == "" and got[2].n_chars == 0 and sum(r.doc_id == 2 for r in out) == 2
    assert got[4].text == b and got[5].text == "" and got[6].text is None and got[7].text == "" and got[10].text == "x"
    assert len(got[8].text) > 100_000 and got[9].text == "\n\n \t\n"


def test_near_dedup_keeps_one_of_each_group(spark):
    out = run(spark, "near_dedup", awkward())[0].collect()
    ids = [r.doc_id for r in out]
    assert {1, 4, 5, 6, 7, 8, 9, 10, 11} <= set(ids) and not {2, 3} & set(ids) and ids.count(None) == 2


def test_source_mix_takes_no_row_twice(spark):
    rows = awkward()
    out = plain(run(spark, "source_mix", rows)[0].collect())
    left = plain(rows)
    for r in out:
        left.remove(r)  # each row at most as often as it is there
    words = lambda rs: sum(len((r[1] or "").split()) for r in rs)
    assert words(out) <= 0.8 * words(rows) + 1


def test_byte_bpe_goes_round(spark):
    rows = awkward()
    out = run(spark, "byte_bpe", rows, extra=True)[0].collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    sizes = {r.doc_id: r.n_tokens for r in out}
    assert sizes[7] == 0 and sizes[6] == 0 and sizes[8] > 30_000


def test_byte_bpe_checks_in_its_one_pass(spark):
    out, _ = run(spark, "byte_bpe", awkward())
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]


def test_check_agrees_with_decoding(spark):
    from larkspur.llm import byte_bpe

    docs = spark.createDataFrame([(1, "Grüße 😀"), (2, None), (3, "x")], "doc_id long, text string")
    told = byte_bpe.encode_documents(docs, checked="same").join(byte_bpe.decode_documents(byte_bpe.encode_documents(docs)), "doc_id").select("same", "decoded").collect()
    assert all(r.same for r in told) and sorted(bytes(r.decoded).decode() for r in told) == ["", "Grüße 😀", "x"]
