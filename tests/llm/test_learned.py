"""Toxicity, mixing, line deduplication and the pipeline."""

import os

import pytest
from pyspark.sql import functions as F

from larkspur.llm import line_dedup, registry, source_mix, toxicity
from larkspur.llm.components import components

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.id: r.label for r in components(links).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@needs_tables
def test_toxicity_on_held_out_texts(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = registry.QUERIES["op8_toxicity"](spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    pos, neg = rows[rows.toxic == 1].score, rows[rows.toxic == 0].score
    above = sum((p > neg).sum() + 0.5 * (p == neg).sum() for p in pos) / (len(pos) * len(neg))
    assert above > 0.9
    assert ((rows.predicted == 1) & (rows.toxic == 0)).mean() < 0.03


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "some text", 7)], "doc_id long, text string, toxic_score long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert [(r.doc_id, r.toxic_score, r.toxic_predicted) for r in sorted(got)] == [(1, 0.0, 0), (2, 0.0, 0), (3, 0.0, 0)]


def test_gapped_insults_score_above_plain_words():
    import random

    rng = random.Random(3)
    clean = [["".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(60)] for _ in range(240)]
    toxic = [[*t, rng.choice(["worthless", "pathetic", "disgusting"])] for t in clean[:80]]
    machine = toxicity.train([(1, t) for t in toxic] + [(0, t) for t in clean[80:]])
    plain = max(machine.margins(clean[200]))
    assert min(machine.margins(["worthless", "w.orthless", "worthlesss", "pathxetic", "disgusing"])) > plain
    assert toxicity.words_of("you i d i o t now") >= {"idiot", "you", "now"}
    assert toxicity.words_of(None) == set() and toxicity.train([(1, ["a"])]) is None


def test_mixing_follows_weights_and_supply(spark):
    rows = [(i, "w " * (10 + i % 7), "en" if i % 3 else "de", f"src{i % 20}") for i in range(900)]
    rows += [(1000, None, None, None), (1001, "", "en", "src0"), (5, "again", "en", "src5"), (5, "again", "en", "src5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit("mine"))
    for name in ("end", "u", "whole", "rest", "ranges", "before", "range", "row", "n", "through", "budget"):
        docs = docs.withColumn(name, F.lit(name))
    got = source_mix.mix_sources(docs).collect()
    assert len(got) == len(rows) and all(r["u"] == "u" and r["end"] == "end" and r["range"] == "range" for r in got)
    total = sum(r.tokens for r in got)
    taken = sum(r.tokens * r.copies for r in got)
    assert 0.75 * total <= taken <= 0.8 * total and max(r.copies for r in got) <= 2
    by = lambda d: sum(r.tokens * r.copies for r in got if r.domain == d) / taken
    assert abs(by("web") - 0.4) < 0.05 and abs(by("forum") - 0.1) < 0.03
    assert source_mix.mix_sources(docs.where("false")).count() == 0


def test_water_level(spark):
    nodes = spark.createDataFrame([("r", "a", 10.0, 5.0, 1.0), ("r", "b", 10.0, 2.0, 1.0), ("r", "c", 10.0, 100.0, 2.0)], "p string, k string, given double, cap double, weight double")
    got = {r.k: r.budget for r in source_mix.fill(nodes, ["p"], "k").collect()}
    assert got == pytest.approx({"a": 8 / 3, "b": 2.0, "c": 16 / 3})
    poor = {r.k: r.budget for r in source_mix.fill(nodes.withColumn("given", F.lit(500.0)), ["p"], "k").collect()}
    assert poor == {"a": 5.0, "b": 2.0, "c": 100.0}


def test_line_dedup(spark):
    long_line = "the quick brown fox jumps over the lazy dog while seven wizards watch from the hill above the town"
    texts = {
        1: f"{long_line}\nshort\nunique first line of document one", 2: f"  {long_line.upper()}\nshort\nanother line that stands alone here", 3: long_line.replace("seven", "eight") + "\n",
        4: None, 5: "", 6: long_line, 7: "x" * 5000 + "\n" + "x" * 5000,
    }
    docs = spark.createDataFrame([(i, t, 3) for i, t in texts.items()], "doc_id long, text string, n_lines long")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1] == (texts[1], 0) and got[2] == ("short\nanother line that stands alone here", 1)
    assert got[3] == ("", 1) and got[4] == (None, 0) and got[5] == ("", 0) and got[6] == ("", 1) and got[7] == ("x" * 5000, 1)
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def line_brute(texts):
    """How many lines each document loses: components of all pairs of lines at Jaccard .8, the first line stays."""
    lines = [(d, p, x.strip(" ").lower()) for d, t in texts.items() for p, x in enumerate(t.split("\n"))]
    lines = [(d, p, x, {x[i : i + 5] for i in range(len(x) - 4)}) for d, p, x in sorted(lines) if len(x) >= 8]
    label = list(range(len(lines)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, _, x, a) in enumerate(lines):
        for j, (_, _, y, b) in enumerate(lines[:i]):
            if x == y or 100 * len(a & b) >= 80 * len(a | b):
                r, q = root(i), root(j)
                label[max(r, q)] = min(r, q)
    dropped = {d: 0 for d in texts}
    for i, (d, *_) in enumerate(lines):
        dropped[d] += root(i) != i
    return dropped


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        at = rng.randrange(len(words[k]))
        words[k] = words[k][:at] + rng.choice("abcdefghijklmnopqrstuvwxyz") + words[k][at + 1 :]
    return " ".join(words)


def some_words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n)]


@pytest.mark.parametrize("words", [16, 40])
def test_groups_of_differing_near_copies(spark, words):
    import random

    rng = random.Random(words)
    lines = [edited(rng, base, rng.randint(0, words // 8)) for base in (some_words(rng, words) for _ in range(12)) for _ in range(30)]
    rng.shuffle(lines)
    texts = {i: "\n".join(lines[3 * i : 3 * i + 3]) for i in range(len(lines) // 3)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    block = line_dedup.BLOCK
    try:
        line_dedup.BLOCK = 4
        assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs).collect()} == line_brute(texts)
    finally:
        line_dedup.BLOCK = block


def test_short_near_copies(spark):
    import random

    rng = random.Random(8)
    lines = ["sign up today and save on your next online order with us", "sign up todey and save on your next online order with us"]
    lines += ["aaaaaaaa", "aaaaaaaaaa", "abcdefgh", "abcdefghi", "abcdefghij", "ab ab ab ab", "ab ab ab ab ab"]
    for n in (2, 3, 4, 6, 8, 10):
        for _ in range(40):
            base = some_words(rng, n)
            lines += [" ".join(base), edited(rng, base, 1), " ".join(base) + rng.choice(["", ".", "s", " x"])]
    texts = dict(enumerate(lines))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs).collect()} == line_brute(texts)


@needs_tables
def test_sql_checks(spark):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF}/{name}'")
    for name, sql in registry.ORACLE_SQL.items():
        df = registry.QUERIES[name](spark, SF)
        result = con.sql(sql)
        places = [result.columns.index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in places) for r in result.fetchall()), key=repr), name


@needs_tables
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
    assert {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()} <= {r.doc_id for r in docs.collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() == last.where("round_trip").count()
    docs.unpersist()
