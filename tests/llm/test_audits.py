"""Filter audit, Merkle manifest and embedding duplicates against plain-Python versions."""

import itertools
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import embedding_dedup as E
from larkspur.llm import filter_audit as A
from larkspur.llm import merkle_manifest as M

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---------------------------------------------------------------- filter audit


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, text, *_ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    parts = defaultdict(list)
    for d, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": d is not None and text in first and first[text] < d,
        }
        parts[lang or ""].append((d, frozenset(k for k, v in fails.items() if v)))
    out = set()
    for part, rows in parts.items():
        found, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(rows)
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                redundant = sum(1 for _, f in rows if c in f and f & set(order[: step - 1]))
                shapley[c] += len(gone)
                found.append((part, "".join(order), step, c, len(left), len(gone), redundant, sum(1 for _, f in rows if f == {c}), sum(1 for d, _ in gone if d in good), sum(1 for d, _ in gone if d in toxic)))
        out |= {(*r[:3], *r[4:], shapley[r[3]]) for r in found}
    return out


def awkward_docs():
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for d in range(150):
        text = " ".join(rng.choice(words, int(rng.integers(60, 200)), replace=bool(d % 2)))
        text = text.upper() if d % 11 == 0 else text
        text = text + " 50% & more" if d % 7 == 0 else text
        rows.append((d, text, ["en", "de", None, ""][d % 4], "s", len(text)))
    rows += [(200 + i, rows[5][1], "en", "s", 1) for i in range(40)]  # a hot text
    rows += [(300, None, "en", None, None), (301, "", "fr", "s", 0), (302, None, None, None, None), (2, rows[2][1], rows[2][2], "s", 5), (2, "other text", "en", "s", 9)]
    rows += [(None, rows[5][1], "en", "s", 1), (None, None, None, None, None), (303, "a b c\x0bd \U0001f600 ÄÖ", "xx", "s", 10), (304, "LONG " * 40_000, "en", "s", 1)]
    return rows


def test_filter_audit_equals_brute_force(spark):
    docs = awkward_docs()
    labels = [(d, d % 2, int(d % 3 == 0)) for d in range(0, 320, 2)] + [(4, None, None), (4, 1, 0), (None, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS + ", mask string, part long")
    got = {tuple(r) for r in A.filter_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    want = brute_audit(docs, labels)
    assert len(got) == 120 * 5 * 5
    assert got == want


def test_filter_audit_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.filter_audit(spark.createDataFrame([], DOCS), none).count() == 0
    one = A.filter_audit(spark.createDataFrame([(1, "x", "en", "s", 1)], DOCS), none)
    assert one.agg(F.sum("good_lost"), F.sum("toxic_lost"), F.sum("kept")).first()[:2] == (0, 0)


def test_filter_audit_own_filters(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, "a b", "en", "s", 3), (3, "c", "en", "s", 1)], DOCS)
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = A.filter_audit(docs, labels, {"S": F.size("words") < 2})
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["good_lost"], r["shapley"]) for r in rows.collect()}
    assert got == {("SE", 1): (2, 1, 1, 2), ("SE", 2): (1, 1, 0, 2), ("ES", 1): (2, 1, 0, 2), ("ES", 2): (1, 1, 1, 2)}
    with pytest.raises(ValueError):
        A.interactions(docs, "ABCDEFGHI")


# ------------------------------------------------------------- Merkle manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves, fanout=2):
    """Root, and for each leaf the (left, right) texts of its proof."""
    level, at, proof = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, place in enumerate(at):
            first = place // fanout * fanout
            proof[i].append(("".join(level[first:place]), "".join(level[place + 1 : first + fanout])))
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [place // fanout for place in at]
    return level[0], proof


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(docs, fanout=2):
    leaf = lambda r, n: h(told(r[0]), told(r[3]), told(r[2]), told(n), told(r[1]))
    parts = defaultdict(list)
    for r in docs:
        parts[r[2]].append(r)
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    subroots, inner = {}, {}
    for name in names:
        rows = sorted(parts[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        parts[name] = rows
        subroots[name], inner[name] = brute_tree([leaf(r, r[4]) for r in rows], fanout)
    root, over = brute_tree([subroots[n] for n in names], fanout)
    out = []
    for k, name in enumerate(names):
        for r, steps in zip(parts[name], inner[name], strict=True):
            steps = steps + over[k]
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(r, r[4] + 1 if bad else r[4])
            for a, b in steps:
                folded = h(a, folded, b)
            out.append((r[0], leaf(r, r[4]), subroots[name], root, h(*(a + b for a, b in steps)), folded, folded == root))
    return sorted(out, key=repr)


def run_op12(spark, docs, tmp_path, name):
    path = str(tmp_path / name)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in M.op12_merkle_manifest(spark, path).collect()), key=repr)


def test_merkle_query_equals_brute_force(spark, tmp_path):
    docs = [(d, f"text {d} ü", ["en", "en", "en", "de", None, "", "zz", "Ä"][d % 8], None if d % 5 == 0 else f"s{d % 3}", None if d % 9 == 0 else d) for d in range(1500)]
    docs += [(7000, "lone", "only", "s", 4), (None, None, "en", None, None), (None, "x", "en", None, 3), (3, docs[3][1], docs[3][2], docs[3][3], docs[3][4])]
    assert run_op12(spark, docs, tmp_path, "many") == brute_manifest(docs)


@pytest.mark.parametrize("n", [1, 2, 3, 256, 257])
def test_merkle_sizes(spark, tmp_path, n):
    docs = [(d, "t", "en", "s", 1) for d in range(n)]
    assert run_op12(spark, docs, tmp_path, f"n{n}") == brute_manifest(docs)


def test_merkle_no_rows(spark, tmp_path):
    assert run_op12(spark, [], tmp_path, "none") == []


def test_merkle_other_fanout_and_nodes(spark):
    docs = [(d, f"t{d}", "en" if d % 3 else "de", "s", d) for d in range(100)]
    made = M.document_manifest(spark.createDataFrame([(*r, 5) for r in docs], DOCS + ", part int"))
    assert made.proven().count() == 100
    leaves = spark.createDataFrame([("=en" if d % 3 else "=de", f"{d:064d}", d) for d in range(100)], "part string, leaf string, k int")
    three = M.manifest(leaves, ["k"], fanout=3, stride=2)
    rows = three.proven().withColumn("back", M.folded(F.col("leaf"), F.col("proof"))).collect()
    assert len(rows) == 100 and all(r["back"] == r["root"] for r in rows)
    root, _ = brute_tree([f"{d:064d}" for d in range(100) if d % 3], 3)
    assert {r["subroot"] for r in rows if r["part"] == "=en"} == {root}
    nodes = {(r["part"], r["level"], r["idx"]): r["hash"] for r in three.rows.nodes().collect()}
    level = [f"{d:064d}" for d in range(100) if d % 3]
    for k in range(5):
        assert [nodes["=en", k, i] for i in range(len(level))] == level
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]


# ------------------------------------------------------- embedding duplicates


def brute_links(rows, least=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    near = defaultdict(list)
    for (p, (_, x)), (q, (_, y)) in itertools.permutations(enumerate(good), 2):
        if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
            near[p].append(q)
    label = [i for i, _ in good]
    changed = True
    while changed:
        changed = False
        for p in range(len(good)):
            low = min([label[p], *(label[q] for q in near[p])])
            changed |= low != label[p]
            label[p] = low
    out = [(i, len(near[p]), label[p], i == label[p]) for p, (i, _) in enumerate(good)]
    taken = Counter(i for i, _ in good)
    for i, _ in rows:
        if taken[i]:
            taken[i] -= 1
        else:
            out.append((i, 0, i, True))
    return sorted(out, key=repr)


def vectors(d=16):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((240, d))
    x[60:120] = x[0] + 0.25 * rng.standard_normal((60, d))  # a chain-like group of near copies
    x[120:150] = x[1]  # equal vectors
    x[150:160] = x[2] * np.arange(1, 11)[:, None]  # the same directions
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


def dedup(spark, rows, schema="vec_id long, embedding array<float>", **options):
    out = E.near_embeddings(spark.createDataFrame(rows, schema), **options)
    return sorted((tuple(r) for r in out.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def test_embeddings_equal_brute_force(spark):
    rows = vectors() + [(900, None), (901, [0.0] * 16), (902, [1.0, None] * 8), (903, [float("nan")] * 16), (904, [float("inf")] * 16), (905, [])]
    rows += [(906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e30] * 16), (909, [1e-30] * 16), (None, [1.0] * 16)]
    assert dedup(spark, rows, width=4.0) == brute_links(rows)  # sqrt(16): exact


def test_embeddings_repeated_rows(spark):
    rows = [(5, [1.0, 2.0, 3.0, 4.0]), (5, [1.0, 2.0, 3.0, 4.0]), (3, [1.0, 2.0, 3.0, 4.1]), (9, [-1.0, 0.0, 0.0, 0.0])]
    assert dedup(spark, rows) == [(3, 2, 3, True), (5, 2, 3, False), (5, 2, 3, False), (9, 0, 9, True)]


def test_embeddings_blocks_and_hot_classes(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_VALUES", 16 * 20)  # blocks of 20 vectors
    monkeypatch.setattr(E, "HOT", 10)
    rows = vectors()
    assert dedup(spark, rows, width=4.0) == brute_links(rows)


def test_embeddings_recall_of_lists(spark):
    """Random directions with pairs near the limit: at least 0.99 of links over many lists."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[2000:] = x[:1000] + rng.standard_normal((1000, 64)) * 0.036
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = int(((u @ u.T >= 0.95).sum() - len(u)))
    got = dedup(spark, rows, "vec_id long, embedding array<double>")
    assert want > 1000 and 0.99 * want <= sum(r[1] for r in got) <= want


def test_embeddings_no_rows_and_clashing_columns(spark):
    schema = "vec_id long, embedding array<float>, own string, row int, kept string, k1 int"
    assert E.near_embeddings(spark.createDataFrame([], schema)).columns == ["vec_id", "embedding", "own", "row", "k1", "n_links", "component_id", "kept"]
    assert E.near_embeddings(spark.createDataFrame([], schema)).count() == 0
    out = E.near_embeddings(spark.createDataFrame([(1, [1.0, 0.0], "a", 2, "b", 3)], schema)).collect()
    assert [tuple(r) for r in out] == [(1, [1.0, 0.0], "a", 2, 3, 0, 1, True)]
