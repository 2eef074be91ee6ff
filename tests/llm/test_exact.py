"""The exact operators against brute force, with the awkward rows of every table."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from larkspur.llm import byte_bpe, near_dedup, packed_ids, piecewise, quality_rules, repeat_removal, rotated_codes, url_filter
from larkspur.llm.common import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward():
    """Texts with nulls, empty, repeated, near copies, long, and not only ASCII."""
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "дом", "naïve", "x", "1234", "it's", "don't", "日本", "ﬁ", "<|endoftext|>"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(180)) for _ in range(4)]
    texts = [None, "", "   \n\t", "one", "One", "a b c", *base, base[0], base[0].replace("alpha", "omega", 2), base[1] + " tail words here", "pre " + base[2][200:900] + " post"]
    texts += ["z" * 3000, "ab" * 900, base[3] * 30, "q " + base[3][:500], "line\n" * 40 + "other line of text", "Σίσυφος İstanbul \r\n  x"]
    return list(enumerate(texts))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", i) for i, t in rows], "doc_id long, text string, lang string, source string, registers long")


def test_repeats(spark):
    rows = awkward()
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[k : k + 400] for k in range(len(b) - 399))
    got = {r.doc_id: tuple(r)[1:] for r in repeat_removal.cut_repeats(docs(spark, rows)).collect()}
    crowded = repeat_removal.CROWD
    try:
        repeat_removal.CROWD = 1
        assert {r.doc_id: tuple(r)[1:] for r in repeat_removal.cut_repeats(docs(spark, rows)).collect()} == got
    finally:
        repeat_removal.CROWD = crowded
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert got[i] == (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())


@pytest.mark.parametrize("letters", ["ab", "abc", "a", "abcdefghij"])
def test_longest_previous_factors(letters):
    rng = random.Random(len(letters))
    for n in (1, 2, 7, 60, 700):
        text = "".join(rng.choice(letters) for _ in range(n)) + "#"
        codes = np.frombuffer(text.encode(), np.uint8).astype(np.uint16) + 1
        order, levels = repeat_removal.suffix_order(codes)
        if n < 100 or letters != "a":  # beyond DEPTH equal prefixes stay in order of position
            assert order.tolist() == sorted(range(n + 1), key=lambda i: text[i:])
        left = np.arange(n + 1, 0, -1)
        got = repeat_removal.longest_previous(order, levels, codes, left, np.arange(n + 1))
        for i in range(n + 1):
            most = max((next((k for k in range(n + 1 - i) if text[i + k] != text[j + k]), n + 1 - i) for j in range(i)), default=0)
            assert min(got[i], 400) == min(most, 400)


def test_smaller_positions():
    rng = random.Random(2)
    for n in (0, 1, 5, 300):
        for x in (np.arange(n), np.arange(n)[::-1], np.array([rng.randrange(n) for _ in range(n)], int)):
            want = [max((j for j in range(i) if x[j] <= x[i] and (x[j] < x[i] or x[j] == x[i])), default=-1) for i in range(n)]
            assert repeat_removal.smaller_positions(np.asarray(x)).tolist() == want


def test_repeats_keep_first(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(900))
    got = {r.doc_id: r.kept for r in repeat_removal.cut_repeats(docs(spark, [(1, "x" + text), (2, text + "y"), (3, "short")]), keep="first", with_bytes=True).collect()}
    assert got == {1: ("x" + text).encode(), 2: b"y", 3: b"short"}


def test_keep_first_of_repeated_rows(spark):
    """Of repeated rows one stays whole, also where another document holds their text; a copy that is cut elsewhere stays nowhere else."""
    rng = random.Random(2)
    t = "".join(rng.choice("abcdefgh ") for _ in range(900))
    cut = lambda rows: sorted((r.doc_id, r.n_removed, r.kept) for r in repeat_removal.cut_repeats(docs(spark, rows), keep="first", with_bytes=True).collect())
    assert cut([(1, t), (1, t), (2, "x" + t)]) == [(1, 0, t.encode()), (1, 900, b""), (2, 900, b"x")]
    assert cut([(1, t), (1, t), (1, t)]) == [(1, 0, t.encode()), (1, 900, b""), (1, 900, b"")]
    assert cut([(1, t), (1, t), (2, t[:600] + "zz")]) == [(1, 0, t.encode()), (1, 900, b""), (2, 600, b"zz")]
    got = [r for r in repeat_removal.cut_repeats(docs(spark, [(5, t), (5, t), (2, t[100:]), (7, "short"), (7, "short"), (None, None), (None, None)]), keep="first", with_bytes=True).collect()]
    assert sorted((str(r.doc_id), r.n_removed, r.kept) for r in got) == [
        ("2", 0, t[100:].encode()), ("5", 800, t[:100].encode()), ("5", 900, b""), ("7", 0, b"short"), ("7", 0, b"short"), ("None", 0, b""), ("None", 0, b"")
    ]


def near_brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and label[a] > label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_copies(spark):
    rng = random.Random(9)
    base = [str(rng.randrange(10**6)) for _ in range(160)]
    rows = awkward()
    for k in range(60):  # one group around a base, similarities on both sides of the threshold
        words = list(base)
        for _ in range(rng.randrange(14)):
            words[rng.randrange(160)] = str(rng.randrange(10**6))
        rows.append((100 + k, " ".join(words)))
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == near_brute(rows)


def test_near_copies_of_nothing(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    assert repeat_removal.cut_repeats(docs(spark, [])).count() == 0


def test_byte_bpe(spark):
    ranks = {}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        import base64

        for line in f:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = awkward()
    for r in byte_bpe.round_trip(docs(spark, rows)).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = np.array(plain.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs(spark, rows))).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)


def test_split_characters_and_offsets():
    ids = next(iter(byte_bpe.encode(["日本 naïve"])))
    spans = byte_bpe.offsets(ids)
    assert spans[-1][1] == len("日本 naïve".encode()) and (spans[1:, 0] == spans[:-1, 1]).all()
    assert b"".join(byte_bpe.decode(ids[k : k + 1]) for k in range(len(ids))).decode() == "日本 naïve"
    assert len(set(byte_bpe.byte_chars().values())) == 256


def oracles():
    """Encoders made here from the files alone: tiktoken for bytes, a fresh tokenizer for words."""
    import base64

    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    fresh = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {piecewise.byte_level: plain.encode_ordinary, piecewise.word_end: lambda t: fresh.encode(t, add_special_tokens=False).ids}


def odd_texts():
    rng = random.Random(2)
    letters = "ab 'sStTreLlΣİß\n\t\r  12½²ªµ-_#é\u0085ǅ<|endoftext|>​中"
    texts = ["".join(rng.choice(letters[: rng.randint(5, len(letters))]) for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    texts += ["".join(rng.choice("ab '1#\x1c\x1d\x1e\x1f\n\t\x0b\x85\xa0é") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    every = [chr(c) for c in range(0x260)]
    texts += ["".join(rng.choice(every) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    texts += [f"{c}{a}{c}b {c} 1{c}" for c in every for a in ("a", " ", "A")]
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "a", "<|", "|>", "É", "\n"]
    texts += ["".join(rng.choice(special) for _ in range(rng.randint(1, 8))) for _ in range(1000)]
    return [*texts, "hello\x1cworld", "ƏSAS XƏBƏR", "<|endoftext|> hi", "e\u0301 é", "\ufeffx"]


@pytest.mark.parametrize("encoder", [piecewise.byte_level, piecewise.word_end])
def test_pieces_equal_other_encoders(encoder):
    oracle = oracles()[encoder]
    wrong = [t for t in odd_texts() if np.frombuffer(encoder()(t), "<u4").tolist() != oracle(t)]
    assert not wrong


def test_byte_table_equals_the_ranks():
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        for token, rank in map(bytes.split, f):
            assert byte_bpe.decode(np.array([int(rank)])) == base64.b64decode(token)


def test_packed_ids(spark):
    rows = awkward()
    folder = shared_dir(spark)
    shards = packed_ids.write_packed(docs(spark, rows), folder)
    got = sorted(map(tuple, packed_ids.read_packed(spark, folder, shards).collect()))
    start, want = 0, []
    encode = oracles()[piecewise.word_end]
    for i, t in rows:
        ids = np.array([*encode(t or ""), 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    empty = shared_dir(spark)
    assert packed_ids.read_packed(spark, empty, packed_ids.write_packed(docs(spark, []), empty)).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 24, 31, 32])
def test_packing_and_random_access(bits):
    ids = [np.random.default_rng(n).integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 4095, 5000, 3)]
    shard = packed_ids.Shard(packed_ids.shard_bytes([7, 8, 9, 10, 11], ids, bits))
    assert all((shard.document(k) == x).all() for k, x in enumerate(ids))
    flat = np.concatenate(ids)
    assert (shard.slice(4090, 8200) == flat[4090:8200]).all()


def test_urls(spark):
    urls = [None, "", "no scheme", "http://a.com/en/1", "HTTP://Example.COM/en/7?x#y", "x://net", "s://sub.example.net/de/81", "s://notexample.com/en/70", "s://org/es/#", "s://.com/en/"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls + urls)], "page_id long, url string, rule string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, url_filter.rule_table(spark)).collect()}
    n = len(urls)
    assert len(got) == 2 * n and {x[1:] for x in got if x[0] in (0, 1, 2)} == {("", "", None, "allow")}
    by = {x[0]: x[1:] for x in got}
    assert by[3] == ("a.com", "/en/1", "com/en/", "block") and by[4] == ("example.com", "/en/7", "example.com/en/7", "allow") and by[5] == ("net", "", None, "allow")
    assert by[6] == ("sub.example.net", "/de/81", "example.net/de/8", "block") and by[7] == ("notexample.com", "/en/70", "com/en/", "block")
    assert by[8] == ("org", "/es/", "org/es/", "block") and by[9] == (".com", "/en/", "com/en/", "block")
    # rules beside brute force, and columns with the names that the operator uses
    rng = random.Random(6)
    hosts = ["com", "b.com", "a.b.com", "x", "b.x", ""]
    rules = [(rng.choice(hosts), rng.choice(["/", "/a", "/ab", "/a/b", ""]), rng.choice(["allow", "block"])) for _ in range(12)] + [(None, "/", "block"), ("x", None, "block")]
    some = [f"s://{rng.choice(['', 'c.', 'd.c.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/abc', '/a/b?c', '#'])}" for _ in range(80)]
    names = "page_id long, url string, u string, v string, m string, short string, Rule string, row string"
    pages = spark.createDataFrame([(i, x, "u", "v", "m", "s", "r", "w") for i, x in enumerate(some)], names)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for r in url_filter.url_filter(pages, table).collect():
        fit = [(h + p, v) for h, p, v in rules if h is not None and p is not None and (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        best = max(fit, key=lambda x: (len(x[0]), x[1] == "block"), default=(None, "allow"))
        assert (len(r.rule or ""), r.verdict) == (len(best[0] or ""), best[1]) and (r.u, r.v, r.m, r.short, r.row) == ("u", "v", "m", "s", "w")
    no_rules = url_filter.url_filter(pages, url_filter.rule_table(spark).where("false"))
    assert {r.verdict for r in no_rules.collect()} == {"allow"}


def test_contract_rules(spark):
    urls = ["s://net/de/", "s://a.net/de/8", "s://example.net/de/7", "s://example.net/de/8", "s://com/en/", "s://example.com/en/7", "s://org/es/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(pages, url_filter.rule_table(spark)).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("net/de/", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block"),
    ]


def test_text_stats_and_bounds(spark):
    rows = [*awkward(), (90, "a b c a b c d"), (91, "same\nsame\n\nother"), (92, "# $ % text | <b>")]
    for r in quality_rules.text_stats(docs(spark, rows)).collect():
        t = r.text or ""
        w = WORD.findall(t)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for k in range(len(w) - 2) if seen[w[k], w[k + 1], w[k + 2]] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
    from pyspark.sql import functions as F

    cdf = spark.createDataFrame([(0, 700), (1, 900), (3, 1000), (5, 5000)], "k long, n long").select("k", "n", quality_rules.binomial_cdf(F.col("k"), F.col("n"), 0.005).alias("p"))
    from math import comb

    for r in cdf.collect():
        assert r.p == pytest.approx(sum(comb(r.n, j) * 0.005**j * 0.995 ** (r.n - j) for j in range(r.k + 1)), rel=1e-9)


def quality_brute(rows, good, risk, delta, lend_pool):
    """Levels by stratum and pool, and the kept documents, from the rows' statistics, with exact fractions of the binomial sum."""
    from math import comb

    value = {
        "symbols": lambda r: r.n_symbols / max(r.word_chars, 1), "dup_lines": lambda r: r.n_dup_lines / max(r.n_lines, 1),
        "repeats": lambda r: r.n_repeat_words / max(r.n_words, 1), "long_words": lambda r: r.word_chars / max(r.n_words, 1),
    }
    over = lambda r, t: any(value[rule](r) > grid[t] for rule, (_, grid) in quality_rules.GRID.items())
    sample = [r for r in rows if not r.base_failed and r.doc_id in good]
    groups = {s: [r for r in sample if r.stratum == s] for s in {r.stratum for r in sample}} | {None: sample}
    levels = {}
    for s, members in groups.items():
        for t in reversed(range(quality_rules.LEVELS)):
            n, k = len(members), sum(over(r, t) for r in members)
            if not n or sum(comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1)) > delta / len(groups):
                break
            levels[s] = t
    kept = {r.doc_id for r in rows if not r.base_failed and not ((t := levels.get(r.stratum, levels.get(None) if lend_pool else None)) is not None and over(r, t))}
    return levels, kept


def test_certified_cutoffs(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "#", "$x", "verylongwordindeed"] + [f"w{i}" for i in range(300)]
    rows = []
    for i in range(900):
        odd = rng.random()
        text = [rng.choice(words[(4 if odd > 0.1 else 0) :] if odd > 0.02 else words[4:7]) for _ in range(rng.randint(40, 140))]
        rows.append((i, "\n".join(" ".join(text[k : k + 12]) for k in range(0, len(text), 12)), "en" if i % 3 else ("de" if i % 9 else None)))
    rows += [(900, None, "en"), (901, "", None), (5, rows[5][1], "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS level", "2 AS own", "3 AS n")
    labels = spark.createDataFrame([(i, 1) for i in range(800)] + [(7, 1), (8, 0)], "doc_id long, quality int")
    for risk, lend_pool in ((0.01, False), (0.01, True), (0.03, False), (0.03, True), (0.1, True), (0.4, False)):
        got = quality_rules.quality_rules(table, labels, risk, 0.05, lend_pool).collect()
        levels, kept = quality_brute(got, set(range(800)), risk, 0.05, lend_pool)
        if not lend_pool:  # a stratum without a guarantee loses nothing but what the base rules drop
            assert all(r.level is None and r.kept != r.base_failed for r in got if not r.certified)
        assert len(got) == len(rows) and {r.doc_id for r in got if r.kept} == kept
        assert {r.stratum: r.level for r in got if r.certified} == {s: t for s, t in levels.items() if s is not None}
    none = quality_rules.quality_rules(table, labels.where("false")).collect()
    assert all(r.kept != r.base_failed and r.level is None for r in none)


def test_nearest(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((400, 24)).astype(np.float32)
    v[10:16] = v[9]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (904, [float("inf")] + [1.0] * 23), (905, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rotated_codes.nearest(table, table.where("vec_id % 20 = 0")).collect())
    want = []
    for q in range(0, 400, 20):
        score = rotated_codes.exact(v[q].astype(float), v.T.astype(float))
        order = [j for j in np.lexsort((np.arange(400), -score)) if j != q][:20]
        want += [(q, k + 1, int(j), float(score[j])) for k, j in enumerate(order)]
    found = {x[0]: set() for x in want}
    for x in got:
        found[x[0]].add(x[2])
    recall = np.mean([x[2] in found[x[0]] for x in want])
    assert recall >= 0.99 and set(x[0] for x in got) == set(range(0, 400, 20))
