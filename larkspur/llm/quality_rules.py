"""Quality rules whose cutoffs carry a finite-sample guarantee.

Every rule compares one text statistic with a cutoff; a document over any cutoff is dropped. Cutoffs move together, from
strict to lenient, in a fixed number of levels. For each stratum (language) the strictest level is taken for which
an exact binomial test on labelled good documents rejects "all rules together wrongly drop at least ``risk`` of the
good documents". Levels are tested from lenient to strict up to the first that fails (a fixed sequence, which needs
no correction within), at a level divided by the number of strata and the pool (Bonferroni): with probability 1 - ``delta``
all guarantees hold at once.

A stratum with too few labels to certify any level has no level: only the base rules drop its documents. With
``lend_pool`` it takes the level certified for the pool of all strata; its guarantee is then for good documents of all
languages together, not for that stratum (``certified`` tells which).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, WORD, stored, table

SYMBOLS = r"[#*$%&|<>]"
#: rule -> (statistic as SQL, its cutoff at each level from strict to lenient).
GRID = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.45]),
    "long_words": ("word_chars / greatest(n_words, 1)", [8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0]),
}
LEVELS = 7
RISK, DELTA = 0.01, 0.05  # good documents wrongly dropped by all rules together; chance that any guarantee fails


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (all long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    a = docs.withColumn("__w", F.filter(F.split(body, GAP), lambda x: x != "")).withColumn(
        "__l", F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    )
    n = F.size("__w")
    a = a.withColumn("n_words", n.cast("long")).withColumn(
        "__t",
        F.when(
            n >= 3,
            F.array_sort(
                F.transform(
                    F.sequence(F.lit(0), n - 3),
                    lambda i: F.struct(F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("i")),
                )
            ),
        ),
    )
    same = lambda j, x: F.coalesce(F.get("__t", j)["h"] == x["h"], F.lit(False))
    a = a.withColumn("__p", F.array_sort(F.transform(F.filter("__t", lambda x, j: same(j - 1, x) | same(j + 1, x)), lambda x: x["i"])))
    covered: Column = F.aggregate(
        F.transform("__p", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("__p", j + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x
    )
    return a.select(
        *docs.columns,
        "n_words",
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
    )


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed from exact terms in logarithms."""
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.exp(n * F.log(F.lit(1 - p))).alias("s"))

    def step(acc: Column, j: Column) -> Column:
        t = acc["t"] + F.log((n - j + 1) / j) + F.log(F.lit(p / (1 - p)))
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, start, step, lambda acc: acc["s"])


def passed(level: Column | int, rule: str) -> Column:
    """Whether a document is over the cutoff of ``rule`` at a level."""
    sql, cutoffs = GRID[rule]
    return F.expr(sql) > F.get(F.array(*(F.lit(float(c)) for c in cutoffs)), level if isinstance(level, Column) else F.lit(level))


def controlled_levels(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, level): the strictest level with bounded risk; stratum null is the pool. Strata without any aren't returned.

    ``labelled``: good documents only, with ``stratum`` (not null) and the statistics of ``text_stats``.
    """
    dropped = [F.count_if(F.greatest(*(passed(t, rule) for rule in GRID))).alias(f"k{t}") for t in range(LEVELS)]
    counts = labelled.rollup("stratum").agg(F.count("*").alias("n"), *dropped).where("n > 0")
    each = counts.join(counts.agg(F.count("*").alias("groups")), F.lit(True))  # one row more
    each = each.select(
        "stratum", "n", (F.lit(delta) / F.col("groups")).alias("alpha"), F.posexplode(F.array(*(f"k{t}" for t in range(LEVELS)))).alias("level", "k")
    )
    # beyond the mean of Binomial(n, risk) the test can't reject; the sum stops there. Stricter levels drop more, so
    # the strictest level that passes is the last of the sequence
    tail = F.when(F.col("k") > F.col("n") * risk, F.lit(1.0)).otherwise(binomial_cdf(F.col("k"), F.col("n"), risk))
    return each.where(tail <= F.col("alpha")).groupBy("stratum").agg(F.min("level").alias("level"))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, lend_pool: bool = False) -> DataFrame:
    """Statistics, base_failed, kept, the rules that dropped a document, its level, and whether that is ``certified`` for its stratum.

    ``docs``: doc_id, text, lang; ``labels``: doc_id, quality (1 good). Null and empty texts
    have no words and fail the base rules; a null language is its own stratum ''; repeated
    rows are judged one by one; without labels only the base rules decide. Other columns are left out.
    """
    stats = stored(
        text_stats(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), "text")).drop("text")
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    good = labels.where("quality = 1").select("doc_id").distinct()
    levels = stored(controlled_levels(stats.where("not base_failed").join(good, "doc_id", "left_semi"), risk, delta))
    own = levels.where("stratum is not null").withColumnRenamed("level", "own")
    pool = levels.where("stratum is null").agg(F.max("level").alias("pool"))  # one row
    judged = stats.join(own, "stratum", "left").join(pool, F.lit(True)).withColumn("level", F.coalesce("own", "pool") if lend_pool else F.col("own"))
    over = F.array_compact(F.array(*(F.when(passed(F.col("level"), rule), F.lit(rule)) for rule in GRID)))
    return judged.select(
        *stats.columns, "level", F.col("own").isNotNull().alias("certified"), over.alias("dropped_by"), (~F.col("base_failed") & (F.size(over) == 0)).alias("kept")
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
