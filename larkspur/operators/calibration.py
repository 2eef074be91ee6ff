"""Confidence: calibration error, selective risk, calibrators and residuals.

Rows: confidence in [0, 1], correct (0 or 1) and, where asked for, bucket, split and an order ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bin_left(c: Column, bins: int) -> Column:
    """Bins [lo, hi), the last one closed."""
    return F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int")


def bin_right(c: Column, bins: int) -> Column:
    """Bins (lo, hi], the first one closed, compared with i / bins as written."""
    out = F.lit(0)
    for i in range(1, bins):
        out = F.when(c > i / bins, i).otherwise(out)
    return out


def reliability(rows: DataFrame, bins: int, which=bin_left, groups: list[str] = ()) -> DataFrame:
    return rows.groupBy(*groups, which(F.col("confidence"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy")
    )


def all_bins(table: DataFrame, bins: int, empty: float | None = 0.0) -> DataFrame:
    """``reliability`` with a row for each bin; empty ones get ``empty``."""
    every = table.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(table, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out if empty is None else out.fillna(empty, ["mean_confidence", "accuracy"])


def calibration_error(rows: DataFrame, bins: int, which=bin_left, groups: list[str] = ()) -> DataFrame:
    """ece: mean over rows of the gap between a bin's accuracy and mean confidence; brier: mean squared error."""
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence")) * F.col("n")
    ece = reliability(rows, bins, which, groups).groupBy(*groups).agg((F.sum(gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
    brier = rows.groupBy(*groups).agg(F.avg(F.pow(F.col("confidence") - F.col("correct"), F.lit(2))).alias("brier"))
    return ece.join(brier, list(groups)) if groups else ece.crossJoin(brier)


def risk_coverage(rows: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Prefixes by confidence (then ``seq``): rank, coverage and the share of errors so far.

    Errors are summed within confidence levels first, so that a window orders levels, and rows only inside a level.
    """
    keys = list(groups) or [F.lit(0)]
    levels = rows.groupBy(*groups, "confidence").agg(F.count("*").alias("c"), F.sum(1 - F.col("correct")).alias("e"))
    above = W.partitionBy(*keys).orderBy(F.desc("confidence")).rowsBetween(W.unboundedPreceding, -1)
    total = W.partitionBy(*keys)
    levels = levels.select(
        *groups, "confidence", F.coalesce(F.sum("c").over(above), F.lit(0)).alias("c0"), F.coalesce(F.sum("e").over(above), F.lit(0)).alias("e0"), F.sum("c").over(total).alias("n")
    )
    inside = W.partitionBy(*groups, "confidence").orderBy("seq")
    placed = rows.join(levels, [*groups, "confidence"])
    rank = F.col("c0") + F.row_number().over(inside)
    errors = F.col("e0") + F.sum(1 - F.col("correct")).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    return placed.withColumn("rank", rank).withColumn("risk", errors / rank).withColumn("coverage", rank / F.col("n")).drop("c0", "e0")


def area_under_risk(rows: DataFrame, groups: list[str] = ()) -> DataFrame:
    """aurc: mean prefix risk; optimal_aurc: the same with labels as confidence; and their difference."""
    mine = risk_coverage(rows, groups).groupBy(*groups).agg(F.avg("risk").alias("aurc"))
    best = risk_coverage(rows.withColumn("confidence", F.col("correct").cast("double")), groups).groupBy(*groups).agg(F.avg("risk").alias("optimal_aurc"))
    both = mine.join(best, list(groups)) if groups else mine.crossJoin(best)
    return both.withColumn("excess", F.col("aurc") - F.col("optimal_aurc"))


def threshold_rates(rows: DataFrame, low: float, high: float, groups: list[str] = ()) -> DataFrame:
    """Shares of correct rows below ``low`` and of wrong rows above ``high`` (null without such rows)."""
    share = lambda of, c: F.avg(F.when(of, F.when(c, 1.0).otherwise(0.0)))
    return rows.groupBy(*groups).agg(share(F.col("correct") == 1, F.col("confidence") < low).alias("cbu"), share(F.col("correct") == 0, F.col("confidence") > high).alias("wbc"))


def tail_gap(rows: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Mean confidence of correct head rows less that of correct tail rows."""
    mean = lambda b: F.avg(F.when((F.col("correct") == 1) & (F.col("bucket") == b), F.col("confidence")))
    return rows.groupBy(*groups).agg((mean("head") - mean("tail")).alias("tail_gap"))


def slope_on_popularity(rows: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Least squares of confidence on log1p(popularity), then within correctness (null without variance)."""
    x = rows.withColumn("x", F.log1p("popularity"))
    inside = W.partitionBy(*groups, "correct")
    x = x.withColumn("xd", F.col("x") - F.avg("x").over(inside)).withColumn("cd", F.col("confidence") - F.avg("confidence").over(inside))
    ok = F.var_pop("x") > 0
    return x.groupBy(*groups).agg(
        F.when(ok, F.regr_slope("confidence", "x")).alias("slope"), F.when(ok, F.regr_intercept("confidence", "x")).alias("intercept"), F.when(F.var_pop("xd") > 1e-18, F.regr_slope("cd", "xd")).alias("within_slope")
    )


def histogram_calibrated(rows: DataFrame, fit: list[str], bins: int) -> DataFrame:
    """``calibrated``: the accuracy of the confidence's bin on the ``fit`` splits; the confidence where the bin was empty."""
    table = reliability(rows.where(F.col("split").isin(fit) & F.col("correct").isNotNull()), bins).select("bin", F.col("accuracy").alias("__a"))
    out = rows.withColumn("bin", bin_left(F.col("confidence"), bins)).join(table, "bin", "left")
    return out.withColumn("calibrated", F.coalesce("__a", "confidence")).drop("__a")


def popularity_residual(rows: DataFrame, fit: list[str]) -> DataFrame:
    """``residual``: confidence less its bucket's mean on the ``fit`` splits (else the global mean); ``deconfounded`` adds the global mean, clipped."""
    known = rows.where(F.col("split").isin(fit))
    means = known.groupBy("bucket").agg(F.avg("confidence").alias("__b"))
    overall = known.agg(F.avg("confidence").alias("__g"))
    out = rows.join(means, "bucket", "left").join(F.broadcast(overall), F.lit(True))
    out = out.withColumn("residual", F.col("confidence") - F.coalesce("__b", "__g"))
    return out.withColumn("deconfounded", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__g") + F.col("residual")))).drop("__b", "__g")


def bootstrap_difference(pairs: DataFrame, resamples: int = 200, seed: int = 5) -> DataFrame:
    """Paired bootstrap of mean(challenger - baseline): observed, share of resamples at least as far from 0, 95 % interval.

    Each row's weight in a resample is Poisson(1) from a hash, so rows never need to be gathered.
    """
    rows = pairs.withColumn("d", F.col("challenger") - F.col("baseline")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = F.pmod(F.xxhash64("key", "b", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    weight, edge, term = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(8):
        edge += term
        weight = weight + F.when(u >= edge, 1).otherwise(0)
        term /= k + 1
    means = rows.withColumn("w", weight).groupBy("b").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m"))
    seen = pairs.agg(F.avg(F.col("challenger") - F.col("baseline")).alias("observed"))
    return means.join(F.broadcast(seen), F.lit(True)).groupBy("observed").agg(
        F.avg(F.when(F.abs("m") >= F.abs("observed"), 1.0).otherwise(0.0)).alias("p_value"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high")
    )


def paired_t(pairs: DataFrame, groups: list[str] = ()) -> DataFrame:
    d = F.col("challenger") - F.col("baseline")
    out = pairs.groupBy(*groups).agg(F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.count("*").alias("n"))
    return out.withColumn("t", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))))
