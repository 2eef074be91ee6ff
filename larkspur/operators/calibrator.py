"""Two heads that say whether an override would improve or harm an example, fitted in two stages and replayed.

First a class-balanced logistic regression over scaled features (train pack), then Platt's step on another pack: a sigmoid of the
first stage's margin, fitted to softened targets, so that the probabilities mean what they say although the classes were balanced. Train
rows of one class only give a constant. Validation rows of one class leave the first stage as it is.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.enrich import override_model, threshold_grid

FEW = 20  # improved train rows below which a bundle is marked


@dataclass
class Head:
    """``kind``: constant, balanced or calibrated."""

    kind: str
    prior: float
    model: Any = None
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the probability of the positive class as column ``name``."""
        if self.kind == "constant":
            return rows.withColumn(name, F.lit(self.prior))
        margin = vector_to_array("rawPrediction")[1]
        told = 1 / (1 + F.exp(-(F.lit(self.slope) * margin + F.lit(self.shift))))
        return self.model.transform(rows).withColumn(name, told).drop("raw", "features", "rawPrediction", "probability", "prediction")


def platt(margins: DataFrame) -> tuple[float, float]:
    """Slope and shift of the sigmoid for rows (margin, label 0 or 1), by weighted likelihood.

    A row of n positives counts as (n + 1) / (n + 2) positive, one of m negatives as 1 / (m + 2); it is there as both, with these weights.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = margins.agg(F.sum("label").alias("n"), F.sum(1 - F.col("label")).alias("m"))
    soft = F.when(F.col("label") == 1, (F.col("n") + 1) / (F.col("n") + 2)).otherwise(1 / (F.col("m") + 2))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("y"), soft.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - soft).alias("w"))))
    rows = margins.join(F.broadcast(counts), F.lit(True)).select("margin", both.alias("x")).select("margin", "x.y", "x.w")
    fitted = LogisticRegression(labelCol="y", weightCol="w", featuresCol="f", maxIter=100, tol=1e-9).fit(VectorAssembler(inputCols=["margin"], outputCol="f").transform(rows))
    return float(fitted.coefficients[0]), float(fitted.intercept)


def fit_head(train: DataFrame, valid: DataFrame, features: list[str], label: str) -> Head:
    """A head for ``label`` (0 or 1). Rows are read several times: pass written tables."""
    share = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if share is None or share in (0.0, 1.0):
        return Head("constant", min(0.99, max(0.01, share or 0.0)))
    model = override_model(train, features, label)
    held = valid.agg(F.min(label), F.max(label)).first()
    if held[0] is None or held[0] == held[1]:
        return Head("balanced", share, model)
    margins = model.transform(valid).select(vector_to_array("rawPrediction")[1].alias("margin"), F.col(label).cast("double").alias("label"))
    return Head("calibrated", share, model, *platt(margins))


@dataclass
class Bundle:
    improve: Head
    harm: Head
    balance: dict[str, float]

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with p_improve and p_harm."""
        return self.harm.probability(self.improve.probability(rows, "p_improve"), "p_harm")


def fit_bundle(train: DataFrame, valid: DataFrame, features: list[str]) -> Bundle:
    """Both heads for rows with ``improves`` and ``harms`` (0 or 1)."""
    n = train.agg(
        F.coalesce(F.sum("improves"), F.lit(0)).alias("n_improve"), F.coalesce(F.sum("harms"), F.lit(0)).alias("n_harm"), F.count_if((F.col("improves") == 0) & (F.col("harms") == 0)).alias("n_neutral")
    ).first()
    balance = {**n.asDict(), "few_improved": n["n_improve"] < FEW}
    return Bundle(fit_head(train, valid, features, "improves"), fit_head(train, valid, features, "harms"), balance)


def chosen_thresholds(valid: DataFrame, improves: list[float], harms: list[float], tolerance: float, least: int) -> DataFrame:
    """(improve, harm) of the best allowed point on the validation pack, by ndcg, less harm, then stricter thresholds; no row if none is allowed."""
    grid = threshold_grid(valid, improves, harms, tolerance, least).where("allowed")
    return grid.orderBy(F.desc(F.round("ndcg", 9)), F.round("harm_rate", 9), F.desc("improve"), "harm").limit(1).select("improve", "harm")


def replayed(test: DataFrame, point: DataFrame) -> DataFrame:
    """``test`` (p_improve, p_harm, ndcg_before, ndcg_after) row by row under the chosen thresholds: ``overrides`` and ``ndcg``. Without a point nothing is overridden."""
    met = test.join(F.broadcast(point.select(F.struct("improve", "harm").alias("g"))), F.lit(True), "left")
    take = F.coalesce((F.col("p_improve") >= F.col("g.improve")) & (F.col("p_harm") <= F.col("g.harm")), F.lit(False))
    return met.withColumn("overrides", take).withColumn("ndcg", F.when(take, F.col("ndcg_after")).otherwise(F.col("ndcg_before"))).drop("g")


def replay_summary(rows: DataFrame) -> DataFrame:
    """n, overrides, ndcg, ndcg_before, improved, harmed of replayed rows."""
    d = F.col("ndcg") - F.col("ndcg_before")
    return rows.agg(
        F.count("*").alias("n"), F.count_if("overrides").alias("overrides"), F.avg("ndcg").alias("ndcg"), F.avg("ndcg_before").alias("ndcg_before"),
        F.count_if(d > 1e-14).alias("improved"), F.count_if(d < -1e-14).alias("harmed"),
    )
