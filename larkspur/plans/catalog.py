"""Named queries of the engine and the SQL that checks them.

Fractions are rounded to DIGITS places on both sides: sums depend on their order in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.plans import baselines, confidence, data, enriched, fusion, ranking, records, retrieval, text

MODULES = [data, ranking, confidence, text, enriched, baselines, records, retrieval, fusion]
DIGITS = 11
#: The fractional columns of each query that has SQL.
FRACTIONS = {
    "area_under_risk": ("aurc", "optimal_aurc", "excess"),
    "attribution": ("d_mrr",),
    "case_labels": ("mean_confidence",),
    "coverage_by_domain": ("coverage", "catalog_coverage"),
    "exposure_inequality": ("gini", "entropy"),
    "popular_title": ("confidence",),
    "ranked_title": ("confidence",),
    "candidate_summary": ("chosen_rate", "mean_place"),
    "filled_ranking": ("score",),
    "panel_stats": ("in_panel", "fallback_place", "answer_place", "top_hit"),
    "candidate_evidence": ("preference", "confidence"),
    "confidence_rates": ("cbu", "wbc"),
    "coverage": ("coverage", "catalog_coverage", "row_coverage"),
    "diversity": ("ild", "categories", "entropy"),
    "ece_left_closed": ("ece", "brier"),
    "ece_right_closed": ("ece", "brier"),
    "exposure_scores": ("estimate", "echo", "gain", "risk", "score"),
    "fusion_order": ("fusion",),
    "ground_titles": ("score",),
    "fusion_replay": ("recall", "mrr", "ndcg", "fallback_ndcg", "harmful_rate"),
    "gate_replay": ("recall", "mrr", "ndcg", "fallback_ndcg", "harmful_rate"),
    "replay_by_seed": ("override_rate", "recall", "mrr", "ndcg", "mean_confidence", "ece", "brier", "tail_recall", "head_recall"),
    "replay_merged": ("override_rate", "recall", "mrr", "ndcg", "mean_confidence", "ece", "brier", "tail_recall", "head_recall"),
    "histogram_calibration": ("calibrated",),
    "latency_percentiles": ("total", "p50", "p95"),
    "long_tail": ("hit_rate", "bucket_coverage"),
    "metric_rows": ("value",),
    "metrics_by_slice": ("recall", "ndcg"),
    "novelty": ("self_information", "popularity_rank"),
    "override_outcomes": ("harmful_rate",),
    "paired_t": ("mean", "sd", "t"),
    "parse_observations": ("confidence",),
    "policy_grid": ("accept", "normal", "hit_rate", "override_rate"),
    "popularity_percentile": ("percentile",),
    "popularity_residual": ("residual", "deconfounded"),
    "popularity_slope": ("slope", "intercept", "within_slope"),
    "rank_bm25": ("score",),
    "rank_cooccurrence": ("score",),
    "rank_hash": ("score",),
    "rank_last_item": ("score",),
    "rank_markov": ("score",),
    "rank_popularity": ("score",),
    "ranking_metrics": ("recall", "mrr", "ndcg"),
    "reliability_bins": ("mean_confidence", "accuracy"),
    "risk_coverage": ("risk", "coverage"),
    "seed_aggregate": ("mean", "std", "ci95"),
    "tail_gap": ("tail_gap",),
    "triage": ("weight",),
    "threshold_grid": ("ndcg", "harm_rate"),
    "user_min_count": ("ts",),
    "user_sequences": ("ratings",),
    "validity": ("valid", "hallucinated"),
}


def _rounded(query: Callable, columns: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir).withColumns({c: F.round(c, DIGITS) for c in columns})

    return run


def _rounded_sql(sql: str, columns: tuple[str, ...]) -> str:
    if not columns:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), {DIGITS}) AS {c}' for c in columns)}) FROM ({sql})"


QUERIES = {name: _rounded(query, FRACTIONS.get(name, ())) for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: _rounded_sql(sql, FRACTIONS.get(name, ())) for m in MODULES for name, sql in m.SQL.items()}
