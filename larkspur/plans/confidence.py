"""Queries on confidence: calibration, selective risk, exposure, triage, policies and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators import calibration, candidates, evidence, exposure, mock, policy, popularity
from larkspur.plans.data import examples, test_examples, train_popularity
from larkspur.plans.ranking import BUCKET, CAND, MARKOV_SCORE, MOVES, POP_SCORE, buckets, scored, test_candidates
from larkspur.sources import views

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rows(spark, sf_dir) -> DataFrame:
    known = popularity.buckets_head_tail(popularity.ranked(train_popularity(spark, sf_dir))).select(F.col("item_id").alias("target"), "popularity", "bucket")
    ex = examples(spark, sf_dir).where("split != 'train'").join(known, "target").select("example_id", "user_id", "split", F.col("target").alias("item_id"), "popularity", "bucket")
    return mock.outputs(ex).withColumn("percentile", F.lit(None).cast("double")).withColumn("title", F.col("item_id"))


def _h(name: str, modulus: int) -> str:
    return f"(CAST(('0x' || substr(sha256('{name}:' || example_id), 1, 8)) AS BIGINT) % {modulus})"


def _share(name: str) -> str:
    return f"{_h(name, 101)} / CAST(100 AS DOUBLE)"


def _maybe(name: str, value: str) -> str:
    return f"CASE WHEN {_h(f'null-{name}', 4)} <> 0 THEN {value} END"


CONF = f"""{CAND}, {BUCKET}, c0 AS (SELECT example_id, user_id, split, target AS item_id, pops.popularity, bucket, {_share("c")} AS confidence FROM ex JOIN b ON b.item_id = target JOIN pops ON pops.item_id = target WHERE split IN ('valid', 'test')),
c1 AS (SELECT *, CASE WHEN {_h("y", 100)} < confidence * 100 THEN 1 ELSE 0 END AS correct, {_share("p")} AS preference, confidence AS verbal, {_maybe("g", _share("g"))} AS generation, {_maybe("r", _share("r"))} AS grounding,
  {_maybe("a", _share("a"))} AS ambiguity, {_maybe("h", _share("h"))} AS alignment, {_maybe("n", _share("n"))} AS novelty, {_h("z", 5)} <> 0 AS is_grounded, {_h("grp", 200)} AS grp FROM c0),
conf AS (SELECT *, {_maybe("l", "correct")} AS label FROM c1)"""
_BIN_L = "least(CAST(floor(confidence * 10) AS INTEGER), 9)"
_BIN_R = "CASE " + " ".join(f"WHEN confidence > CAST({i} AS DOUBLE) / 10 THEN {i}" for i in range(9, 0, -1)) + " ELSE 0 END"


def _ece(expr: str) -> str:
    return f"""{CONF}, r AS (SELECT bucket, {expr} AS bin, count(*) AS n, avg(confidence) AS c, avg(CAST(correct AS DOUBLE)) AS a FROM conf GROUP BY ALL),
  e AS (SELECT bucket, sum(abs(a - c) * n) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY bucket), z AS (SELECT bucket, avg((confidence - correct) * (confidence - correct)) AS brier FROM conf GROUP BY bucket) SELECT * FROM e JOIN z USING (bucket)"""


@query("ece_left_closed", _ece(_BIN_L))
def ece_left_closed(spark, sf_dir):
    return calibration.calibration_error(rows(spark, sf_dir), 10, calibration.bin_left, ["bucket"])


@query("ece_right_closed", _ece(_BIN_R))
def ece_right_closed(spark, sf_dir):
    return calibration.calibration_error(rows(spark, sf_dir), 10, calibration.bin_right, ["bucket"])


@query("reliability_bins", f"{CONF}, r AS (SELECT {_BIN_L} AS bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(CAST(correct AS DOUBLE)) AS accuracy FROM conf WHERE confidence < 0.75 GROUP BY ALL) SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, coalesce(mean_confidence, 0) AS mean_confidence, coalesce(accuracy, 0) AS accuracy FROM range(10) v(i) LEFT JOIN r ON bin = i")
def reliability_bins(spark, sf_dir):
    return calibration.all_bins(calibration.reliability(rows(spark, sf_dir).where("confidence < 0.75"), 10), 10)


_RISK = "SELECT example_id, bucket, row_number() OVER w AS rank, sum(1 - correct) OVER (PARTITION BY bucket ORDER BY {c} DESC, example_id ROWS UNBOUNDED PRECEDING) / CAST(row_number() OVER w AS DOUBLE) AS risk, row_number() OVER w / CAST(count(*) OVER (PARTITION BY bucket) AS DOUBLE) AS coverage FROM conf WINDOW w AS (PARTITION BY bucket ORDER BY {c} DESC, example_id)"


@query("risk_coverage", f"{CONF} {_RISK.format(c='confidence')}")
def risk_coverage(spark, sf_dir):
    return calibration.risk_coverage(rows(spark, sf_dir), ["bucket"]).select("example_id", "bucket", F.col("rank").cast("long"), "risk", "coverage")


@query("area_under_risk", f"{CONF}, m AS (SELECT bucket, avg(risk) AS aurc FROM ({_RISK.format(c='confidence')}) GROUP BY bucket), o AS (SELECT bucket, avg(risk) AS optimal_aurc FROM ({_RISK.format(c='correct')}) GROUP BY bucket) SELECT *, aurc - optimal_aurc AS excess FROM m JOIN o USING (bucket)")
def area_under_risk(spark, sf_dir):
    return calibration.area_under_risk(rows(spark, sf_dir), ["bucket"])


@query("confidence_rates", f"{CONF} SELECT bucket, avg(CASE WHEN confidence < 0.5 THEN 1.0::DOUBLE ELSE 0 END) FILTER (correct = 1) AS cbu, avg(CASE WHEN confidence > 0.7::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) FILTER (correct = 0) AS wbc FROM conf GROUP BY bucket")
def confidence_rates(spark, sf_dir):
    return calibration.threshold_rates(rows(spark, sf_dir), 0.5, 0.7, ["bucket"])


@query("tail_gap", f"{CONF} SELECT split, avg(confidence) FILTER (correct = 1 AND bucket = 'head') - avg(confidence) FILTER (correct = 1 AND bucket = 'tail') AS tail_gap FROM conf GROUP BY split")
def tail_gap(spark, sf_dir):
    return calibration.tail_gap(rows(spark, sf_dir), ["split"])


@query("popularity_slope", f"""{CONF}, x AS (SELECT split, confidence, ln(1 + popularity) AS x, ln(1 + popularity) - avg(ln(1 + popularity)) OVER w AS xd, confidence - avg(confidence) OVER w AS cd FROM conf WINDOW w AS (PARTITION BY split, correct))
  SELECT split, regr_slope(confidence, x) AS slope, regr_intercept(confidence, x) AS intercept, regr_slope(cd, xd) AS within_slope FROM x GROUP BY split""")
def popularity_slope(spark, sf_dir):
    return calibration.slope_on_popularity(rows(spark, sf_dir), ["split"])


@query("histogram_calibration", f"""{CONF}, t AS (SELECT {_BIN_L} AS bin, avg(CAST(correct AS DOUBLE)) AS a FROM conf WHERE split = 'valid' GROUP BY ALL) SELECT example_id, bin, coalesce(a, confidence) AS calibrated FROM (SELECT *, {_BIN_L} AS bin FROM conf WHERE split = 'test') LEFT JOIN t USING (bin)""")
def histogram_calibration(spark, sf_dir):
    return calibration.histogram_calibrated(rows(spark, sf_dir), ["valid"], 10).where("split = 'test'").select("example_id", "bin", "calibrated")


@query("popularity_residual", f"""{CONF}, t AS (SELECT bucket, avg(confidence) AS m FROM conf WHERE split = 'valid' GROUP BY bucket), g AS (SELECT avg(confidence) AS g FROM conf WHERE split = 'valid')
  SELECT example_id, confidence - coalesce(m, g) AS residual, least(1, greatest(0, g + confidence - coalesce(m, g))) AS deconfounded FROM conf LEFT JOIN t USING (bucket), g WHERE split = 'test'""")
def popularity_residual(spark, sf_dir):
    return calibration.popularity_residual(rows(spark, sf_dir), ["valid"]).where("split = 'test'").select("example_id", "residual", "deconfounded")


_PRIOR = "CASE bucket WHEN 'head' THEN 0.85::DOUBLE WHEN 'mid' THEN 0.5::DOUBLE WHEN 'tail' THEN 0.15::DOUBLE ELSE 0.5::DOUBLE END"
_CLIP = "least(1::DOUBLE, greatest(0::DOUBLE, {}))"
_EVID = [("preference", 0.25), ("verbal", 0.25), ("generation", 0.15), ("grounding", 0.25), ("alignment", 0.10)]
_MEAN = f"({' + '.join(f'coalesce({c} * {w}::DOUBLE, 0)' for c, w in _EVID)}) / ({' + '.join(f'CASE WHEN {c} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END' for c, w in _EVID)}) - 0.2::DOUBLE * coalesce(ambiguity, 0)"
EXPO = f"""{CONF}, x0 AS (SELECT *, {_PRIOR} AS prior, coalesce(novelty, 1 - alignment, 0.5::DOUBLE) AS nov, {_CLIP.format(f"({_MEAN}) * CASE WHEN is_grounded THEN 1 ELSE 0.2::DOUBLE END")} AS estimate FROM conf),
x1 AS (SELECT *, {_CLIP.format("estimate * prior * (0.5::DOUBLE * (1 - nov) + 0.5::DOUBLE * coalesce(alignment, 1 - nov)) * CASE WHEN is_grounded THEN 1 ELSE 0.5::DOUBLE END")} AS echo,
  {_CLIP.format("nov * (1 - prior) * coalesce(grounding, CASE WHEN is_grounded THEN 1 ELSE 0 END)")} AS gain,
  CASE WHEN is_grounded THEN {_CLIP.format("0.35::DOUBLE * coalesce(ambiguity, 0) + 0.35::DOUBLE * greatest(0, verbal - coalesce(grounding, 1)) + CASE WHEN label = 0 AND verbal >= 0.7::DOUBLE THEN 0.2::DOUBLE * verbal ELSE 0 END")} ELSE 1 END AS risk FROM x0),
expo AS (SELECT *, 0.45::DOUBLE * preference + 0.35::DOUBLE * estimate + 0.2::DOUBLE * gain - 0.55::DOUBLE * risk - 0.45::DOUBLE * echo AS score,
  CASE WHEN NOT is_grounded OR risk >= 0.75 THEN 'abstain' WHEN echo >= 0.35::DOUBLE THEN 'diversify' WHEN estimate >= 0.5 THEN 'recommend' WHEN gain >= 0.2::DOUBLE THEN 'explore' ELSE 'abstain' END AS action FROM x1)"""


@query("exposure_scores", f"{EXPO} SELECT example_id, estimate, echo, gain, risk, score, action FROM expo")
def exposure_scores(spark, sf_dir):
    return exposure.scored(rows(spark, sf_dir)).select("example_id", "estimate", "echo", "gain", "risk", "score", "action")


@query("exposure_rerank", f"{EXPO} SELECT grp AS \"group\", example_id, CAST(row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, item_id, example_id) AS INTEGER) AS place, count(*) OVER (PARTITION BY grp) AS group_size FROM expo QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, item_id, example_id) <= 3")
def exposure_rerank(spark, sf_dir):
    scores = exposure.scored(rows(spark, sf_dir)).withColumn("score", F.round("score", 9))
    return exposure.reranked(scores, "group", 3).select("group", "example_id", "place", "group_size")


@query("triage", f"""{CONF}, t AS (SELECT *, {_CLIP.format(f"confidence * {_PRIOR} * (0.5::DOUBLE * (1 - coalesce(novelty, 1 - alignment, 0.5::DOUBLE)) + 0.5::DOUBLE * coalesce(alignment, 1 - coalesce(novelty, 1 - alignment, 0.5::DOUBLE))) * CASE WHEN is_grounded THEN 1 ELSE 0.5::DOUBLE END")} AS echo FROM conf),
  f AS (SELECT *, NOT is_grounded OR coalesce(grounding < 0.45::DOUBLE, false) OR coalesce(ambiguity > 0.5, false) AS u, NOT is_grounded AND confidence >= 0.7::DOUBLE AS noise, coalesce(label = 1 AND bucket = 'tail' AND confidence <= 0.35::DOUBLE, false) AS hard,
    coalesce(label = 0 AND confidence >= 0.7::DOUBLE, false) AS wrong, coalesce(bucket = 'head' AND confidence >= 0.7::DOUBLE AND novelty <= 0.25, false) AS stale FROM t),
  g AS (SELECT *, wrong AND (bucket = 'head' OR echo >= 0.35::DOUBLE) AS loud, CASE WHEN noise THEN 'prune_candidate' WHEN u THEN 'review' ELSE 'keep' END AS a0, CASE WHEN noise THEN 0 WHEN u THEN 0.5 ELSE 1 END::DOUBLE AS w0 FROM f),
  h AS (SELECT *, CASE WHEN hard THEN 'keep' ELSE a0 END AS a1, CASE WHEN hard THEN 1.25 ELSE w0 END AS w1 FROM g),
  i AS (SELECT *, CASE WHEN loud THEN 'downweight' WHEN wrong AND a1 = 'keep' THEN 'review' ELSE a1 END AS a2, CASE WHEN loud THEN least(w1, 0.25) WHEN wrong AND a1 = 'keep' THEN least(w1, 0.5) ELSE w1 END AS w2 FROM h),
  j AS (SELECT *, CASE WHEN stale AND a2 = 'keep' THEN 'downweight' ELSE a2 END AS a3, CASE WHEN stale AND a2 = 'keep' THEN 0.5 ELSE w2 END AS w3 FROM i)
  SELECT example_id, CASE WHEN label IS NULL AND a3 = 'keep' THEN 'review' ELSE a3 END AS action, CAST(CASE WHEN label IS NULL AND a3 = 'keep' THEN 0.75 ELSE w3 END AS DOUBLE) AS weight,
    CAST(greatest(1, u::INT + noise::INT + hard::INT + wrong::INT + loud::INT + stale::INT + (label IS NULL)::INT) AS INTEGER) AS n_reasons FROM j""")
def triage(spark, sf_dir):
    return exposure.triaged(rows(spark, sf_dir)).select("example_id", "action", "weight", F.size("reasons").alias("n_reasons"))


@query("echo_simulation")
def echo_simulation(spark, sf_dir):
    return exposure.simulated(rows(spark, sf_dir)).groupBy("policy", "round").agg(
        F.count("*").alias("exposures"), F.countDistinct("item_id").alias("items"), F.avg("before").alias("mean_confidence"), F.avg(F.when(F.col("bucket") == "tail", 1.0).otherwise(0.0)).alias("tail_share")
    )


def _policy_rows(spark, sf_dir) -> DataFrame:
    return rows(spark, sf_dir).select("*", (mock.draw("ps", 10) != 0).alias("parse_success"), F.col("is_grounded").alias("grounding_success"), F.col("grounding").alias("grounding_score"), F.col("generation").alias("normalized"), F.col("alignment").alias("similarity"))


_DECIDE = f"""CASE WHEN {_h("ps", 10)} = 0 THEN 'parse_failure' WHEN NOT is_grounded THEN 'grounding_failure' WHEN coalesce(grounding, 0) < 0.8::DOUBLE THEN 'low_grounding_score' WHEN confidence < 0.7::DOUBLE THEN 'low_confidence'
  WHEN generation IS NULL THEN 'candidate_normalized_confidence_missing' WHEN generation < 0.5 THEN 'low_candidate_normalized_confidence' WHEN confidence >= 0.85::DOUBLE AND bucket = 'head' THEN 'head_item_overconfidence'
  WHEN confidence >= 0.85::DOUBLE AND coalesce(alignment, 0) >= 0.8::DOUBLE THEN 'echo_risk' ELSE 'confidence_and_grounding_pass' END"""


@query("policy_decisions", f"{CONF}, d AS (SELECT example_id, {_DECIDE} AS reason FROM conf) SELECT example_id, reason, CASE WHEN reason IN ('head_item_overconfidence', 'echo_risk') THEN 'rerank' WHEN reason = 'confidence_and_grounding_pass' THEN 'accept' ELSE 'fallback' END AS decision FROM d")
def policy_decisions(spark, sf_dir):
    return _policy_rows(spark, sf_dir).select("example_id", policy.decision().alias("d")).select("example_id", "d.reason", "d.decision")


@query("policy_grid", f"""{CONF}, g AS (SELECT a, n, confidence >= a AND coalesce(generation, 0) >= n AS take, correct, {_h("fb", 100)} < 30 AS fb FROM conf, (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) x(a), (VALUES (0.0::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) y(n))
  SELECT a AS accept, n AS normal, avg(CAST(CASE WHEN take THEN correct = 1 ELSE fb END AS INTEGER)) AS hit_rate, avg(CAST(take AS INTEGER)) AS override_rate FROM g GROUP BY ALL""")
def policy_grid(spark, sf_dir):
    r = _policy_rows(spark, sf_dir).select("confidence", "normalized", F.col("correct").alias("own_hit"), F.when(mock.draw("fb", 100) < 30, 1).otherwise(0).alias("fallback_hit"))
    return policy.grid_replay(r, [0.5, 0.6, 0.7, 0.8, 0.9], [0.0, 0.3, 0.5, 0.7])


@query("override_outcomes", f"""{CONF}, d AS (SELECT bucket, {_h("nb", 3)} / CAST(2 AS DOUBLE) AS before, {_h("na", 3)} / CAST(2 AS DOUBLE) AS after FROM conf) SELECT bucket, count(*) FILTER (after > before) AS beneficial, count(*) FILTER (after < before) AS harmful,
  count(*) FILTER (after = before) AS neutral, avg(CASE WHEN after < before THEN 1.0::DOUBLE ELSE 0 END) AS harmful_rate FROM d GROUP BY bucket""")
def override_outcomes(spark, sf_dir):
    r = rows(spark, sf_dir).select("bucket", (mock.draw("nb", 3) / F.lit(2.0)).alias("ndcg_before"), (mock.draw("na", 3) / F.lit(2.0)).alias("ndcg_after"))
    return policy.override_outcomes(r, ["bucket"])


@query("paired_t", f"{CONF}, d AS (SELECT bucket, {_share('t1')} - {_share('t2')} AS d FROM conf) SELECT bucket, avg(d) AS mean, stddev_samp(d) AS sd, count(*) AS n, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM d GROUP BY bucket")
def paired_t(spark, sf_dir):
    return calibration.paired_t(rows(spark, sf_dir).select("bucket", mock.share("t1").alias("challenger"), mock.share("t2").alias("baseline")), ["bucket"])


@query("paired_bootstrap")
def paired_bootstrap(spark, sf_dir):
    return calibration.bootstrap_difference(rows(spark, sf_dir).select(F.col("example_id").alias("key"), mock.share("t1").alias("challenger"), mock.share("t2").alias("baseline")))


def _panel(spark, sf_dir) -> DataFrame:
    """Ten best candidates by moves as the panel, with preference from popularity order's hash."""
    order = W.partitionBy("example_id").orderBy(F.desc(F.round("score", 9)), "item_id")
    r = scored(spark, sf_dir, "markov").withColumn("place", F.row_number().over(order)).where("popularity is not null")
    one = F.conv(F.substring(F.sha2(F.concat_ws(":", "example_id", "item_id"), 256), 1, 8), 16, 10).cast("long")
    return r.select("example_id", "item_id", "target", "place", F.round("score", 9).alias("fallback_score"), "popularity", ((one % 101) / F.lit(100.0)).alias("preference"), ((one % 11) / F.lit(10.0)).alias("confidence"))


PANEL = f"""{CAND}, {MOVES}, s AS ({MARKOV_SCORE}), q AS (SELECT s.example_id, s.item_id, t.target, row_number() OVER (PARTITION BY s.example_id ORDER BY round(score, 9) DESC, s.item_id) AS place, round(score, 9) AS fallback_score, popularity,
  CAST(('0x' || substr(sha256(s.example_id || ':' || s.item_id), 1, 8)) AS BIGINT) AS h FROM s JOIN test t USING (example_id) JOIN pops ON pops.item_id = s.item_id),
panel AS (SELECT *, h % 101 / CAST(100 AS DOUBLE) AS preference, h % 11 / CAST(10 AS DOUBLE) AS confidence FROM q)"""


def _mm(c: str) -> str:
    return f"CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0 END"


_FUSED = f"""f AS (SELECT example_id, item_id, place, 0.5::DOUBLE * {_mm("fallback_score")} + 0.3::DOUBLE * {_mm("preference")} + 0.1::DOUBLE * confidence - 0.1::DOUBLE * {_mm("ln(1 + popularity)")} AS fusion FROM panel WHERE place <= 10 WINDOW w AS (PARTITION BY example_id)),
ff AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY round(fusion, 9) DESC, item_id) AS fused FROM f)"""


@query("fusion_order", f"{PANEL}, {_FUSED} SELECT example_id, item_id, fusion, CAST(fused AS INTEGER) AS fused FROM ff")
def fusion_order(spark, sf_dir):
    return policy.fused(_panel(spark, sf_dir).where("place <= 10")).select("example_id", "item_id", "fusion", F.col("place").alias("fused"))


def _once(sql: str) -> str:
    """The parts that are read several times are made once."""
    for name in ("ex", "cand", "panel", "ff"):
        sql = sql.replace(f"{name} AS (", f"{name} AS MATERIALIZED (", 1)
    return sql


@query("merged_order", _once(f"{PANEL}, {_FUSED}") + """, o AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY fused) AS slot FROM ff), p AS (SELECT example_id, place, row_number() OVER (PARTITION BY example_id ORDER BY place) AS slot FROM ff)
  SELECT o.example_id, o.item_id, CAST(p.place AS INTEGER) AS place FROM o JOIN p USING (example_id, slot) UNION ALL SELECT example_id, item_id, CAST(place AS INTEGER) FROM panel WHERE place > 10""")
def merged_order(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    order = policy.fused(panel.where("place <= 10")).select("example_id", "item_id", F.col("place").alias("fused"))
    return policy.merged_order(panel.join(order, ["example_id", "item_id"], "left"))


@query("confident_margin", f"""{PANEL}, l AS (SELECT *, coalesce(lead(preference) OVER w, 0) AS nxt, row_number() OVER w AS k FROM panel WINDOW w AS (PARTITION BY example_id ORDER BY preference DESC, item_id))
  SELECT example_id, item_id, preference - nxt >= 0.05::DOUBLE AND confidence >= 0.5 AS trusted FROM l WHERE k = 1""")
def confident_margin(spark, sf_dir):
    return policy.confident_margin(_panel(spark, sf_dir), 0.05, 0.5).select("example_id", "item_id", "trusted")


@query("oracle_rank", f"""{PANEL} SELECT example_id, CAST(max(place) FILTER (item_id = target) AS INTEGER) AS rank, CAST(CASE WHEN max(CASE WHEN item_id = target AND place <= 10 THEN 1 ELSE 0 END) = 1 THEN 1 ELSE max(place) FILTER (item_id = target) END AS INTEGER) AS oracle_rank FROM panel GROUP BY example_id""")
def oracle_rank(spark, sf_dir):
    return policy.oracle_rank(_panel(spark, sf_dir).withColumn("in_panel", F.col("place") <= 10))


def _evidence(spark, sf_dir, digits=4) -> DataFrame:
    items = views.items(spark, sf_dir)
    rows = test_candidates(spark, sf_dir).select("example_id", "target", "item_id")
    named = rows.join(buckets(spark, sf_dir).select("item_id", "bucket"), "item_id").join(items.select("item_id", "title"), "item_id")
    return evidence.evidence(evidence.repetition(named, items, test_examples(spark, sf_dir)), digits)


_TOK = "list_distinct(list_filter(string_split_regex(regexp_replace(lower(title), '[|/]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2))"
EVID = f"""{CAND}, {BUCKET}, it AS (SELECT item_id, lower(category) AS c, lower(brand) AS br, {_TOK} AS t FROM items), hh AS (SELECT example_id, unnest(history[greatest(len(history) - 50, 0) + 1:]) AS h FROM test),
m AS (SELECT x.example_id, x.item_id, avg(CASE WHEN a.c = z.c THEN 0.55::DOUBLE ELSE 0 END + CASE WHEN a.br = z.br THEN 0.25::DOUBLE ELSE 0 END + least(0.2::DOUBLE, 0.04::DOUBLE * len(list_intersect(a.t, z.t)))) AS m FROM cand x JOIN hh USING (example_id) JOIN it a ON a.item_id = x.item_id JOIN it z ON z.item_id = h GROUP BY ALL),
e0 AS (SELECT x.example_id, x.item_id, x.item_id = t.target AS pos, bucket, CASE WHEN list_contains(t.history, x.item_id) THEN 1 ELSE least(1, coalesce(m, 0)) END AS hr, CASE bucket WHEN 'head' THEN 0.7::DOUBLE WHEN 'mid' THEN 0.35::DOUBLE ELSE 0.12::DOUBLE END AS pr, 0.05::DOUBLE AS g
  FROM cand x JOIN test t USING (example_id) JOIN b ON b.item_id = x.item_id LEFT JOIN m ON m.example_id = x.example_id AND m.item_id = x.item_id),
e1 AS (SELECT *, CASE WHEN pos THEN least(1, greatest(0, 0.66::DOUBLE + 0.2::DOUBLE * (1 - g) + 0.14::DOUBLE * hr - 0.06::DOUBLE * pr)) ELSE least(0.75, greatest(0, 0.08::DOUBLE + 0.24::DOUBLE * hr + 0.18::DOUBLE * pr + 0.05::DOUBLE * (1 - g))) END AS pf FROM e0),
ev AS (SELECT example_id, item_id, pos, bucket, g, pr, hr, CAST(pf AS DOUBLE) AS preference, CAST(CASE WHEN pos THEN least(0.95::DOUBLE, greatest(0.5, pf - 0.08::DOUBLE * g - CASE WHEN bucket = 'tail' THEN 0.04::DOUBLE ELSE 0 END)) ELSE least(0.7::DOUBLE, greatest(0.03::DOUBLE, pf)) END AS DOUBLE) AS confidence,
  CASE WHEN pos THEN 'positive_next_item' WHEN hr >= 0.45::DOUBLE THEN 'history_echo_probe' WHEN bucket = 'head' THEN 'head_bias_probe' WHEN bucket = 'tail' THEN 'tail_underconfidence_probe' ELSE 'mid_popularity_probe' END AS role FROM e1)"""


@query("candidate_evidence", f"{EVID} SELECT example_id, item_id, role, preference, confidence FROM ev")
def candidate_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir, None).select("example_id", "item_id", "role", "preference", "confidence")


_ROLE_PLACE = "CASE role WHEN 'history_echo_probe' THEN 1 WHEN 'head_bias_probe' THEN 2 WHEN 'tail_underconfidence_probe' THEN 3 WHEN 'mid_popularity_probe' THEN 4 ELSE 5 END"


@query("stratified_negatives", f"""{EVID}, n AS (SELECT example_id, item_id, role, count(*) OVER (PARTITION BY example_id) <= 6 AS few, row_number() OVER (PARTITION BY example_id, role ORDER BY sha256(example_id || ':' || role || ':' || item_id), item_id) = 1 AS is_first FROM ev WHERE NOT pos)
  SELECT example_id, item_id, role, CAST(row_number() OVER w AS INTEGER) AS place FROM n WINDOW w AS (PARTITION BY example_id ORDER BY CASE WHEN few THEN 0 WHEN is_first THEN {_ROLE_PLACE} ELSE 99 END,
    CASE WHEN few THEN item_id ELSE sha256(example_id || ':fill:' || item_id) END, item_id) QUALIFY row_number() OVER w <= 6""")
def stratified_negatives(spark, sf_dir):
    rows = _evidence(spark, sf_dir, None).where("item_id != target").select("example_id", "item_id", "role")
    return candidates.stratified(rows, 6)


@query("policy_targets")
def policy_targets(spark, sf_dir):
    r = evidence.policy_targets(_evidence(spark, sf_dir))
    return r.select("example_id", "item_id", "action", "normalized", "residual", "calibrated", "harm", "abstain")
