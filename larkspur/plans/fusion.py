"""Queries on fusion grids and replay states."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import calibrator, fusion_grid, mock, popularity, replay
from larkspur.operators.rounds import checkpointed
from larkspur.plans.confidence import PANEL, _mm, _panel
from larkspur.plans.data import test_examples, train_popularity
from larkspur.plans.ranking import BUCKET, PRED, predicted

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def panels(spark, sf_dir) -> DataFrame:
    """Panels of the ten best candidates by moves; examples fall to three packs, and a tenth of the answers counts as not parsed, by the example's hash."""
    pack = mock.draw("pack", 3)
    rows = _panel(spark, sf_dir).withColumn("pack", F.when(pack == 0, "train").when(pack == 1, "validation").otherwise("test"))
    return fusion_grid.panels(rows.withColumn("in_panel", F.col("place") <= 10).withColumn("parsed", mock.draw("parsed", 10) > 0))


_DRAW = "CAST(('0x' || substr(sha256('{}:' || example_id), 1, 8)) AS BIGINT) % {}"
# every part that several others read is made once
_GRID = PANEL.replace("panel AS (", "panel AS MATERIALIZED (").replace("ex AS (", "ex AS MATERIALIZED (", 1) + f""", own AS (SELECT example_id, any_value(target) AS target, min(place) FILTER (item_id = target) AS own_place,
    any_value({_DRAW.format("pack", 3)}) AS pk, any_value({_DRAW.format("parsed", 10)}) > 0 AS parsed FROM panel GROUP BY example_id),
  pin AS MATERIALIZED (SELECT example_id, item_id, target, place, pk, {_mm("fallback_score")} AS fb, {_mm("preference")} AS pr, confidence AS conf, {_mm("ln(1 + popularity)")} AS pp, preference AS raw,
    row_number() OVER (PARTITION BY example_id ORDER BY place) AS slot, count(*) OVER w AS size FROM panel JOIN (SELECT example_id, pk, parsed FROM own) USING (example_id) WHERE place <= 10 AND parsed WINDOW w AS (PARTITION BY example_id)),
  gains AS (SELECT *, CASE WHEN place <= 10 THEN 1::DOUBLE / log2(place + 1) ELSE 0 END - CASE WHEN own_place <= 10 THEN 1::DOUBLE / log2(own_place + 1) ELSE 0 END AS d, CASE WHEN place <= 10 THEN 1::DOUBLE / log2(place + 1) ELSE 0 END AS nd FROM moved),
  per AS (SELECT {{names}}, round(coalesce(avg(nd) FILTER (pk = 0), 0), 9) AS train_ndcg, round(coalesce(avg(nd) FILTER (pk = 1), 0), 9) AS validation_ndcg, round(coalesce(avg(CASE WHEN d < -1e-14::DOUBLE THEN 1::DOUBLE ELSE 0 END) FILTER (pk = 1), 0), 9) AS validation_harmful_rate FROM gains GROUP BY ALL),
  picked AS (SELECT *, validation_harmful_rate <= 0.05::DOUBLE AS constraint_met, row_number() OVER (ORDER BY validation_harmful_rate <= 0.05::DOUBLE DESC, validation_ndcg DESC, validation_harmful_rate, {{names}}) = 1 AS selected FROM per)"""
_WEIGHTS = _GRID.replace("gains AS (", """grid AS (SELECT a.v::DOUBLE AS alpha, b.v::DOUBLE AS beta, g.v::DOUBLE AS gamma, l.v::DOUBLE AS penalty FROM (VALUES (0.5), (0.7), (0.9), (1.0)) a(v), (VALUES (0.1), (0.3), (0.5), (0.7)) b(v), (VALUES (0.0), (0.1), (0.2)) g(v), (VALUES (0.0), (0.05), (0.1)) l(v)),
  fus AS (SELECT pin.*, alpha, beta, gamma, penalty, round(alpha * fb + beta * pr + gamma * conf - penalty * pp, 9) AS f FROM pin, grid),
  spot AS (SELECT example_id, alpha, beta, gamma, penalty, item_id, target, row_number() OVER (PARTITION BY example_id, alpha, beta, gamma, penalty ORDER BY f DESC, item_id) AS slot FROM fus),
  hit AS (SELECT spot.example_id, alpha, beta, gamma, penalty, pin.place FROM spot JOIN pin ON pin.example_id = spot.example_id AND pin.slot = spot.slot WHERE spot.item_id = spot.target),
  moved AS (SELECT own.example_id, own.pk, own.own_place, grid.alpha, grid.beta, grid.gamma, grid.penalty, coalesce(hit.place, own.own_place) AS place FROM own CROSS JOIN grid
    LEFT JOIN hit ON hit.example_id = own.example_id AND hit.alpha = grid.alpha AND hit.beta = grid.beta AND hit.gamma = grid.gamma AND hit.penalty = grid.penalty),
  gains AS (""").replace("{names}", "alpha, beta, gamma, penalty")
_GATES = _GRID.replace("gains AS (", """grid AS (SELECT m.v::DOUBLE AS margin, c.v::DOUBLE AS confidence_min FROM (VALUES (0.0), (0.03), (0.05), (0.08), (0.1)) m(v), (VALUES (0.5), (0.55), (0.6), (0.65), (0.7)) c(v)),
  byp AS (SELECT *, row_number() OVER w AS k, round(raw - lead(raw) OVER w, 9) AS lead FROM pin WINDOW w AS (PARTITION BY example_id ORDER BY raw DESC, item_id)),
  lead AS (SELECT example_id, lead, conf AS sure FROM byp WHERE k = 1),
  free AS (SELECT byp.example_id, pin.place FROM byp JOIN pin ON pin.example_id = byp.example_id AND pin.slot = byp.k WHERE byp.item_id = byp.target),
  moved AS (SELECT own.example_id, own.pk, own.own_place, margin, confidence_min, CASE WHEN free.place IS NOT NULL AND lead >= margin AND sure >= confidence_min THEN free.place ELSE own.own_place END AS place
    FROM own CROSS JOIN grid LEFT JOIN free USING (example_id) LEFT JOIN lead USING (example_id)),
  gains AS (""").replace("{names}", "margin, confidence_min")
_REPLAY = """ SELECT {names}, constraint_met, count(*) AS n, avg(CASE WHEN place <= 10 THEN 1::DOUBLE ELSE 0 END) AS recall, avg(CASE WHEN place <= 10 THEN 1::DOUBLE / place ELSE 0 END) AS mrr, avg(nd) AS ndcg, avg(nd - d) AS fallback_ndcg,
  count(*) FILTER (d > 1e-14::DOUBLE) AS beneficial, count(*) FILTER (d < -1e-14::DOUBLE) AS harmful, count(*) FILTER (abs(d) <= 1e-14::DOUBLE) AS neutral, avg(CASE WHEN d < -1e-14::DOUBLE THEN 1::DOUBLE ELSE 0 END) AS harmful_rate
  FROM gains JOIN picked USING ({names}) WHERE selected AND pk = 2 GROUP BY ALL"""


@query("fusion_grid", _WEIGHTS + " SELECT * FROM picked")
def weights_grid(spark, sf_dir):
    return fusion_grid.select_point(fusion_grid.fused_places(panels(spark, sf_dir)), fusion_grid.WEIGHTS)


@query("fusion_replay", _WEIGHTS + _REPLAY.format(names="alpha, beta, gamma, penalty"))
def weights_replay(spark, sf_dir):
    rows = checkpointed(fusion_grid.fused_places(panels(spark, sf_dir)).select("pack", "own_place", "places"))
    return fusion_grid.replay(rows, fusion_grid.select_point(rows, fusion_grid.WEIGHTS), fusion_grid.WEIGHTS)


@query("gate_grid", _GATES + " SELECT * FROM picked")
def gates_grid(spark, sf_dir):
    return fusion_grid.select_point(fusion_grid.gated_places(panels(spark, sf_dir)), fusion_grid.GATES)


@query("gate_replay", _GATES + _REPLAY.format(names="margin, confidence_min"))
def gates_replay(spark, sf_dir):
    rows = checkpointed(fusion_grid.gated_places(panels(spark, sf_dir)).select("pack", "own_place", "places"))
    return fusion_grid.replay(rows, fusion_grid.select_point(rows, fusion_grid.GATES), fusion_grid.GATES)


def replay_rows(spark, sf_dir) -> DataFrame:
    """Ten best items of two rankers, with the share of the first score as confidence; seeds are five hash groups of examples."""
    found = predicted(spark, sf_dir).withColumn("r", F.nullif(F.array_position("predicted", F.col("target")), F.lit(0)))
    bucket = popularity.buckets_head_tail(popularity.ranked(train_popularity(spark, sf_dir))).select("item_id", "bucket")
    hit = F.col("r").isNotNull()
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    rows = found.select(
        "example_id", F.col("method").alias("variant"), mock.draw("seed", 5).cast("int").alias("seed"), "target", "predicted", (F.col("method") == "markov").alias("override"),
        hit.cast("double").alias("hit"), F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("mrr"), F.coalesce(1 / F.log2(F.col("r") + 1), F.lit(0.0)).alias("ndcg"),
        (F.size("predicted") > 0).alias("valid"), F.lit(False).alias("hallucinated"), F.round(F.try_divide(F.get("scores", F.lit(0)), total), 6).alias("confidence"), (F.get("predicted", F.lit(0)) == F.col("target")).alias("correct"),
    )
    seen = rows.select("example_id", "variant", F.explode("predicted").alias("item_id")).join(bucket, "item_id").groupBy("example_id", "variant", "bucket").agg(F.count("*").alias("c"))
    maps = seen.groupBy("example_id", "variant").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "c"))).alias("predicted_buckets"))
    return rows.join(maps, ["example_id", "variant"], "left").join(bucket.select(F.col("item_id").alias("target"), F.col("bucket").alias("target_bucket")), "target", "left")


_REPLAYED = PRED.replace("ex AS (", "ex AS MATERIALIZED (", 1).replace("top AS (", "top AS MATERIALIZED (") + f""", {BUCKET}, c AS (SELECT method, example_id, round(first(score ORDER BY k) / nullif(sum(score ORDER BY k), 0), 6) AS conf, first(item_id ORDER BY k) AS one FROM top GROUP BY ALL),
  rw AS (SELECT hit.method AS variant, CAST(('0x' || substr(sha256('seed:' || hit.example_id), 1, 8)) AS BIGINT) % 5 AS seed, hit.example_id, rank, bucket, conf, one = target AS correct FROM hit JOIN c USING (method, example_id) LEFT JOIN b ON b.item_id = target),
  bins AS (SELECT {{keys}}, least(9, floor(conf * 10)) AS i, count(*) AS n, abs(sum(correct::INT) - sum(conf)) AS gap FROM rw WHERE conf IS NOT NULL GROUP BY ALL), e AS (SELECT {{keys}}, sum(gap) / sum(n) AS ece FROM bins GROUP BY ALL),
  pb AS (SELECT {{keys}}, count(*) FILTER (b.bucket = 'tail') AS predicted_tail FROM top JOIN b USING (item_id) JOIN rw ON rw.example_id = top.example_id AND rw.variant = top.method GROUP BY ALL)
  SELECT {{keys}}, count(*) AS count, count(*) FILTER (variant = 'markov') AS override_count, count(*) FILTER (conf >= 0.85::DOUBLE AND NOT correct) AS high_confidence_wrong_count, count(*) FILTER (conf < 0.5::DOUBLE AND correct) AS low_confidence_correct_count,
  avg((variant = 'markov')::INT::DOUBLE) AS override_rate, avg((rank IS NOT NULL)::INT::DOUBLE) AS recall, avg(coalesce(1 / rank::DOUBLE, 0)) AS mrr, avg(coalesce(1::DOUBLE / log2(rank + 1), 0)) AS ndcg, avg(conf) AS mean_confidence, coalesce(any_value(ece), 0) AS ece,
  coalesce(avg((conf - correct::INT) ** 2), 0) AS brier, avg((rank IS NOT NULL)::INT::DOUBLE) FILTER (bucket = 'tail') AS tail_recall, avg((rank IS NOT NULL)::INT::DOUBLE) FILTER (bucket = 'head') AS head_recall, coalesce(any_value(predicted_tail), 0) AS predicted_tail
  FROM rw LEFT JOIN e USING ({{keys}}) LEFT JOIN pb USING ({{keys}}) GROUP BY {{keys}}"""


def _summary(states: DataFrame) -> DataFrame:
    tail = F.coalesce(F.col("predicted_bucket_counts")["tail"], F.lit(0.0)).cast("long").alias("predicted_tail")
    return replay.summary(states).select("*", tail).drop("validity_rate", "hallucination_rate", "target_bucket_counts", "predicted_bucket_counts")


@query("replay_by_seed", _REPLAYED.replace("{keys}", "seed, variant"))
def replay_by_seed(spark, sf_dir):
    return _summary(replay.partial_state(replay_rows(spark, sf_dir), ["seed", "variant"])).withColumn("seed", F.col("seed").cast("long"))


@query("replay_merged", _REPLAYED.replace("{keys}", "variant"))
def replay_merged(spark, sf_dir):
    """A state is written for each seed; the states are read again and merged."""
    states = checkpointed(replay.partial_state(replay_rows(spark, sf_dir), ["seed", "variant"]))
    return _summary(replay.merged_state(states, ["variant"]))


FEATURES = ["confidence", "place_in_fallback", "same_top", "own_popularity", "fallback_popularity", "history_length"]


def override_rows(spark, sf_dir) -> DataFrame:
    """The ranking by moves as a challenger of the one by popularity: features, ndcg of both, and which of them is better."""
    rows = replay_rows(spark, sf_dir)
    known = train_popularity(spark, sf_dir).select("item_id", F.log1p("popularity").alias("lp"))
    a = rows.where("variant = 'markov'").select("example_id", F.col("predicted").alias("own"), F.col("ndcg").alias("ndcg_after"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    b = rows.where("variant = 'popularity'").select("example_id", F.col("predicted").alias("fb"), F.col("ndcg").alias("ndcg_before"))
    both = a.join(b, "example_id").withColumn("one", F.get("own", F.lit(0))).withColumn("two", F.get("fb", F.lit(0)))
    both = both.join(known.select(F.col("item_id").alias("one"), F.col("lp").alias("own_popularity")), "one").join(known.select(F.col("item_id").alias("two"), F.col("lp").alias("fallback_popularity")), "two")
    length = test_examples(spark, sf_dir).select("example_id", F.size("history").cast("double").alias("history_length"))
    pack = mock.draw("pack", 3)
    d = F.col("ndcg_after") - F.col("ndcg_before")
    return both.join(length, "example_id").select(
        "example_id", F.when(pack == 0, "train").when(pack == 1, "validation").otherwise("test").alias("pack"), "confidence", "own_popularity", "fallback_popularity", "history_length",
        F.coalesce(F.nullif(F.array_position("fb", F.col("one")), F.lit(0)), F.lit(999)).cast("double").alias("place_in_fallback"), (F.col("one") == F.col("two")).cast("double").alias("same_top"),
        "ndcg_before", "ndcg_after", (d > 1e-14).cast("int").alias("improves"), (d < -1e-14).cast("int").alias("harms"),
    )


@query("override_replay")
def override_replay(spark, sf_dir):
    """Fitted on one third of the examples, thresholds from the second, replayed row by row on the last."""
    rows = checkpointed(override_rows(spark, sf_dir))
    pack = lambda name: rows.where(F.col("pack") == name)
    bundle = calibrator.fit_bundle(pack("train"), pack("validation"), FEATURES)
    grid = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5]
    point = calibrator.chosen_thresholds(bundle.predict(pack("validation")), grid, grid, 0.35, 5)
    return calibrator.replayed(bundle.predict(pack("test")), point).select(
        "example_id", F.round("p_improve", 6).alias("p_improve"), F.round("p_harm", 6).alias("p_harm"), "overrides", "ndcg"
    )
