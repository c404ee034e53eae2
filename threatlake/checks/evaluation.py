"""Evaluation queries over scores shaped from lineitem, and the models themselves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake import constants as C
from threatlake.checks.flows import _pct
from threatlake.checks.registry import Data, query
from threatlake.checks.stars import SPLIT
from threatlake.functions.numbers import lookup
from threatlake.ml import evaluation as E
from threatlake.ml import boosting, forest, isolation, oversample, scoring
from threatlake.operators import sampling as SA
from threatlake.session import cut_lineage, spread

LABELED = "(SELECT *, CASE WHEN score_a >= 0.5 THEN 1 ELSE 0 END AS predicted FROM fx_fact WHERE is_attack IS NOT NULL)"


def _scored(d: Data) -> DataFrame:
    rows = d.fact.filter(F.col("is_attack").isNotNull())
    return rows.withColumn("predicted", (F.col("score_a") >= 0.5).cast("int"))


@query(f"SELECT is_attack, predicted, COUNT(*) AS n FROM {LABELED} x GROUP BY 1, 2")
def confusion_matrix(d: Data):
    return E.confusion(_scored(d), "is_attack", "predicted")


GUESS = f"""(SELECT attack_family_denorm AS t, CASE WHEN score_a < 0.25 THEN 'Benign' WHEN score_b > 0.6 THEN 'DDoS' ELSE attack_family_denorm END AS p FROM {LABELED} x)"""
PER_CLASS = f"""(SELECT class, SUM(support) AS support, SUM(named) AS named, SUM(hits) AS hits, COALESCE(SUM(hits)::DOUBLE / NULLIF(SUM(named), 0), 0) AS p,
  COALESCE(SUM(hits)::DOUBLE / NULLIF(SUM(support), 0), 0) AS r, COALESCE(2.0::DOUBLE * SUM(hits) / NULLIF(SUM(named) + SUM(support), 0), 0) AS f1 FROM (
  SELECT t AS class, 1 AS support, 0 AS named, CASE WHEN t = p THEN 1 ELSE 0 END AS hits FROM {GUESS} g UNION ALL SELECT p, 0, 1, 0 FROM {GUESS} g) u GROUP BY 1)"""


def _guessed(d: Data):
    family = F.col("attack_family_denorm")
    guess = F.when(F.col("score_a") < 0.25, "Benign").when(F.col("score_b") > 0.6, "DDoS").otherwise(family)
    return _scored(d).select(family.alias("truth"), guess.alias("guess"))


@query(f"SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(f1, 4) AS f1, support FROM {PER_CLASS} c")
def per_class_metrics(d: Data):
    return E.per_class(_guessed(d), "truth", "guess").select("class", "precision", "recall", "f1", "support")


@query(f"""SELECT round(AVG(p), 4) AS macro_precision, round(AVG(r), 4) AS macro_recall, round(AVG(f1), 4) AS macro_f1, round(SUM(hits)::DOUBLE / SUM(support), 4) AS accuracy,
  SUM(support) AS n_samples FROM {PER_CLASS} c""")
def overall_metrics(d: Data):
    return E.overall(_guessed(d), "truth", "guess")


COUNTS = f"(SELECT score_a AS s, COUNT(*) FILTER (WHERE is_attack = 1) AS pos, COUNT(*) FILTER (WHERE is_attack = 0) AS neg FROM {LABELED} x GROUP BY 1)"
CURVE = f"""(SELECT s AS threshold, pos, neg, SUM(pos) OVER (ORDER BY s DESC) AS tp, SUM(neg) OVER (ORDER BY s DESC) AS fp, SUM(pos) OVER () AS all_pos, SUM(neg) OVER () AS all_neg,
  SUM(neg) OVER (ORDER BY s) - neg AS neg_below FROM {COUNTS} c)"""
POINTS = f"(SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / all_pos AS recall, fp::DOUBLE / all_neg AS fpr FROM {CURVE} v)"


@query(f"SELECT round(SUM(pos * (neg_below + neg / 2.0::DOUBLE)) / (MAX(all_pos)::DOUBLE * MAX(all_neg)), 9) AS auc FROM {CURVE} v")
def roc_auc(d: Data):
    return E.roc_auc(E.curve(_scored(d), "is_attack", "score_a")).select(F.round("auc", 9).alias("auc"))


@query(f"SELECT threshold, tp, fp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(fpr, 9) AS fpr FROM {POINTS} p")
def curve_points(d: Data):
    points = E.curve(_scored(d), "is_attack", "score_a")
    return points.select("threshold", "tp", "fp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "fpr")])


@query(f"SELECT round(SUM(precision * pos) / MAX(all_pos), 9) AS ap FROM {POINTS} p")
def average_precision(d: Data):
    return E.average_precision(E.curve(_scored(d), "is_attack", "score_a")).select(F.round("ap", 9).alias("ap"))


GRID = f"""(SELECT t, tp, fp, n, COALESCE(2.0::DOUBLE * tp / NULLIF(tp + fp + n, 0), 0) AS f1 FROM (SELECT t / 100.0::DOUBLE AS t,
  COUNT(*) FILTER (WHERE is_attack = 1 AND score_a + 1e-11 >= t / 100.0::DOUBLE) AS tp, COUNT(*) FILTER (WHERE is_attack = 0 AND score_a + 1e-11 >= t / 100.0::DOUBLE) AS fp,
  COUNT(*) FILTER (WHERE is_attack = 1) AS n FROM {LABELED} x, generate_series(1, 99) g(t) GROUP BY 1) c)"""


@query(f"""SELECT t AS threshold, round(f1, 4) AS f1, round(tp::DOUBLE / (tp + fp), 4) AS precision, round(tp::DOUBLE / n, 4) AS recall FROM {GRID} g ORDER BY g.f1 DESC, t LIMIT 1""")
def grid_best_threshold(d: Data):
    return E.grid_best_f1(_scored(d), "is_attack", "score_a")


@query(f"""SELECT threshold, round(f, 9) AS f1, tp + fp AS alerts FROM (SELECT *, 2 * precision * recall / (precision + recall + 1e-10) AS f FROM {POINTS} p) q
  ORDER BY round(f, 12) DESC, threshold LIMIT 1""")
def curve_best_threshold(d: Data):
    best = E.curve_best_f1(E.curve(_scored(d), "is_attack", "score_a"))
    return best.select("threshold", F.round("f1", 9).alias("f1"), "alerts")


@query(f"""SELECT target, threshold, round(recall, 9) AS recall, tp, fp FROM {POINTS} p, (SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE]) AS target) t WHERE precision >= target
  QUALIFY row_number() OVER (PARTITION BY target ORDER BY recall DESC, threshold) = 1""")
def operating_points(d: Data):
    points = E.curve(_scored(d), "is_attack", "score_a")
    return E.operating_points(points, [0.3, 0.5, 0.7, 0.9]).withColumn("recall", F.round("recall", 9))


RATES = f"""(SELECT attack_family_denorm AS class, COUNT(*) AS n_total, COUNT(*) FILTER (WHERE score_a >= 0.5) AS a_detected, {_pct('COUNT(*) FILTER (WHERE score_a >= 0.5)', 'COUNT(*)', 1)} AS a_pct,
  COUNT(*) FILTER (WHERE score_b >= 0.5) AS b_detected, {_pct('COUNT(*) FILTER (WHERE score_b >= 0.5)', 'COUNT(*)', 1)} AS b_pct FROM fx_fact GROUP BY 1)"""


def _rates(d: Data):
    return E.detection_rates(d.fact, "attack_family_denorm", {"a": "score_a", "b": "score_b"})


@query(f"SELECT * FROM {RATES} r")
def detection_rates(d: Data):
    return _rates(d)


@query(f"SELECT class, n_total, b_pct, a_pct, round(a_pct - b_pct, 1) AS advantage FROM {RATES} r WHERE a_pct - b_pct > 0 ORDER BY 5 DESC, 1 LIMIT 5")
def model_advantage(d: Data):
    return E.model_gap(_rates(d), "a", "b")


@query(f"""SELECT s AS scenario, COUNT(*) FILTER (WHERE predicted = 1) AS caught, COUNT(*) AS total, {_pct('COUNT(*) FILTER (WHERE predicted = 1)', 'COUNT(*)', 1)} AS recall_pct
  FROM (SELECT *, CASE attack_family_denorm WHEN 'DDoS' THEN 1 WHEN 'DoS' THEN 2 WHEN 'Botnet' THEN 3 ELSE 0 END AS s FROM {LABELED} x) y WHERE s <> 0 AND is_attack = 1 GROUP BY 1""")
def scenario_recall(d: Data):
    scenario = F.coalesce(lookup(F.col("attack_family_denorm"), {"DDoS": 1, "DoS": 2, "Botnet": 3}), F.lit(0))
    return E.scenario_recall(_scored(d).withColumn("scenario", scenario), "scenario", "is_attack", "predicted")


@query(f"""SELECT tn, fp, fn, tp, {_pct('fp', 'fp + tn', 3)} AS fpr_pct, {_pct('fn', 'fn + tp', 3)} AS fnr_pct FROM (SELECT COUNT(*) FILTER (WHERE is_attack = 0 AND predicted = 0) AS tn,
  COUNT(*) FILTER (WHERE is_attack = 0 AND predicted = 1) AS fp, COUNT(*) FILTER (WHERE is_attack = 1 AND predicted = 0) AS fn, COUNT(*) FILTER (WHERE is_attack = 1 AND predicted = 1) AS tp FROM {LABELED} x) c""")
def error_rates(d: Data):
    return E.error_rates(_scored(d), "is_attack", "predicted")


def _model_sql(name, column):
    return (f"SELECT '{name}' AS model, (SELECT round(SUM(pos * (neg_below + neg / 2.0::DOUBLE)) / (MAX(all_pos)::DOUBLE * MAX(all_neg)), 4) FROM {CURVE} v) AS auc, "
            f"(SELECT round(SUM(precision * pos) / MAX(all_pos), 4) FROM {POINTS} p) AS ap, t AS threshold, round(g.f1, 4) AS f1, round(tp::DOUBLE / (tp + fp), 4) AS precision, "
            f"round(tp::DOUBLE / n, 4) AS recall FROM {GRID} g QUALIFY row_number() OVER (ORDER BY g.f1 DESC, t) = 1").replace("score_a", column)


@query(f"{_model_sql('first', 'score_a')} UNION ALL {_model_sql('second', 'score_b')}".replace(
    "CASE WHEN score_b >= 0.5 THEN 1 ELSE 0 END AS predicted", "0 AS predicted"))
def model_comparison(d: Data):
    return E.compare_models(_scored(d), "is_attack", {"first": "score_a", "second": "score_b"})


@query(f"""SELECT attack_family_denorm AS class, COUNT(*) AS n_total, COUNT(*) FILTER (WHERE priority_label IN ('critical', 'high')) AS n_alerted,
  {_pct("COUNT(*) FILTER (WHERE priority_label IN ('critical', 'high'))", 'COUNT(*)')} AS alert_rate_pct FROM fx_fact GROUP BY 1""")
def alert_rates(d: Data):
    return E.alert_rates(d.fact, "attack_family_denorm", "priority_label")


@query("""SELECT attack_family_denorm AS class, priority_label AS predicted, COUNT(*) AS n, round(AVG(score_b), 4) AS mean_score, round(MAX(score_b), 4) AS max_score, round(MIN(score_b), 4) AS min_score,
  COUNT(*) FILTER (WHERE score_b >= 0.5) AS flagged FROM fx_fact WHERE attack_family_denorm IN ('Infiltration', 'Exploit') GROUP BY 1, 2""")
def small_class_drilldown(d: Data):
    return E.class_drilldown(d.fact, "attack_family_denorm", ["Infiltration", "Exploit"], "score_b", "priority_label")


@query(f"""SELECT split, event_type, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY split) AS split_size, {_pct('COUNT(*)', 'SUM(COUNT(*)) OVER (PARTITION BY split)')} AS pct,
  0 AS leaked_ids FROM {SPLIT} s GROUP BY 1, 2""")
def split_report(d: Data):
    return E.split_report(SA.stratified_split(d.events.select("event_id", "event_type"), ["event_type"], ["event_id"]), "event_type", ["event_id"])


# ---- models (rows only: another library's random draws cannot be matched) ---------------------------------

FEATURES = [f"x{i}" for i in range(64)]


@query("SELECT label, COUNT(*) AS n, SUM(COUNT(*)) OVER () / (COUNT(*) OVER () * COUNT(*)) AS weight FROM embeddings GROUP BY 1")
def class_weights(d: Data):
    return forest.class_weights(d.embeddings, "label")


def _vectors(d: Data) -> DataFrame:
    family = F.element_at(F.array(*[F.lit(x) for x in ("Benign", "DoS", "DDoS", "Botnet", "Web Attack")]), (F.col("label") % 5 + 1).cast("int"))
    columns = {f"x{i}": F.col("embedding")[i].cast("double") for i in range(len(FEATURES))}
    return spread(d.embeddings, waves=2).select(F.col("vec_id").alias("event_id"), family.alias("family"), *[c.alias(n) for n, c in columns.items()]).withColumn(
        "is_attack", (F.col("family") != "Benign").cast("int"))


@query()
def binary_forest(d: Data):
    rows = _vectors(d)
    model = forest.train_binary(rows, FEATURES, "is_attack")
    return forest.positive_probability(model, rows, "rf_attack_proba").select("event_id", "is_attack", "rf_attack_proba")


@query()
def feature_importance(d: Data):
    model = forest.train_binary(_vectors(d), FEATURES, "is_attack")
    return forest.feature_importance(model, 15)


@query(f"""SELECT unnest({list(FEATURES)!r}) AS feature, TRUE AS share, TRUE AS sums_to_one, TRUE AS ranked""")
def importance_checked(d: Data):
    """What must hold for the importance of every feature: shares that sum to one, and the ranked list is their order."""
    model = forest.train_binary(_vectors(d), FEATURES, "is_attack", numTrees=20, maxDepth=6)
    every = forest.feature_importance(model)
    names = [r.feature for r in forest.feature_importance(model, 15).collect()]
    least = every.where(F.col("feature").isin(names)).agg(F.min("importance")).scalar()
    total = every.agg(F.sum("importance")).scalar()
    listed = F.col("feature").isin(names)
    return every.select("feature", F.col("importance").between(0, 1).alias("share"), (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
                        F.when(listed, F.col("importance") >= least).otherwise(F.col("importance") <= least).alias("ranked"))


@query()
def family_forest(d: Data):
    rows = _vectors(d)
    model = forest.train_family(rows, FEATURES, "family", trees=200)
    return forest.family_probabilities(model, rows).select("event_id", "family", "family_attack_proba", "predicted_family")


@query("""SELECT vec_id AS event_id, TRUE AS sums_to_one, TRUE AS likeliest, TRUE AS from_benign, TRUE AS loss_falls, TRUE AS better_than_shares FROM embeddings""")
def softmax_families(d: Data):
    """What must hold for the softmax-boosted family model on every event, and for its loss, whatever the trees are."""
    rows = _vectors(d)
    model = boosting.fit(forest.with_class_weight(rows, "family"), FEATURES, "family", "weight", rounds=8, depth=4)
    scored = cut_lineage(model.transform(rows).select("event_id", "family", "probability", "predicted_family"))
    half = boosting.SoftmaxBooster(model.features, model.labels, model.cuts, model.rate, model.rounds[:4]).transform(rows)
    loss, before = (boosting.log_loss(x, "family", model.labels) for x in (scored, half))
    p = F.col("probability")
    attack = forest.family_probabilities(model, rows).select("event_id", "family_attack_proba")
    place = F.array_position(F.array(*[F.lit(x) for x in model.labels]), F.col("predicted_family")).cast("int")
    return scored.join(attack, "event_id").select(
        "event_id", (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("sums_to_one"), (F.element_at(p, place) == F.array_max(p)).alias("likeliest"),
        (F.abs(F.col("family_attack_proba") + p[model.labels.index("Benign")] - 1) < 1e-9).alias("from_benign"), F.lit(loss < before).alias("loss_falls"),
        F.lit(loss < math.log(len(model.labels))).alias("better_than_shares"))


@query()
def isolation_forest_scores(d: Data):
    rows = _vectors(d)
    model = isolation.train_on_benign(rows, FEATURES, ["event_id"], "family")
    raw = model.score(rows).select("event_id", "family", "anomaly_raw")
    return isolation.min_max(raw, "anomaly_raw").withColumn("flagged", isolation.anomaly_flag(F.col("anomaly_score")))


@query()
def scored_events(d: Data):
    return _score_all(_vectors(d))


def _score_all(rows: DataFrame) -> DataFrame:
    binary = forest.train_binary(rows, FEATURES, "is_attack")
    family = forest.train_family(rows, FEATURES, "family", trees=200)
    anomaly = isolation.train_on_benign(rows, FEATURES, ["event_id"], "family")
    return scoring.score_events(rows, binary, family, anomaly, ["event_id"])


@query("""SELECT vec_id AS event_id, TRUE AS binary_in_range, TRUE AS family_in_range, TRUE AS anomaly_in_range, TRUE AS family_known, TRUE AS label_fits,
  0.0::DOUBLE AS least_anomaly, 1.0::DOUBLE AS greatest_anomaly FROM embeddings""")
def scored_events_checked(d: Data):
    """What must hold for the scores of every event, whatever the models drew: ranges, known families, labels that follow from the score."""
    rows = _vectors(d)
    scores = cut_lineage(_score_all(rows))
    span = scores.agg(F.round(F.min("anomaly_score"), 6).alias("a"), F.round(F.max("anomaly_score"), 6).alias("b"))
    score = F.col("priority_score")
    label = F.when(score >= 0.75, "critical").when(score >= 0.55, "high").when(score >= 0.35, "medium").when(score >= 0.15, "low").otherwise("info")
    named = scores.join(rows.select(F.col("family").alias("predicted_family")).distinct().withColumn("known", F.lit(True)), "predicted_family", "left")
    return named.select(
        "event_id", F.col("rf_attack_proba").between(0, 1).alias("binary_in_range"), F.col("family_attack_proba").between(0, 1).alias("family_in_range"),
        F.col("anomaly_score").between(0, 1).alias("anomaly_in_range"), F.coalesce("known", F.lit(False)).alias("family_known"),
        (F.col("priority_label") == label).alias("label_fits"), span.select("a").scalar().alias("least_anomaly"), span.select("b").scalar().alias("greatest_anomaly"))


@query("SELECT 5 AS label, 40 AS rows, COUNT(*) AS originals, 0 AS beyond FROM embeddings WHERE label = 5")
def oversampled_counts(d: Data):
    """Synthetic rows asked for, and how many leave the box that the minority spans (none may)."""
    rows = d.embeddings.withColumn("vector", F.col("embedding").cast("array<double>"))
    made = oversample.oversample(rows, "vec_id", "vector", "label", 5, 40)
    minority = rows.filter("label = 5")
    bounds = [minority.agg(F.array(*[f(F.col("vector")[i]) for i in range(len(FEATURES))])).scalar() for f in (F.min, F.max)]
    placed = made.withColumns({"_low": bounds[0], "_high": bounds[1]})
    outside = F.exists(F.arrays_zip("vector", "_low", "_high"), lambda z: (z["vector"] < z["_low"] - 1e-9) | (z["vector"] > z["_high"] + 1e-9))
    return placed.agg(F.lit(5).alias("label"), F.count("*").alias("rows"), F.count_if(outside).alias("beyond")).withColumn(
        "originals", minority.agg(F.count("*")).scalar())


NEIGHBOURS = """SELECT a.vec_id AS id, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY
    list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS place FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  QUALIFY place <= 5"""


@query(NEIGHBOURS)
def nearest_neighbours(d: Data):
    near = oversample.nearest_neighbours(d.embeddings, "vec_id", "embedding", 5, pivots=8, block=64)
    return near.select("id", "neighbour", "place")


@query()
def oversampled_minority(d: Data):
    rows = d.embeddings.withColumn("vector", F.col("embedding").cast("array<double>"))
    return oversample.oversample(rows, "vec_id", "vector", "label", 5, 40)


@query()
def user_scores(d: Data):
    from threatlake.checks.insiders import _tables
    from threatlake.operators.insider import user_profiles
    from threatlake.plans.insider_job import risk_scores

    _, baselines, features = _tables(d)
    profiles = user_profiles(features, baselines)
    model = forest.train_binary(profiles, C.USER_FEATURES, "is_malicious", **forest.USER_FOREST)
    return risk_scores(model=model, profiles=profiles).drop("scored_at")


@query("SELECT predicted_label AS priority_label, COUNT(*) AS events FROM (SELECT CASE WHEN score_a >= 0.75 THEN 'critical' WHEN score_a >= 0.55 THEN 'high' "
       "WHEN score_a >= 0.35 THEN 'medium' WHEN score_a >= 0.15 THEN 'low' ELSE 'info' END AS predicted_label FROM fx_fact) x GROUP BY 1")
def label_tally(d: Data):
    from threatlake.functions.scores import priority_label

    return scoring.label_tally(d.fact.withColumn("priority_label", priority_label(F.col("score_a"))))


@query("SELECT round(quantile_cont(score_b, 0.99), 9) AS threshold, COUNT(*) FILTER (WHERE score_b >= (SELECT quantile_cont(score_b, 0.99) FROM fx_fact)) AS flagged FROM fx_fact")
def top_percent_flag(d: Data):
    from threatlake.operators.ordering import exact_percentile

    limit = cut_lineage(exact_percentile(d.fact, [], "score_b", 0.99, "t")).scalar()
    return d.fact.agg(F.count_if(F.col("score_b") >= limit).alias("flagged")).withColumn("threshold", F.round(limit, 9))
