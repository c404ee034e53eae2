"""Model evaluation as grouped aggregates; curves come from counts per distinct score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.functions.numbers import percent
from threatlake.functions.scores import is_alert
from threatlake.operators.filters import union_all
from threatlake.operators.ordering import join_on, running_totals


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, truth: str, predicted: str, places: int = 4) -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs on either side; zero where undefined."""
    cells = confusion(df, truth, predicted)
    sides = union_all([
        cells.select(F.col(truth).alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("named"),
                     F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hits")),
        cells.select(F.col(predicted).alias("class"), F.lit(0).cast("bigint").alias("support"),
                     F.col("n").alias("named"), F.lit(0).cast("bigint").alias("hits")),
    ])
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "named", "hits")])
    p, r = _rate(F.col("hits"), F.col("named")), _rate(F.col("hits"), F.col("support"))
    f1 = _rate(2.0 * F.col("hits"), F.col("named") + F.col("support"))
    return sums.select(
        "class", F.round(p, places).alias("precision"), F.round(r, places).alias("recall"),
        F.round(f1, places).alias("f1"), "support", "hits", p.alias("_p"), r.alias("_r"), f1.alias("_f"))


def overall(df: DataFrame, truth: str, predicted: str, places: int = 4) -> DataFrame:
    """Macro averages and accuracy."""
    rows = per_class(df, truth, predicted)
    return rows.agg(
        *[F.round(F.avg(c), places).alias(out) for c, out in
          (("_p", "macro_precision"), ("_r", "macro_recall"), ("_f", "macro_f1"))],
        F.round(_rate(F.sum("hits"), F.sum("support")), places).alias("accuracy"), F.sum("support").alias("n_samples"))


def score_counts(df: DataFrame, truth: str, score: str, models: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score (and model)."""
    keys = models or []
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))


def curve(df: DataFrame, truth: str, score: str, models: list[str] | None = None) -> DataFrame:
    """One point per distinct score used as threshold: tp, fp, precision, recall, fpr."""
    keys = models or []
    placed = running_totals(score_counts(df, truth, score, models), keys, "score", ["pos", "neg"])
    tp, fp = F.col("pos_total") - F.col("pos_below"), F.col("neg_total") - F.col("neg_below")
    return placed.select(
        *keys, F.col("score").alias("threshold"), "pos", "neg", "pos_total", "neg_total", "neg_below", tp.alias("tp"), fp.alias("fp"),
        _rate(tp, tp + fp).alias("precision"), _rate(tp, F.col("pos_total")).alias("recall"),
        _rate(fp, F.col("neg_total")).alias("fpr"))


def roc_auc(points: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Probability that a positive outscores a negative, ties counting half."""
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return points.groupBy(*(models or [])).agg(
        (wins / (F.max("pos_total").cast("double") * F.max("neg_total"))).alias("auc"))


def average_precision(points: DataFrame, models: list[str] | None = None) -> DataFrame:
    return points.groupBy(*(models or [])).agg(
        (F.sum(F.col("precision") * F.col("pos")) / F.max("pos_total")).alias("ap"))


def grid_best_f1(df: DataFrame, truth: str, score: str, models: list[str] | None = None) -> DataFrame:
    """Best F1 among thresholds .01, .02 ... .99; the smallest threshold wins ties.

    Scores fall into 100 steps first, so only 100 rows per model are cumulated.
    """
    from pyspark.sql import Window as W

    keys = models or []
    step = F.greatest(F.least(F.floor(F.col(score) * 100 + 1e-9), F.lit(99)), F.lit(0))
    steps = df.groupBy(*keys, step.alias("step")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    whole = steps.groupBy(*keys).agg(F.sum("pos").alias("all_pos"))
    grid = whole.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(99))))
    filled = join_on(grid, steps, [*keys, "step"], "left").fillna(0, ["pos", "neg"])
    # step 99 gathers every score from .99 on; steps are cumulated from the top
    above = W.partitionBy(*keys).orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)
    sums = filled.withColumns({"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above)})
    scored = sums.withColumns({
        "f1": _rate(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_pos")),
        "precision": _rate(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _rate(F.col("tp"), F.col("all_pos"))})
    best = scored.groupBy(*keys).agg(F.max_by(
        F.struct((F.col("step") / 100.0).alias("threshold"), "f1", "precision", "recall"),
        F.struct("f1", (-F.col("step")).alias("s"))).alias("_b"))
    return best.select(*keys, *[F.round(f"_b.{c}", 4).alias(c) for c in ("threshold", "f1", "precision", "recall")])


def curve_best_f1(points: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Threshold of the curve point with the best F1; the smallest threshold wins ties."""
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-10)
    best = points.groupBy(*(models or [])).agg(F.max_by(
        F.struct("threshold", f1.alias("f1"), "precision", "recall", (F.col("tp") + F.col("fp")).alias("alerts")),
        F.struct(F.round(f1, 12).alias("f"), (-F.col("threshold")).alias("t"))).alias("_b"))
    return best.select(*(models or []), "_b.*")


def operating_points(points: DataFrame, targets: list[float]) -> DataFrame:
    """Highest recall with at least the wanted precision, one row per reachable target."""
    rows = points.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets]))).filter(
        F.col("precision") >= F.col("target"))
    best = rows.groupBy("target").agg(F.max_by(
        F.struct("threshold", "recall", "tp", "fp"), F.struct("recall", (-F.col("threshold")).alias("t"))).alias("_b"))
    return best.select("target", "_b.*")


def detection_rates(df: DataFrame, family: str, scores: dict[str, str], threshold: float = 0.5, places: int = 1) -> DataFrame:
    """Rows of each class at or above the threshold, per score column."""
    parts = []
    for name, column in scores.items():
        hits = F.count_if(F.col(column) >= threshold)
        parts += [hits.alias(f"{name}_detected"), percent(hits, F.count("*"), places).alias(f"{name}_pct")]
    return df.groupBy(F.col(family).alias("class")).agg(F.count("*").alias("n_total"), *parts)


def model_gap(rates: DataFrame, strong: str, weak: str, limit: int | None = 5) -> DataFrame:
    """Classes that one model catches better than the other, largest gap first."""
    gap = F.round(F.col(f"{strong}_pct") - F.col(f"{weak}_pct"), 1)
    rows = rates.withColumn("advantage", gap).filter(F.col("advantage") > 0).select(
        "class", "n_total", f"{weak}_pct", f"{strong}_pct", "advantage").orderBy(F.desc("advantage"), "class")
    return rows.limit(limit) if limit else rows


def scenario_recall(df: DataFrame, scenario: str, truth: str, predicted: str) -> DataFrame:
    attack = df.filter((F.col(scenario) != 0) & (F.col(truth) == 1))
    caught = F.count_if(F.col(predicted) == 1)
    return attack.groupBy(scenario).agg(
        caught.alias("caught"), F.count("*").alias("total"), percent(caught, F.count("*"), 1).alias("recall_pct"))


def error_rates(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of the 2 x 2 table with false-positive and false-negative rates in percent."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    cells = df.agg(
        F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))
    return cells.withColumns({
        "fpr_pct": percent(F.col("fp"), F.col("fp") + F.col("tn"), 3),
        "fnr_pct": percent(F.col("fn"), F.col("fn") + F.col("tp"), 3)})


def compare_models(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """One row per model: AUC, average precision, best grid threshold with its F1, precision, recall."""
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("score")) for n, c in scores.items()])
    long = df.select(F.col(truth).alias("truth"), F.inline(pairs))
    points = curve(long, "truth", "score", ["model"])
    table = roc_auc(points, ["model"]).join(average_precision(points, ["model"]), "model")
    best = grid_best_f1(long, "truth", "score", ["model"])
    return table.join(best, "model").withColumns({"auc": F.round("auc", 4), "ap": F.round("ap", 4)})


def alert_rates(df: DataFrame, family: str, label: str) -> DataFrame:
    """Share of each class that raises a critical or high alert; on the benign class that is the false alarm rate."""
    alerts = F.count_if(is_alert(F.col(label)))
    return df.groupBy(F.col(family).alias("class")).agg(
        F.count("*").alias("n_total"), alerts.alias("n_alerted"), percent(alerts, F.count("*")).alias("alert_rate_pct"))


def class_drilldown(df: DataFrame, family: str, classes: list[str], score: str, predicted: str, threshold: float = 0.5) -> DataFrame:
    """Score statistics and predicted families of named small classes."""
    rare = df.filter(F.col(family).isin(list(classes)))
    return rare.groupBy(F.col(family).alias("class"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n"), F.round(F.avg(score), 4).alias("mean_score"), F.round(F.max(score), 4).alias("max_score"),
        F.round(F.min(score), 4).alias("min_score"), F.count_if(F.col(score) >= threshold).alias("flagged"))


def split_report(df: DataFrame, stratum: str, ids: list[str], split: str = "split") -> DataFrame:
    """Rows and share per split and class, and ids that occur in more than one split."""
    counts = df.groupBy(split, stratum).agg(F.count("*").alias("n"))
    sizes = counts.groupBy(split).agg(F.sum("n").alias("split_size"))
    leaked = df.groupBy(*ids).agg(F.count_distinct(split).alias("k")).filter(F.col("k") > 1).agg(F.count("*"))
    return counts.join(sizes, split).withColumns(
        {"pct": percent(F.col("n"), F.col("split_size")), "leaked_ids": leaked.scalar()})
