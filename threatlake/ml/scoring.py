"""Batch scoring: three models, fused priority, write-back columns."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.functions.scores import family_severity, priority_label, priority_score, severity_weight
from threatlake.ml.boosting import SoftmaxBooster
from threatlake.ml.forest import family_probabilities, positive_probability
from threatlake.ml.grower import GrownForest
from threatlake.ml.isolation import IsolationForest, min_max
from threatlake.operators.joins import merge_columns
from threatlake.session import cut_lineage


def fuse(scored: DataFrame, weights: dict[str, float] | None = None, certainty_bonus: bool = False) -> DataFrame:
    """Priority score and label from rf_attack_proba, family_attack_proba, predicted_family, anomaly_score."""
    weight = severity_weight(family_severity(F.col("predicted_family")))
    score = priority_score(
        F.col("rf_attack_proba"), F.col("family_attack_proba"), F.col("anomaly_score"), weight, weights, certainty_bonus)
    return scored.withColumn("priority_score", score).withColumn("priority_label", priority_label(F.col("priority_score")))


def score_events(
    df: DataFrame, binary: PipelineModel | GrownForest, family: PipelineModel | SoftmaxBooster | GrownForest, forest: IsolationForest, keep: list[str],
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Probabilities, predicted family, anomaly and priority per row.

    The models run once, without a shuffle, into a checkpoint of the narrow score columns; the
    global extremes of the anomaly score are then read from it.
    """
    scored = forest.score(family_probabilities(family, positive_probability(binary, df, "rf_attack_proba")))
    columns = ["rf_attack_proba", "family_attack_proba", "predicted_family"]
    raw = cut_lineage(scored.select(*keep, *columns, "anomaly_raw"))
    normal = min_max(raw, "anomaly_raw").drop("anomaly_raw")
    return fuse(normal, weights)


def write_back(fact: DataFrame, scores: DataFrame, version: str, key: str = "event_id") -> DataFrame:
    """Fact with score columns replaced for scored events; write it to a new version."""
    stamped = scores.select(
        key, F.round("priority_score", 4).alias("priority_score"), "priority_label",
        F.round("anomaly_score", 4).alias("anomaly_score"),
    ).withColumns({"model_version": F.lit(version), "scored_at": F.current_timestamp()})
    return merge_columns(
        fact, stamped, [key], ["priority_score", "priority_label", "anomaly_score", "model_version", "scored_at"])


def write_back_days(fact: str, scores: str, target: str, version: str, buckets: int, key: str = "event_id", day: str = "date_sk") -> DataFrame:
    """Writes the scored days of a fact into ``target`` and returns it; other days of ``target`` stay as they are.

    ``fact`` and ``scores`` are catalog tables in equal buckets by ``key`` (``sinks.write_bucketed``), both with ``day``. Bucket meets
    bucket, so neither side is shuffled, and ``target`` has the same buckets. Scoring a day again replaces that day.
    """
    spark = SparkSession.active()
    done = spark.table(scores)
    days = [r[0] for r in done.select(day).distinct().collect()]
    merged = write_back(spark.table(fact).where(F.col(day).isin(days)), done.drop(day), version, key)
    if not spark.catalog.tableExists(target):
        merged.limit(0).write.format("parquet").bucketBy(buckets, key).sortBy(key).partitionBy(day).saveAsTable(target)
    ordered = merged.select(*spark.table(target).columns)
    ordered.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").insertInto(target)
    return spark.table(target)


def label_tally(scores: DataFrame) -> DataFrame:
    return scores.groupBy("priority_label").agg(F.count("*").alias("events"))
