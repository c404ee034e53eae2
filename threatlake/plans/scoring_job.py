"""Scoring jobs: train on the stored facts, score, write back, refresh what reads the scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake import constants as C
from threatlake.functions.numbers import clean_features
from threatlake.ml import evaluation as E
from threatlake.ml import forest, isolation, oversample, scoring
from threatlake.operators import dimensions as D
from threatlake.operators.filters import keys_missing, labeled
from threatlake.operators.joins import merge_columns
from threatlake.operators.sampling import stratified_sample, stratified_split
from threatlake.plans import insider_job
from threatlake.plans.audit import RunAudit
from threatlake.plans.views import refresh_views, user_risk_scoring
from threatlake.session import cut_lineage, wide_rows
from threatlake.sources.sinks import next_version, write_tables


@dataclass
class FlowModels:
    binary: PipelineModel
    family: PipelineModel
    anomaly: isolation.IsolationForest
    threshold: float | None = None
    report: DataFrame | None = None


def balanced_rows(train: DataFrame, features: list[str], family: str, least: int, key: str = "event_id") -> DataFrame:
    """Training rows in which every family has at least ``least`` rows; missing ones lie between neighbours of the family."""
    base = clean_features(train, features).select(F.col(key).cast("string").alias(key), family, "is_attack", *features)
    numbered = clean_features(train, features).select(key, family, F.array(*[F.col(c).cast("double") for c in features]).alias("_v"))
    sizes = base.groupBy(family).agg(F.count("*").alias("n"), F.max("is_attack").alias("is_attack")).collect()
    out = base
    for row in sizes:
        if 1 < row["n"] < least:
            made = oversample.oversample(numbered, key, "_v", family, row[family], least - row["n"])
            out = out.unionByName(made.select(
                key, family, F.lit(row["is_attack"]).alias("is_attack"),
                *[F.col("_v")[i].alias(c) for i, c in enumerate(features)]))
    return out


def train_flow_models(
    fact: DataFrame, features: list[str] | None = None, per_family: int = 25_000, booster: bool = False, least_per_family: int | None = None,
    seed: int = 42, binary: dict | None = None, family: dict | None = None, anomaly: dict | None = None,
) -> FlowModels:
    """Labelled rows -> stratified sample -> split -> (oversampling) -> three models -> threshold on the validation part.

    ``per_family`` bounds the rows that a family gives to the training sample; the anomaly model draws from all benign rows.
    """
    features = list(features or C.FLOW_FEATURES)
    name = "attack_family_denorm"
    rows = labeled(fact, "is_attack") if "is_attack" in fact.columns else fact
    sample = cut_lineage(stratified_sample(rows.select("event_id", name, "is_attack", *features), [name], ["event_id"], per_family, seed))
    parts = cut_lineage(stratified_split(sample, [name], ["event_id"], seed=seed))
    train = parts.filter("split = 'train'").drop("split")
    if least_per_family:
        train = cut_lineage(balanced_rows(train, features, name, least_per_family))
    models = FlowModels(
        forest.train_binary(train, features, "is_attack", seed=seed, **(binary or {})),
        forest.train_family(train, features, name, booster=booster, seed=seed, **({"trees": 200} | (family or {}))),
        isolation.train_on_benign(rows, features, ["event_id"], name, seed=seed, **(anomaly or {})))
    held = forest.positive_probability(models.binary, parts.filter("split = 'val'"), "rf_attack_proba")
    best = E.grid_best_f1(held, "is_attack", "rf_attack_proba").first()
    models.threshold = best["threshold"] if best else None
    test = forest.family_probabilities(models.family, parts.filter("split = 'test'"))
    models.report = E.per_class(test, name, "predicted_family").select("class", "precision", "recall", "f1", "support")
    return models


def run_flow_scoring(
    spark: SparkSession, fact: DataFrame, models: FlowModels, assets: DataFrame, dates: DataFrame, attack_types: DataFrame, root: str, version: str,
) -> dict[str, DataFrame]:
    """Scores every event of the stored fact, writes the fact with its score columns as a new version, refreshes the views."""
    with RunAudit(spark, f"{root}/meta", "flow_scoring", config={"version": version}) as run, wide_rows(spark):
        with run.stage("score") as stage:
            scores = next_version(spark, scoring.score_events(fact, models.binary, models.family, models.anomaly, ["event_id"]), root, "event_scores", version)
            stage.rows_out = run.counts["transformed"] = scores.count()
        with run.stage("write_back") as stage:
            scored = next_version(spark, scoring.write_back(fact, scores, version), root, "fact_security_event_scored", version)
            stage.rows_out = run.counts["loaded"] = scored.count()
        with run.stage("views"):
            write_tables(refresh_views(scored, assets, dates, D.dim_time(spark), attack_types), f"{root}/scored_views/{version}")
    return {"event_scores": scores, "fact_security_event": scored}


def run_user_scoring(
    spark: SparkSession, tables: dict[str, DataFrame], insiders: DataFrame, root: str, version: str, model: PipelineModel | None = None, **forest_options,
) -> dict[str, DataFrame]:
    """User model (trained on the stored profiles, or given) -> user scores -> risk on the activity fact -> user risk view.

    ``tables`` are those of the insider job. ``not_found`` lists insiders without a user row.
    """
    out: dict[str, DataFrame] = {}
    with RunAudit(spark, f"{root}/meta", "user_scoring", source_system="activity", config={"version": version}) as run:
        with run.stage("train"):
            model = model or forest.train_binary(tables["user_profiles"], C.USER_FEATURES, "is_malicious", **{**forest.USER_FOREST, **forest_options})
        with run.stage("score") as stage:
            out["user_scores"] = next_version(spark, insider_job.risk_scores(tables["user_profiles"], model, version=version), root, "user_scores", version)
            stage.rows_out = run.counts["transformed"] = out["user_scores"].count()
        with run.stage("write_back") as stage:
            risk = out["user_scores"].select("user_sk", "risk_score", "model_version", "scored_at")
            fact = merge_columns(tables["fact_user_activity"], risk, ["user_sk"], ["risk_score", "model_version", "scored_at"])
            out["fact_user_activity"] = next_version(spark, fact, root, "fact_user_activity_scored", version)
            stage.rows_out = run.counts["loaded"] = out["fact_user_activity"].count()
        with run.stage("views"):
            view = user_risk_scoring(tables["dim_user"], out["fact_user_activity"], D.dim_activity_type(spark))
            out["v_user_risk_scoring"] = next_version(spark, view, root, "v_user_risk_scoring", version)
            out["not_found"] = keys_missing(insiders, tables["dim_user"], ["user_id"])
    return out
