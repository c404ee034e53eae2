"""Insider job: directory history -> activity fact -> user days -> baselines -> features -> profiles -> scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake import constants as C
from threatlake.functions.scores import risk_label
from threatlake.operators import dimensions as D
from threatlake.operators import insider as I
from threatlake.plans.audit import RunAudit
from threatlake.sources.sinks import next_version

TRAITS = tuple(f"ocean_{c}" for c in "ocean")


def user_history(snapshots: DataFrame, insiders: DataFrame, attributes: list[str] | None = None) -> DataFrame:
    """Versioned users with stable hash keys, flagged from the answer key."""
    names = attributes or list(C.DIRECTORY_ATTRIBUTES.values())
    history = D.build_history(snapshots, "user_id", "snapshot_date", names)
    keyed = history.withColumn("user_sk", F.xxhash64("user_id", "valid_from"))
    return D.flag_users(keyed, insiders)


def attach_ocean(users: DataFrame, psychometric: DataFrame) -> DataFrame:
    return users.join(psychometric, "user_id", "left")


def risk_scores(profiles: DataFrame, model, user: str = "user_sk", version: str = "v1") -> DataFrame:
    """Malicious probability of a fitted user model with its label."""
    from threatlake.ml.forest import positive_probability

    scored = positive_probability(model, profiles, "risk_score").withColumn("risk_score", F.bround("risk_score", 4))
    return scored.select(
        user, "risk_score", risk_label(F.col("risk_score")).alias("risk_label"), F.lit(version).alias("model_version"),
        F.current_timestamp().alias("scored_at"), F.col("is_malicious").alias("is_malicious_truth"), "malicious_scenario")


def scoring_summary(scores: DataFrame, threshold: float = 0.315) -> DataFrame:
    """Flagged, caught and missed users at the operating threshold."""
    from threatlake.functions.numbers import percent

    flagged, truth = F.col("risk_score") >= threshold, F.col("is_malicious_truth") == 1
    caught = F.count_if(flagged & truth)
    return scores.agg(
        F.count("*").alias("users_scored"), F.count_if(flagged).alias("flagged"), caught.alias("caught"),
        F.count_if(flagged & ~truth).alias("false_alarms"), F.count_if(truth).alias("malicious"),
        percent(caught, F.count_if(truth), 1).alias("recall_pct"),
        percent(caught, F.greatest(F.count_if(flagged), F.lit(1).cast("bigint")), 1).alias("precision_pct"))


def run_insider_job(
    spark: SparkSession, snapshots: DataFrame, insiders: DataFrame, activity: DataFrame, assets: DataFrame,
    root: str, version: str, attributes: list[str] | None = None, baseline_days: int = 60, psychometric: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All tables up to the user profiles, each written once, under run audit. Without ``psychometric`` the five traits are empty."""
    with RunAudit(spark, f"{root}/meta", "insider_pipeline", source_system="activity", config={"version": version}) as run:
        with run.stage("build") as stage:
            out = _build(spark, snapshots, insiders, activity, assets, root, version, attributes, baseline_days, psychometric)
            stage.rows_out = run.counts["loaded"] = out["fact_user_activity"].count()
    return out


def _build(spark, snapshots, insiders, activity, assets, root, version, attributes, baseline_days, psychometric) -> dict[str, DataFrame]:
    users = user_history(snapshots, insiders, attributes)
    if psychometric is not None:
        users = attach_ocean(users, psychometric)
    users = users.withColumns({c: F.lit(None).cast("int") for c in TRAITS if c not in users.columns})
    users = users.withColumns({c: F.lit(None).cast("string") for c in C.DIRECTORY_ATTRIBUTES.values() if c not in users.columns})
    out = {"dim_user": next_version(spark, users, root, "dim_user", version)}
    out["dim_asset"] = next_version(spark, D.upsert_workstations(assets, activity), root, "dim_asset", version)
    types = D.dim_activity_type(spark)
    fact = I.activity_fact(activity, out["dim_user"], out["dim_asset"], types)
    out["fact_user_activity"] = next_version(spark, fact, root, "fact_user_activity", version)
    days = I.user_days(out["fact_user_activity"], types)
    out["user_daily_features"] = next_version(spark, days, root, "user_daily_features", version)
    baselines = I.personal_baselines(out["user_daily_features"], baseline_days=baseline_days)
    out["user_baselines"] = next_version(spark, baselines, root, "user_baselines", version)
    features = I.user_day_features(out["user_daily_features"], out["dim_user"], out["user_baselines"])
    out["user_daily_ml_features"] = next_version(spark, features, root, "user_daily_ml_features", version)
    profiles = I.user_profiles(out["user_daily_ml_features"], out["user_baselines"])
    out["user_profiles"] = next_version(spark, profiles, root, "user_profiles", version)
    return out
