"""Reports on the tables that the flow job itself writes: cleaned, keyed, loaded, scored and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake import constants as C
from threatlake.checks.registry import Data, query
from threatlake.functions import activity as A
from threatlake.functions import labels as L
from threatlake.functions.scores import priority_label
from threatlake.ml import scoring
from threatlake.operators import dimensions as D
from threatlake.plans import flow_job, insider_job, scoring_job
from threatlake.plans import reports as R
from threatlake.session import checkpoint_folder, spread, wide_rows
from threatlake.sources.loads import all_loads
from threatlake.sources.sinks import next_version

NO_CACHE = "ip string, country_iso string, country_name string, abuse_confidence int, is_known_attacker int, enrichment_status string"
NO_ASSETS = ("asset_sk bigint, asset_identifier string, asset_type string, ip_address string, is_internal int, country_iso string, country_name string, "
             "city string, latitude double, longitude double, asn_org string, abuse_confidence int, is_known_attacker int, source_system string")
# scores that both engines can state, in place of a model's
SCORED = """(SELECT *, (event_id % 1000) / 1000.0::DOUBLE AS score, CASE WHEN event_id % 1000 >= 750 THEN 'critical' WHEN event_id % 1000 >= 550 THEN 'high'
  WHEN event_id % 1000 >= 350 THEN 'medium' WHEN event_id % 1000 >= 150 THEN 'low' ELSE 'info' END AS priority_label FROM fx_flow
  WHERE src_ip IS NOT NULL AND dest_ip IS NOT NULL AND event_time IS NOT NULL)"""


STORED: dict[tuple[str, str], str] = {}


def _root(d: Data) -> str:
    """Runs the job over all flows and writes the scores back, once per application and folder; the folder of its tables."""
    key = (d.spark.sparkContext.applicationId, d.folder)
    if key not in STORED:
        STORED[key] = _run(d)
    return STORED[key]


def _stored(d: Data) -> tuple[DataFrame, DataFrame]:
    """(scored fact, hosts) of the job."""
    root = _root(d)
    return d.spark.read.parquet(f"{root}/fact_scored/v1"), d.spark.read.parquet(f"{root}/dim_asset/v1")


def _flows(d: Data) -> DataFrame:
    """Flows under file column names, without ids of their own; dealt out over tasks while they are narrow."""
    label = F.col("label")
    own = {"total_fwd_packets": F.col("user_id") % 50, "total_bwd_packets": F.hour("event_time")}  # measures that models can tell apart
    measures = {source: own.get(name, F.col("value")) for source, name in C.FLOW_COLUMNS.items() if name in C.FLOW_FEATURES}
    flow = spread(d.flow.select("event_id", "src_ip", "dest_ip", "src_port", "dest_port", "protocol_num", "event_time", "source_day", "user_id", "value", "label"), 16_384)
    return flow.select(
        F.col("event_id").alias("_id"), F.col("event_id").cast("string").alias("Flow ID"), F.col("src_ip").alias("Source IP"), F.col("dest_ip").alias("Destination IP"),
        F.col("src_port").alias("Source Port"), F.col("dest_port").alias("Destination Port"), F.col("protocol_num").alias("Protocol"), "event_time", "source_day",
        L.label_clean(label).alias("label_clean"), L.attack_family(label).alias("attack_family"), L.is_attack(label).alias("is_attack"),
        *[c.alias(n) for n, c in measures.items()])


def _run(d: Data) -> str:
    flows = _flows(d).withColumnRenamed("_id", "event_id")
    root = f"{checkpoint_folder(d.spark)}/job-{uuid.uuid4().hex}"
    out = flow_job.run_flow_job(
        d.spark, flows, root, "v1", d.geo, d.reputation, d.spark.createDataFrame([], NO_CACHE), d.spark.createDataFrame([], NO_ASSETS), d.customer, least_rows=0)
    fact = out["fact_security_event"]
    score = F.pmod("event_id", F.lit(1000)) / 1000.0
    scores = fact.select("event_id", score.alias("priority_score"), priority_label(score).alias("priority_label"), score.alias("anomaly_score"))
    with wide_rows(d.spark):
        next_version(d.spark, scoring.write_back(fact, scores, "v1"), root, "fact_scored", "v1")
    return root


@query(f"""SELECT priority_label, COUNT(*) AS events FROM {SCORED} s GROUP BY 1""")
def job_priority_distribution(d: Data):
    return R.priority_distribution(_stored(d)[0]).select("priority_label", "events")


@query(f"""SELECT event_id, event_time, src_ip, dest_ip, priority_label, score AS priority_score FROM {SCORED} s ORDER BY score DESC, event_time DESC, event_id LIMIT 100""")
def job_top_alerts(d: Data):
    fact, assets = _stored(d)
    return R.top_alerts(fact, assets).select("event_id", "event_time", "src_ip", "dest_ip", "priority_label", "priority_score")


@query(f"""SELECT event_id, TRUE AS in_range, TRUE AS fused, TRUE AS label_fits, TRUE AS written FROM {SCORED} s""")
def job_scored_by_models(d: Data):
    """The whole scoring job on the fact that the flow job stored: trains three models, scores every event, writes back, refreshes the
    views. What must hold for each event, whatever the models drew; the fused score is worked out again from its parts."""
    root, version = _root(d), f"models-{uuid.uuid4().hex}"
    fact, assets = d.spark.read.parquet(f"{root}/fact_security_event/v1"), d.spark.read.parquet(f"{root}/dim_asset/v1")
    models = scoring_job.train_flow_models(fact, ["flow_duration", "total_fwd_packets", "total_bwd_packets"], binary={"numTrees": 10, "maxDepth": 6},
                                           family={"trees": 10, "depth": 6}, anomaly={"trees": 20})
    out = scoring_job.run_flow_scoring(d.spark, fact, models, assets, D.dim_date_over(fact, "event_time"), D.dim_attack_type(d.spark), root, version)
    stored = out["fact_security_event"].select("event_id", F.col("priority_score").alias("p"), F.col("priority_label").alias("l"), F.col("anomaly_score").alias("a"), "model_version")
    both = stored.join(out["event_scores"], "event_id", "left")
    weight = F.lit(C.SEVERITY_WEIGHT["info"])
    for family, severity in C.FAMILY_SEVERITY.items():
        weight = F.when(F.col("predicted_family") == family, C.SEVERITY_WEIGHT[severity]).otherwise(weight)
    parts = {"supervised": F.greatest("rf_attack_proba", "family_attack_proba"), "anomaly": F.col("anomaly_score"), "severity": weight}
    again = sum((C.FUSION_WEIGHTS[name] * part for name, part in parts.items()), F.lit(0.0))
    score = F.col("priority_score")
    label = F.when(score >= 0.75, "critical").when(score >= 0.55, "high").when(score >= 0.35, "medium").when(score >= 0.15, "low").otherwise("info")
    within = [F.col(c).between(0, 1) for c in ("rf_attack_proba", "family_attack_proba", "anomaly_score", "priority_score")]
    written = (F.col("p") == F.round(score, 4)) & (F.col("a") == F.round("anomaly_score", 4)) & (F.col("l") == F.col("priority_label"))
    return both.select(
        "event_id", (within[0] & within[1] & within[2] & within[3]).alias("in_range"), (F.abs(score - F.greatest(F.least(again, F.lit(1.0)), F.lit(0.0))) < 1e-9).alias("fused"),
        (F.col("priority_label") == label).alias("label_fits"), (written & (F.col("model_version") == version)).alias("written"))


NO_WORKSTATIONS = "asset_sk bigint, asset_identifier string, asset_type string, is_internal int, source_system string"


@query("""SELECT c_custkey AS user_id, COUNT(a.event_id_src) AS total_events, TRUE AS in_range, TRUE AS label_fits, TRUE AS view_fits
  FROM customer LEFT JOIN fx_activity a ON a.user_id = c_custkey AND a.event_time >= TIMESTAMP '2023-12-01' GROUP BY 1""")
def job_user_scores(d: Data):
    """The insider job and the user scoring job: a model of the stored profiles, scores of all users on the activity fact, the user view.
    What must hold for each user; a user without a profile has no score, and the mean over the user's events is the score itself."""
    root, version = f"{checkpoint_folder(d.spark)}/users-{uuid.uuid4().hex}", "v1"
    users = d.customer.select(F.lit("2023-12-01").cast("date").alias("snapshot_date"), F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"))
    activity = d.activity.withColumns({
        "email_recipients_count": A.recipient_count(F.col("email_to"), F.col("email_cc")), "email_to_external_domain": A.to_external(F.col("email_to"))})
    tables = insider_job.run_insider_job(d.spark, users, d.insider, activity, d.spark.createDataFrame([], NO_WORKSTATIONS), root, version, ["role"], 10)
    out = scoring_job.run_user_scoring(d.spark, tables, d.insider, root, version, numTrees=20, maxDepth=6)
    scores = out["user_scores"].join(tables["dim_user"].select("user_sk", "user_id"), "user_sk").select("user_id", "risk_score", "risk_label")
    score, mean = F.col("risk_score"), F.col("avg_risk_score")
    label = F.when(score >= 0.5, "high").when(score >= 0.315, "elevated").when(score >= 0.1, "low").otherwise("baseline")
    same = F.when(score.isNull(), mean.isNull()).otherwise(F.coalesce(F.abs(score - mean) < 1e-9, F.lit(False)))
    return out["v_user_risk_scoring"].join(scores, "user_id", "left").select(
        "user_id", "total_events", F.coalesce(score.between(0, 1), F.lit(True)).alias("in_range"), F.coalesce(F.col("risk_label") == label, score.isNull()).alias("label_fits"),
        same.alias("view_fits"))


LOADED = "(SELECT *, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS load_id FROM fx_flow WHERE src_ip IS NOT NULL AND dest_ip IS NOT NULL AND event_time IS NOT NULL)"


def _appended(d: Data) -> str:
    """Loads a third of the flows and the rest one after the other into one fact, then the second load once more."""
    root, assets, cache = f"{checkpoint_folder(d.spark)}/loads-{uuid.uuid4().hex}", d.spark.createDataFrame([], NO_ASSETS), d.spark.createDataFrame([], NO_CACHE)
    flows = _flows(d)
    third = F.col("_id") % 3 == 0
    for load, part in (("a", third), ("b", ~third), ("b", ~third)):
        out = flow_job.run_flow_job(d.spark, flows.where(part).drop("_id"), root, load, d.geo, d.reputation, cache, assets, d.customer, least_rows=0, append=True)
        cache, assets = out["enrichment_cache"], out["dim_asset"]
    return root


@query(f"""WITH n AS (SELECT load_id, COUNT(*) AS rows FROM {LOADED} l GROUP BY 1)
  SELECT load_id, rows, rows AS different_ids, CASE load_id WHEN 'a' THEN 0 ELSE (SELECT rows FROM n WHERE load_id = 'a') END AS first_id,
    CASE load_id WHEN 'a' THEN rows - 1 ELSE (SELECT SUM(rows) FROM n) - 1 END AS last_id FROM n""")
def appended_loads(d: Data):
    """Ids go on over loads, and the load that came twice is there once."""
    fact = all_loads(d.spark, f"{_appended(d)}/fact_security_event/loads")
    return fact.groupBy("load_id").agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("different_ids"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
