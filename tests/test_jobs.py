"""The jobs end to end, their audit rows, and a failing stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from threatlake import constants as C
from threatlake.functions import activity as A
from threatlake.functions import labels as L
from threatlake.ml import forest, isolation, scoring
from threatlake.operators import quality as Q
from threatlake.plans import audit, flow_job, insider_job


def clean_flows(data):
    """Flow rows under file column names, as the cleaning step leaves them."""
    label = F.col("label")
    flows = data.flow.select(
        F.col("event_id").cast("string").alias("Flow ID"), F.col("src_ip").alias("Source IP"), F.col("dest_ip").alias("Destination IP"),
        F.col("src_port").alias("Source Port"), F.col("dest_port").alias("Destination Port"), F.col("protocol_num").alias("Protocol"),
        "event_time", "source_day", L.label_clean(label).alias("label_clean"), L.attack_family(label).alias("attack_family"),
        L.is_attack(label).alias("is_attack"), "value")
    measures = [c for c in C.FLOW_COLUMNS if C.FLOW_COLUMNS[c] in C.FLOW_FEATURES]
    return flows.select("*", *[F.col("value").alias(m) for m in measures]).drop("value")


def test_flow_job(spark, data, tmp_path):
    flows = clean_flows(data)
    cache = spark.createDataFrame([], "ip string, country_iso string, country_name string, abuse_confidence int, is_known_attacker int, enrichment_status string")
    assets = spark.createDataFrame([], "asset_sk bigint, asset_identifier string, asset_type string, ip_address string, is_internal int, "
                                   "country_iso string, country_name string, city string, latitude double, longitude double, asn_org string, "
                                   "abuse_confidence int, is_known_attacker int, source_system string")
    out = flow_job.run_flow_job(spark, flows, str(tmp_path), "v1", data.geo, data.reputation, cache, assets, data.customer, least_rows=1, least_columns=20)
    fact = out["fact_security_event"]
    kept = flows.filter("`Source IP` IS NOT NULL").count()
    assert fact.count() == kept and set(fact.columns) == set(C.FACT_COLUMNS)
    assert fact.filter("src_asset_sk IS NULL OR dest_asset_sk IS NULL").count() == 0
    assert dict(fact.dtypes)["total_fwd_packets"] == "bigint" and dict(fact.dtypes)["flow_bytes_per_sec"] == "double"
    ports = fact.filter("src_port_sk IS NULL").count()
    assert 0 < ports < kept
    results = {r["check_name"]: r for r in out["quality"].collect()}
    assert results["fact_row_count_matches_loaded"]["passed"] == 1 and results["fk_integrity_assets"]["passed"] == 1
    assert results["fk_integrity_dates"]["passed"] == 1  # the calendar follows the data
    stages = [r["stage_name"] for r in spark.read.parquet(f"{tmp_path}/meta/meta_pipeline_stages").orderBy("started_at").collect()]
    assert stages == ["extract", "transform", "enrich", "load", "quality"]
    run = audit.recent_runs(spark.read.parquet(f"{tmp_path}/meta/meta_pipeline_runs"), 1).first()
    assert (run["status"], run["rows_extracted"], run["rows_loaded"]) == ("success", kept, kept)
    views = spark.read.parquet(f"{tmp_path}/views/v1/mv_hourly_threat_pattern")
    assert views.columns == ["day_name", "hour_24", "day_part", "attack_family", "event_count"]
    attacks = fact.filter("is_attack = 1").count()
    assert attacks > 0 and views.agg(F.sum("event_count")).first()[0] == attacks
    summary = spark.read.parquet(f"{tmp_path}/views/v1/mv_attack_summary")
    assert summary.count() > 0
    assert fact.select("event_id").distinct().count() == kept and fact.filter("priority_score IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="columns, expected at least"):
        flow_job.run_flow_job(spark, flows, str(tmp_path), "v0", data.geo, data.reputation, cache, assets, data.customer, least_rows=1, least_columns=len(flows.columns) + 1)
    # a second run over the same data: every address is cached, no host gets a new key
    again = flow_job.run_flow_job(
        spark, flows, str(tmp_path), "v2", data.geo, data.reputation, out["enrichment_cache"], out["dim_asset"], data.customer, least_rows=1, least_columns=20)
    assert again["dim_asset"].count() == out["dim_asset"].count()
    assert again["enrichment_cache"].count() == out["enrichment_cache"].count()


def test_appended_loads_keep_ids_apart(spark, data, tmp_path):
    """Two loads and the second once more: ids differ, nothing is doubled, views equal those of all rows, one folder is read a load."""
    from threatlake.operators import dimensions as D
    from threatlake.plans import views
    from threatlake.sources import loads

    flows = clean_flows(data)
    cache = spark.createDataFrame([], "ip string, country_iso string, country_name string, abuse_confidence int, is_known_attacker int, enrichment_status string")
    assets = spark.createDataFrame([], "asset_sk bigint, asset_identifier string, asset_type string, ip_address string, is_internal int, "
                                   "country_iso string, country_name string, city string, latitude double, longitude double, asn_org string, "
                                   "abuse_confidence int, is_known_attacker int, source_system string")
    half = F.col("Flow ID").cast("long") % 2 == 0
    for load, part in (("one", half), ("two", ~half), ("two", ~half)):
        out = flow_job.run_flow_job(spark, flows.where(part), str(tmp_path), load, data.geo, data.reputation, cache, assets, data.customer, least_rows=1, least_columns=20, append=True)
        cache, assets = out["enrichment_cache"], out["dim_asset"]
        assert {r["check_name"]: r["passed"] for r in out["quality"].collect()}["fact_row_count_matches_loaded"] == 1
    fact, kept = out["fact_security_event"], flows.filter("`Source IP` IS NOT NULL").count()
    assert fact.count() == kept == fact.select("event_id").distinct().count() == fact.agg(F.max("event_id")).first()[0] + 1
    assert loads.ledger(spark, str(tmp_path)).count() == 2
    dates = D.dim_date_over(fact, "event_time")
    whole = ["full_date", "attack_family", "severity", "event_count", "unique_attackers", "unique_targets"]
    want = views.attack_summary(fact, dates, D.dim_attack_type(spark)).select(*whole).collect()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/views/two/mv_attack_summary").select(*whole).collect())) == sorted(map(tuple, want))
    files = loads.one_load(spark, f"{tmp_path}/fact_security_event/loads", "one").inputFiles()
    assert files and all("load_id=one" in f for f in files)


def test_sample_mode_and_guards(spark, data):
    flows = clean_flows(data)
    families = {r[0]: r[1] for r in flow_job.extract(flows, "sample", 100).groupBy("attack_family").count().collect()}
    assert all(n <= 10 for n in families.values()) and len(families) == 5
    with pytest.raises(ValueError, match="unknown run mode"):
        flow_job.extract(flows, "other")
    with pytest.raises(ValueError, match="missing fact columns"):
        flow_job.fact_rows(flow_job.transform(flows))
    shaped = flow_job.transform(flows)
    assert Q.enforce_transform(Q.transform_findings(shaped))
    with pytest.raises(ValueError, match="without date key"):
        Q.enforce_transform(Q.transform_findings(shaped.withColumn("date_sk", F.lit(None).cast("int"))))
    with pytest.raises(ValueError, match="invalid time key"):
        Q.enforce_transform(Q.transform_findings(shaped.withColumn("time_sk", F.lit(1440))))


def test_failed_stage_is_recorded(spark, tmp_path):
    with pytest.raises(RuntimeError, match="boom"):
        with audit.RunAudit(spark, str(tmp_path), "p") as run:
            with run.stage("first"):
                raise RuntimeError("boom")
    row = spark.read.parquet(f"{tmp_path}/meta_pipeline_stages").first()
    assert (row["status"], row["error_message"]) == ("failed", "boom")
    assert spark.read.parquet(f"{tmp_path}/meta_pipeline_runs").first()["status"] == "failed"
    assert audit.stages_of_run(spark.read.parquet(f"{tmp_path}/meta_pipeline_stages"), run.run_id).count() == 1


def test_insider_job(spark, data, tmp_path):
    users = data.customer.select(
        F.lit("2023-12-01").cast("date").alias("snapshot_date"), F.col("c_custkey").alias("user_id"), F.lit("R").alias("role"),
        F.col("c_mktsegment").alias("department"))
    later = users.withColumn("snapshot_date", F.lit("2024-01-01").cast("date")).withColumn(
        "role", F.when(F.col("user_id") < 5, "Manager").otherwise(F.col("role")))
    activity = data.activity.withColumns({
        "email_recipients_count": A.recipient_count(F.col("email_to"), F.col("email_cc")), "email_to_external_domain": A.to_external(F.col("email_to"))})
    assets = spark.createDataFrame([], "asset_sk bigint, asset_identifier string, asset_type string, is_internal int, source_system string")
    out = insider_job.run_insider_job(
        spark, users.unionByName(later), data.insider, activity, assets, str(tmp_path), "v1", ["role", "department"], 10)
    assert out["dim_user"].filter("user_id < 5").count() == 10
    known = activity.join(data.customer.select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi").count()
    assert out["fact_user_activity"].count() == known
    assert out["user_daily_ml_features"].count() == out["user_daily_features"].count()
    assert out["user_profiles"].filter("max_usb_ratio > 50").count() == 0
    with_ocean = insider_job.attach_ocean(out["dim_user"], spark.createDataFrame([(1, 40)], "user_id bigint, ocean_o int"))
    assert with_ocean.count() == out["dim_user"].count()


def test_models_separate_separable_data(spark, tmp_path):
    rows = spark.range(1200).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 12 == 0, "DDoS").when(F.col("id") % 12 == 1, "Botnet").otherwise("Benign").alias("family"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("noise")).withColumns({
            "a": F.when(F.col("family") == "DDoS", 8.0).otherwise(0.0) + F.col("noise"),
            "b": F.when(F.col("family") == "Botnet", -6.0).otherwise(0.0) + F.pmod(F.xxhash64("noise"), F.lit(100)) / 100.0,
            "is_attack": (F.col("family") != "Benign").cast("int")})
    features = ["a", "b"]
    binary = forest.train_binary(rows, features, "is_attack", numTrees=10, maxDepth=4)
    for booster in (False, True, "one_against_rest"):
        family = forest.train_family(rows, features, "family", booster=booster, trees={False: 5, True: 20}.get(booster, 2), depth=3)
        named = forest.family_probabilities(family, rows)
        assert named.filter("family = predicted_family").count() >= 1150
        assert named.filter("family_attack_proba < 0 OR family_attack_proba > 1 OR family_attack_proba IS NULL").count() == 0
        assert named.filter("(predicted_family = 'Benign') <> (family_attack_proba < 0.5)").count() <= 12
    anomaly = isolation.train_on_benign(rows, features, ["event_id"], "family", trees=40, sample=128)
    assert anomaly.nodes.groupby("tree").size().max() <= 255
    scored = scoring.score_events(rows, binary, forest.train_family(rows, features, "family", trees=5, depth=3), anomaly, ["event_id", "family"])
    mean = {r["family"]: r["m"] for r in scored.groupBy("family").agg(F.avg("anomaly_score").alias("m")).collect()}
    assert mean["DDoS"] > mean["Benign"] + 0.2 and mean["Botnet"] > mean["Benign"] + 0.2
    labels = {r["family"]: r["n"] for r in scored.filter("priority_label = 'critical'").groupBy("family").agg(F.count("*").alias("n")).collect()}
    assert labels.get("DDoS") == 100 and "Benign" not in labels
    binary.write().overwrite().save(str(tmp_path / "model"))
    fact = rows.select("event_id")
    merged = scoring.write_back(fact, scored, "v1")
    assert merged.filter("priority_score IS NULL").count() == 0


def test_isolation_trees_draw_from_the_whole_table(spark):
    rows = spark.range(60_000).select("id", F.col("id").cast("double").alias("x"))
    draws = isolation.tree_samples(rows, ["id"], 100, 64, 42, 60_000)
    assert draws.select("id").distinct().count() > 0.85 * draws.count() > 0.85 * 9_000


def test_scoring_jobs_feed_the_views(spark, data, tmp_path):
    from threatlake.operators import dimensions as D
    from threatlake.plans import reports, scoring_job, views

    names = ["flow_duration", "total_fwd_packets", "total_bwd_packets"]
    cache = spark.createDataFrame([], "ip string, country_iso string, country_name string, abuse_confidence int, is_known_attacker int, enrichment_status string")
    assets = spark.createDataFrame([], "asset_sk bigint, asset_identifier string, asset_type string, ip_address string, is_internal int, "
                                   "country_iso string, country_name string, city string, latitude double, longitude double, asn_org string, "
                                   "abuse_confidence int, is_known_attacker int, source_system string")
    out = flow_job.run_flow_job(spark, clean_flows(data), str(tmp_path), "v1", data.geo, data.reputation, cache, assets, data.customer, least_rows=1, least_columns=20)
    fact = out["fact_security_event"]
    few = fact.select("event_id", "attack_family_denorm", "is_attack", *names).limit(400)
    sizes = {r[0]: r[1] for r in few.groupBy("attack_family_denorm").count().collect()}
    least = max(sizes.values())
    grown = {r[0]: r[1] for r in scoring_job.balanced_rows(few, names, "attack_family_denorm", least).groupBy("attack_family_denorm").count().collect()}
    assert all(grown[k] == (least if n > 1 else 1) for k, n in sizes.items())
    models = scoring_job.train_flow_models(fact, names, 300, least_per_family=40, binary={"numTrees": 5, "maxDepth": 4},
                                           family={"trees": 5, "depth": 4}, anomaly={"trees": 10, "sample": 32})
    assert models.report.count() >= 2 and 0 < models.threshold < 1
    scored = scoring_job.run_flow_scoring(spark, fact, models, out["dim_asset"], D.dim_date_over(fact, "event_time"), D.dim_attack_type(spark), str(tmp_path), "v1")
    done = scored["fact_security_event"]
    assert done.count() == fact.count() and done.filter("priority_score IS NULL OR model_version <> 'v1'").count() == 0
    assert reports.priority_distribution(done).agg(F.sum("events")).first()[0] == done.count()
    assert reports.top_alerts(done, out["dim_asset"], 20).count() == 20

    users = data.customer.select(F.lit("2023-12-01").cast("date").alias("snapshot_date"), F.col("c_custkey").alias("user_id"), F.lit("R").alias("role"))
    activity = data.activity.withColumns({
        "email_recipients_count": A.recipient_count(F.col("email_to"), F.col("email_cc")), "email_to_external_domain": A.to_external(F.col("email_to"))})
    pcs = spark.createDataFrame([], "asset_sk bigint, asset_identifier string, asset_type string, is_internal int, source_system string")
    traits = spark.createDataFrame([(1, 40)], "user_id bigint, ocean_o int")
    tables = insider_job.run_insider_job(spark, users, data.insider, activity, pcs, str(tmp_path / "users"), "v1", ["role"], 10, traits)
    result = scoring_job.run_user_scoring(spark, tables, data.insider, str(tmp_path / "users"), "v1", numTrees=5, maxDepth=4)
    view = result["v_user_risk_scoring"]
    assert view.count() == tables["dim_user"].filter("is_current = 1").count() and view.filter("avg_risk_score IS NOT NULL").count() > 0
    assert view.filter("ocean_o = 40").count() == 1
    assert result["not_found"].count() == data.insider.select("user_id").distinct().join(data.customer, F.col("user_id") == F.col("c_custkey"), "left_anti").count()
    assert views.user_risk_scoring(tables["dim_user"], tables["fact_user_activity"], D.dim_activity_type(spark)).count() == view.count()


def test_neighbours_with_hot_copies(spark):
    import numpy as np

    from threatlake.ml import oversample

    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(size=(120, 3)), np.zeros((60, 3)), rng.normal(5, 0.1, size=(20, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id bigint, x array<double>")
    near = oversample.nearest_neighbours(df, "id", "x", 4, pivots=6, block=16).collect()
    got = {}
    for r in near:
        got.setdefault(r["id"], {})[r["place"]] = r["distance"]
    assert len(got) == 200
    for i, p in enumerate(points):
        d = np.sort(np.delete(np.linalg.norm(points - p, axis=1), i))[:4]
        assert np.allclose([got[i][k] for k in (1, 2, 3, 4)], d, atol=1e-6)
    made = oversample.oversample(df.withColumn("label", F.lit(1)), "id", "x", "label", 1, 450).collect()
    assert len(made) == 450 and len({r["id"] for r in made}) == 450
