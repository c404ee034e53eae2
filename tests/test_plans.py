"""Plan shapes: no nested loops or cross products, no Python where built-ins do, pruned and filtered scans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from threatlake.checks import catalog
from threatlake.checks.registry import QUERIES
from threatlake.operators import dimensions as D
from threatlake.operators import sampling as SA
from threatlake.plans import reports as R
from threatlake.plans import views as V

PYTHON = {"softmax_families", "scored_events_checked", "oversampled_counts", "isolation_forest_scores", "scored_events", "nearest_neighbours", "oversampled_minority"}
EAGER = {"appended_loads", "job_scored_by_models", "job_user_scores", "importance_checked", "job_priority_distribution", "job_top_alerts", "binary_forest", "feature_importance", "family_forest", "user_scores", "quality_results"} | PYTHON


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_nested_loops_and_no_python(name, spark, sf_dir):
    text = plan(catalog.run(name, spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in text, bad


def test_scan_reads_only_what_is_needed(data):
    text = plan(R.addresses_per_country(data.supplier.select(
        F.col("s_nationkey").alias("country_iso"), F.col("s_name").alias("country_name"), F.lit(0).alias("is_internal"))))
    assert "s_acctbal" not in text.split("ReadSchema")[1]


def test_filters_reach_the_scan(data):
    orders = data.orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey")
    assert "EqualTo(o_orderstatus,F)" in plan(orders)


def test_small_dimensions_are_broadcast_by_size(spark, data):
    text = plan(V.attack_summary(data.fact, D.dim_date(spark), D.dim_attack_type(spark)))
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text


def test_without_broadcast_keys_are_shuffled(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(R.internal_targets(data.fact, data.asset))
        assert "SortMergeJoin" in text and "Broadcast" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_alerts_keep_only_the_first_rows_per_task(data):
    assert "TakeOrderedAndProject" in plan(R.top_alerts(data.fact, data.asset))


def above(text, upper, lower):
    """Whether an operator stands above another one in a plan (its line comes first and the other one is below it)."""
    lines = text.splitlines()
    first = next(i for i, x in enumerate(lines) if upper in x)
    return any(lower in x for x in lines[first + 1 :])


def test_sample_is_cut_below_the_shuffle_of_its_rows(data):
    """Few strata: the list of buckets is proved small, so rows are cut where they are read; no map of strata in the plan."""
    text = plan(SA.stratified_sample(data.events, ["event_type"], ["event_id"], 10))
    assert above(text, "Exchange hashpartitioning(event_type", "BroadcastHashJoin") and "map_from_entries" not in text and "element_at" not in text


def test_sample_of_many_strata_is_cut_by_a_shuffled_join(spark, data, monkeypatch):
    from threatlake.operators import ordering

    monkeypatch.setattr(ordering, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(ordering.broadcast_if_small, "__defaults__", (0,))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = SA.stratified_sample(data.events, ["user_id"], ["event_id"], 1)
        text = plan(df)
        assert "SortMergeJoin" in text and "Broadcast" not in text
        assert df.groupBy("user_id").count().where("count != 1").isEmpty() and df.count() == data.events.select("user_id").distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_write_back_by_bucket_moves_no_row(spark):
    from threatlake.ml import scoring
    from threatlake.sources.sinks import write_bucketed

    rows = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 5).alias("date_sk"), F.lit("x").alias("wide"))
    write_bucketed(rows, "plan_fact", "event_id", 4, "date_sk")
    scored = rows.where("date_sk = 3").select("event_id", "date_sk", F.lit(0.5).alias("priority_score"), F.lit("high").alias("priority_label"), F.lit(0.1).alias("anomaly_score"))
    write_bucketed(scored, "plan_scores", "event_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = scoring.write_back(spark.table("plan_fact").where("date_sk = 3"), spark.table("plan_scores").drop("date_sk"), "v1")
        text = plan(merged)
        assert "SortMergeJoin" in text and "Exchange" not in text and "PartitionFilters: [isnotnull(date_sk" in text
        scoring.write_back_days("plan_fact", "plan_scores", "plan_out", "v1", 4)
        write_bucketed(scored.withColumn("date_sk", F.lit(4).cast("long")).withColumn("event_id", F.col("event_id") + 1), "plan_scores", "event_id", 4)
        out = scoring.write_back_days("plan_fact", "plan_scores", "plan_out", "v2", 4)
        assert {tuple(r) for r in out.groupBy("date_sk", "model_version").count().collect()} == {(3, "v1", 200), (4, "v2", 200)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("plan_fact", "plan_scores", "plan_out"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_checks_read_the_fact_once(data, spark):
    from threatlake.operators import quality as Q

    text = plan(Q.flow_findings(data.fact.select("*"), data.asset, D.dim_attack_type(spark), D.dim_date(spark), data.customer, 1))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_sample_windows_run_inside_hash_buckets(data):
    text = plan(SA.stratified_sample(data.events, ["event_type"], ["event_id"], 10))
    assert "hashpartitioning(event_type" in text and "_bucket" in text
