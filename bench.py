"""Times the headline queries on one folder and prints one JSON line.

Every query is run to its last row into the no-op sink, so results are computed whole and
nothing but the query is measured. The best of ``BENCH_RUNS`` runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from datetime import date

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threatlake.checks import catalog
from threatlake.checks.registry import Data
from threatlake.ml import forest, isolation, scoring
from threatlake.operators import dimensions as D
from threatlake.operators import quality as Q
from threatlake.operators.sampling import stratified_sample
from threatlake.plans import flow_job
from threatlake.session import build_session, cut_lineage
from threatlake.sources.sinks import write_fact

HEADLINE = (
    "attack_summary", "top_attackers", "attack_targets", "hourly_threat_pattern", "priority_distribution", "family_distribution",
    "headline_kpis", "attack_timeline", "top_alerts", "attack_edges", "internal_targets", "working_hours", "cross_tab",
    "user_history", "asof_version_join", "user_days", "user_day_features", "user_profiles", "flow_labels", "surrogate_keys",
    "geo_range_join", "stratified_split", "stratified_sample", "score_summary", "roc_auc", "model_comparison",
)


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def stages(spark, folder: str) -> dict[str, tuple[float, int]]:
    """Seconds and rows of the pipeline stages: transform, load (write of the fact), quality checks, scoring."""
    data, out = Data(spark, folder), tempfile.mkdtemp(prefix="bench-")
    flows = data.flow.drop("user_id")
    rows = flows.count()
    result = {"stage_transform": (timed(lambda: consume(flow_job.transform(flows, ipv6=True))), rows)}
    fact = data.fact.withColumn("month_sk", F.floor(F.col("date_sk") / 100).cast("int"))
    facts = fact.count()
    result["stage_load"] = (timed(lambda: write_fact(fact, f"{out}/fact", partition="month_sk")), facts)
    stored = spark.read.parquet(f"{out}/fact")
    checks = Q.flow_checks(stored, data.asset, D.dim_attack_type(spark), D.dim_date(spark, date(1990, 1, 1), date(2029, 12, 31)), data.customer, facts)
    result["stage_quality"] = (timed(lambda: Q.run_checks(spark, checks).collect()), facts)
    names = ["flow_duration", "total_fwd_packets", "total_bwd_packets", "flow_bytes_per_sec", "score_a", "score_b"]
    labeled = data.fact.filter("is_attack IS NOT NULL").select(
        "event_id", "is_attack", F.col("attack_family_denorm").alias("family"), *names)
    labeled = labeled.repartition(spark.sparkContext.defaultParallelism)  # one small file would be one task
    models = []
    result["stage_training"] = (timed(lambda: models.extend(train(labeled, names))), facts)
    result["stage_scoring"] = (timed(lambda: consume(scoring.score_events(labeled, *models, ["event_id"]))), facts)
    return result


def train(rows, names):
    """Three models with the documented numbers of trees on a stratified sample; the anomaly model draws from all benign rows."""
    sample = cut_lineage(stratified_sample(rows, ["family"], ["event_id"], 1000))
    yield forest.train_binary(sample, names, "is_attack")
    yield forest.train_family(sample, names, "family", trees=200)
    yield isolation.train_on_benign(rows, names, ["event_id"], "family")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("threatlake-bench", f"local[{cpus}]", **{
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"), "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    consume(Data(spark, folder).lineitem)
    times = {}
    for name in HEADLINE:
        times[name] = round(min(timed(lambda: consume(catalog.run(name, spark, folder))) for _ in range(runs)), 3)
    rates = {}
    for name, (seconds, rows) in stages(spark, folder).items():
        times[name], rates[f"{name}_rows_per_sec"] = round(seconds, 3), round(rows / seconds)
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "rows_per_sec": rates, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
