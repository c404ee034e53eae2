"""Flow job: clean rows -> keys and classes -> enriched hosts -> star schema -> checks."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from threatlake import constants as C
from threatlake.functions.network import ipv4_class, port_number, protocol_number, with_address_class
from threatlake.functions.numbers import coerce_integers
from threatlake.functions.times import date_key, outside_hours, time_key, weekend
from threatlake.operators import dimensions as D
from threatlake.operators import quality as Q
from threatlake.operators.filters import drop_incomplete
from threatlake.operators.joins import enrich_with_cache, resolve_key
from threatlake.operators.sampling import extract_sample
from threatlake.plans.audit import RunAudit
from threatlake.plans.increments import views_from_states, write_states
from threatlake.plans.views import refresh_views
from threatlake.session import wide_rows
from threatlake.sources.loads import all_loads, one_load, stored_with_ids, write_load
from threatlake.sources.sinks import next_version, observed_version, write_fact, write_tables


LOADABLE = ["event_time", "Source IP", "Destination IP"]


def drawn(flows: DataFrame, mode: str = "full", size: int | None = None, ids: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of a run mode; sample modes draw per family. Rows are drawn by a hash of ``ids``, by default of all columns, so
    rows that tie are equal and a sample repeats."""
    if mode in ("sample", "test"):
        return extract_sample(flows, "attack_family", list(ids or sorted(flows.columns)), size or 10_000)
    if mode != "full":
        raise ValueError(f"unknown run mode: {mode}")
    return flows


def extract(flows: DataFrame, mode: str = "full", size: int | None = None, ids: tuple[str, ...] | None = None) -> DataFrame:
    """Rows that can be loaded, with time and both addresses."""
    return drop_incomplete(drawn(flows, mode, size, ids), LOADABLE)


def transform(flows: DataFrame, ipv6: bool = False) -> DataFrame:
    """Warehouse names, time keys, office-hour flags, address classes, clean ports and protocol."""
    renamed = flows.withColumnsRenamed({k: v for k, v in C.FLOW_COLUMNS.items() if k in set(flows.columns)})
    ts = F.col("event_time")
    keyed = renamed.withColumns({
        "date_sk": date_key(ts), "time_sk": time_key(ts), "is_after_hours": outside_hours(ts), "is_weekend": weekend(ts),
        "src_port": port_number(F.col("src_port").cast("string")),
        "dest_port": port_number(F.col("dest_port").cast("string")),
        "protocol_num": protocol_number(F.col("protocol_num").cast("string")),
    })
    if ipv6:
        return with_address_class(with_address_class(keyed, "src_ip", "src_ip_class"), "dest_ip", "dest_ip_class")
    return keyed.withColumns(
        {"src_ip_class": ipv4_class(F.col("src_ip")), "dest_ip_class": ipv4_class(F.col("dest_ip"))})


def external_addresses(flows: DataFrame) -> DataFrame:
    """Every external address occurrence of both roles, for volume counts and enrichment."""
    def role(side):
        return flows.filter(F.col(f"{side}_ip_class") == "external").select(F.col(f"{side}_ip").alias("ip"))

    return role("src").unionByName(role("dest"))


@dataclass
class Dimensions:
    assets: DataFrame
    ports: DataFrame
    attack_types: DataFrame
    protocols: DataFrame


def apply_keys(flows: DataFrame, dims: Dimensions) -> DataFrame:
    """The six surrogate keys by left lookups on small or adaptively shuffled dimensions."""
    out = resolve_key(flows, dims.assets, {"src_ip": "asset_identifier"}, "asset_sk", "src_asset_sk")
    out = resolve_key(out, dims.assets, {"dest_ip": "asset_identifier"}, "asset_sk", "dest_asset_sk")
    out = resolve_key(out, dims.ports, {"src_port": "port_number"}, "port_sk", "src_port_sk")
    out = resolve_key(out, dims.ports, {"dest_port": "port_number"}, "port_sk", "dest_port_sk")
    out = resolve_key(out, dims.attack_types, {"attack_label": "attack_label"}, "attack_sk", "attack_sk")
    return resolve_key(out, dims.protocols, {"protocol_num": "protocol_num"}, "protocol_sk", "protocol_sk")


def fact_rows(keyed: DataFrame, columns=C.FACT_COLUMNS, source_system: str = "flows") -> DataFrame:
    """Fact columns in order; a missing one is an error; counters become nullable longs."""
    empty = {n: F.lit(None).cast(kind) for n, kind in C.SCORE_COLUMNS.items() if n not in keyed.columns}
    tagged = keyed.withColumns({"source_system": F.lit(source_system), **empty})
    missing = [c for c in columns if c not in set(tagged.columns)]
    if missing:
        raise ValueError(f"missing fact columns: {missing}")
    whole = [c for c in columns if c in C.FLOW_FEATURES and c not in C.DOUBLE_MEASURES]
    return coerce_integers(tagged.select(*columns), whole)


def stored_rows(spark: SparkSession, rows: DataFrame, root: str, version: str, replace: bool) -> tuple[DataFrame, int]:
    """(extracted rows as stored, with event ids; their number)."""
    if "event_id" not in rows.columns:
        numbered, found = stored_with_ids(spark, rows, root, version)
        return numbered, found["rows"]
    stored, found = observed_version(spark, rows, root, "extracted", version, {"rows": F.count("*")}, replace)
    return stored, found["rows"]


def spans_of(found: dict, fact: DataFrame) -> tuple[int, int]:
    """First and last day of a load and of the day folders that are there; names of folders only, no rows."""
    days = [int(d) for d in (found["first"], found["last"]) if d] + [r[0] for r in fact.select("date_sk").distinct().collect() if r[0]]
    return (min(days), max(days)) if days else (None, None)


def run_flow_job(
    spark: SparkSession, flows: DataFrame, root: str, version: str, ranges: DataFrame, reputation: DataFrame,
    cache: DataFrame, assets: DataFrame, users: DataFrame, mode: str = "full", size: int | None = None,
    columns=C.FACT_COLUMNS, least_rows: int = C.MIN_FLOW_ROWS, least_columns: int = C.MIN_FLOW_COLUMNS, ipv6: bool = True,
    expected_days: tuple[int, int] | None = None, append: bool = False,
) -> dict[str, DataFrame]:
    """Whole flow pipeline with run audit; each arrow that is read twice is written once, and counted while it is written.

    The calendar covers the years of the data. ``expected_days`` (first and last date key) warns of days outside.
    Event ids go on from the last load below ``root``; rows that bring an ``event_id`` keep it. With ``append``, ``version`` names a load
    that is added to one fact (and replaces itself when it is repeated), and the view tables grow by the states of that load.
    """
    out: dict[str, DataFrame] = {}
    with RunAudit(spark, f"{root}/meta", "flow_pipeline", run_mode=mode, config={"version": version, "size": size}) as run, wide_rows(spark):
        fresh = f"{version}-{run.run_id}" if append else version  # a repeated load may be given the tables that it wrote before
        with run.stage("extract") as stage:
            Q.require_columns(flows, at_least=least_columns)
            read = Observation()
            rows = drop_incomplete(drawn(flows, mode, size).observe(read, F.count("*").alias("rows")), LOADABLE)
            kept = stored_rows(spark, rows, root, version, append)
            stage.rows_in, stage.rows_out = read.get["rows"], kept[1]
            stage.notes = f"incomplete {stage.rows_in - stage.rows_out}"
            Q.require_rows(stage.rows_out, mode, least_rows)
            run.counts["extracted"] = stage.rows_out
        with run.stage("transform") as stage:
            shaped, found = observed_version(
                spark, transform(kept[0], ipv6), root, "shaped", version, Q.transform_metrics(*(expected_days or (0, 99991231))), append)
            stage.notes = "; ".join(Q.enforce_transform(found))
            stage.rows_in = stage.rows_out = run.counts["extracted"]
            run.counts["transformed"] = stage.rows_out
        with run.stage("enrich") as stage:
            external = external_addresses(shaped).distinct()
            enriched, grown = enrich_with_cache(external, cache, ranges, reputation)
            out["enrichment_cache"] = next_version(spark, grown, root, "enrichment_cache", fresh)
            enriched = out["enrichment_cache"].join(external, "ip", "left_semi")
            stage.rows_out = run.counts["enriched"] = enriched.count()
        with run.stage("load") as stage:
            hosts = shaped.select(F.col("src_ip").alias("ip"), F.col("src_ip_class").alias("ip_class")).unionByName(
                shaped.select(F.col("dest_ip").alias("ip"), F.col("dest_ip_class").alias("ip_class"))).distinct()
            located = enriched.drop("enrichment_status")
            out["dim_asset"] = next_version(spark, D.upsert_assets(assets, hosts, located), root, "dim_asset", fresh)
            out["dim_port"] = next_version(spark, D.upsert_ports(D.dim_port(spark), shaped), root, "dim_port", fresh)
            dims = Dimensions(out["dim_asset"], out["dim_port"], D.dim_attack_type(spark), D.dim_protocol(spark))
            done = Observation()
            loaded = fact_rows(apply_keys(shaped, dims), columns).observe(
                done, F.count("*").alias("rows"), F.min("date_sk").alias("first"), F.max("date_sk").alias("last"))
            path = f"{root}/fact_security_event/{'loads' if append else version}"
            if append:
                write_load(loaded, path, version)
                part, fact = one_load(spark, path, version), all_loads(spark, path)
            else:
                write_fact(loaded, path)
                part = fact = spark.read.parquet(path)
            out["fact_security_event"] = fact
            stage.rows_out = run.counts["loaded"] = done.get["rows"]
            days = spans_of(done.get, fact) if append else (done.get["first"], done.get["last"])
            dates = D.dim_date(spark, date(days[0] // 10000, 1, 1), date(days[1] // 10000, 12, 31)) if days[0] else D.dim_date(spark)
            if append:
                write_states(part, root, version)
                views = views_from_states(spark, root, dims.assets, dates, D.dim_time(spark), dims.attack_types)
            else:
                views = refresh_views(fact, dims.assets, dates, D.dim_time(spark), dims.attack_types)
            write_tables(views, f"{root}/views/{version}")
        with run.stage("quality"):
            results = Q.run_flow_checks(spark, part, dims.assets, dims.attack_types, dates, users, run.counts["loaded"], run.run_id)
            results.write.mode("append").parquet(f"{root}/meta/meta_quality_checks")
            out["quality"] = results
    return out
