"""Star-schema queries: views, executive and geography reports, quality checks, samples, order."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from threatlake.checks.flows import _pct
from threatlake.checks.registry import Data, query
from threatlake.functions import numbers as NUM
from threatlake.functions import scores as S
from threatlake.ml import scoring
from threatlake.operators import aggregates as G
from threatlake.operators import dimensions as D
from threatlake.operators import filters as FL
from threatlake.operators import joins as J
from threatlake.operators import ordering as O
from threatlake.operators import quality as Q
from threatlake.operators import sampling as SA
from threatlake.plans import increments
from threatlake.plans import reports as R
from threatlake.plans import views as V
from threatlake.session import checkpoint_folder
from threatlake.sources.readers import reconcile
from threatlake.sources.sinks import write_bucketed

STAR = "fx_fact f JOIN fx_attack_type t ON f.attack_sk = t.attack_sk"
DAY = "strptime(f.date_sk::VARCHAR, '%Y%m%d')"


def _dates(d: Data):
    return D.dim_date(d.spark, date(1990, 1, 1), date(2029, 12, 31))


def _types(d: Data):
    return D.dim_attack_type(d.spark)


# ---- views ----------------------------------------------------------------------------------------

SUMMARY = f"""SELECT {DAY}::DATE AS full_date, dayname({DAY}) AS day_name, attack_family, severity, COUNT(*) AS event_count,
  COUNT(DISTINCT src_asset_sk) AS unique_attackers, COUNT(DISTINCT dest_asset_sk) AS unique_targets,
  round(SUM(flow_bytes_per_sec), 2) AS total_byte_throughput, round(AVG(flow_duration), 4) AS avg_flow_duration_us
  FROM {STAR} WHERE is_attack = 1 GROUP BY ALL"""


def _rounded(view):
    return view.withColumns({
        "total_byte_throughput": F.round("total_byte_throughput", 2), "avg_flow_duration_us": F.round("avg_flow_duration_us", 4)})


@query(SUMMARY)
def attack_summary(d: Data):
    return _rounded(V.attack_summary(d.fact, _dates(d), _types(d)))


def _refreshed(d: Data) -> dict:
    """View tables from the states of three loads, the second of them written twice; each load is read alone."""
    root = f"{checkpoint_folder(d.spark)}/states-{uuid.uuid4().hex}"
    for load in (0, 1, 1, 2):
        increments.write_states(d.fact.where(F.pmod("event_id", F.lit(3)) == load), root, str(load))
    return increments.views_from_states(d.spark, root, d.asset, _dates(d), D.dim_time(d.spark), _types(d))


@query(SUMMARY)
def refreshed_attack_summary(d: Data):
    return _rounded(_refreshed(d)["mv_attack_summary"])


TOP_ATTACKERS = f"""SELECT asset_identifier AS attacker_ip, country_iso, country_name, city, latitude, longitude, asn_org, abuse_confidence,
  COUNT(*) AS attack_count, COUNT(DISTINCT dest_asset_sk) AS unique_targets, COUNT(DISTINCT t.attack_family) AS attack_families_used,
  MIN(event_time) AS first_seen, MAX(event_time) AS last_seen FROM {STAR} JOIN fx_asset a ON a.asset_sk = f.src_asset_sk
  WHERE is_attack = 1 AND is_internal = 0 GROUP BY ALL"""


@query(TOP_ATTACKERS)
def top_attackers(d: Data):
    return V.top_attackers(d.fact, d.asset, _types(d))


@query(TOP_ATTACKERS)
def refreshed_top_attackers(d: Data):
    return _refreshed(d)["mv_top_attackers"]


@query(f"""SELECT asset_identifier AS target_ip, asset_type, business_unit, criticality, COUNT(*) AS attacks_received,
  COUNT(DISTINCT src_asset_sk) AS unique_attackers, COUNT(DISTINCT t.attack_family) AS attack_families_seen,
  MIN(event_time) AS first_attacked, MAX(event_time) AS last_attacked FROM {STAR} JOIN fx_asset a ON a.asset_sk = f.dest_asset_sk
  WHERE is_attack = 1 GROUP BY ALL""")
def attack_targets(d: Data):
    return V.attack_targets(d.fact, d.asset, _types(d))


PART_OF_DAY = ("CASE WHEN hour(event_time) < 5 THEN 'late_night' WHEN hour(event_time) < 8 THEN 'early_morning' WHEN hour(event_time) < 12 "
               "THEN 'morning' WHEN hour(event_time) < 17 THEN 'afternoon' WHEN hour(event_time) < 20 THEN 'evening' ELSE 'night' END")


PATTERN = f"""SELECT dayname(event_time) AS day_name, hour(event_time) AS hour_24, {PART_OF_DAY} AS day_part, t.attack_family, COUNT(*) AS event_count
  FROM {STAR} WHERE is_attack = 1 GROUP BY ALL"""


@query(PATTERN)
def hourly_threat_pattern(d: Data):
    return V.hourly_threat_pattern(d.fact, _dates(d), D.dim_time(d.spark), _types(d))


@query(PATTERN)
def refreshed_threat_pattern(d: Data):
    return _refreshed(d)["mv_hourly_threat_pattern"]


@query("""SELECT c_custkey, COUNT(o_orderkey) AS orders, round(COALESCE(SUM(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def dimension_preserving_join(d: Data):
    spent = d.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"))
    return d.customer.select("c_custkey").join(spent, "c_custkey", "left").fillna(0).withColumn("spent", F.round("spent", 2))


# ---- reports --------------------------------------------------------------------------------------

@query("""SELECT 'fact_security_event' AS table_name, COUNT(*) AS rows, (SELECT MAX(scored_at) FROM fx_fact) AS latest_scored_at FROM fx_fact
  UNION ALL SELECT 'dim_asset', COUNT(*), (SELECT MAX(scored_at) FROM fx_fact) FROM fx_asset
  UNION ALL SELECT 'dim_attack_type', COUNT(*), (SELECT MAX(scored_at) FROM fx_fact) FROM fx_attack_type""")
def warehouse_stats(d: Data):
    tables = {"fact_security_event": d.fact, "dim_asset": d.asset, "dim_attack_type": _types(d)}
    return R.warehouse_stats(tables, d.fact)


@query(f"""SELECT priority_label, events, {_pct('events', 'SUM(events) OVER ()')} AS pct FROM (SELECT priority_label, COUNT(*) AS events FROM fx_fact
  WHERE priority_label IS NOT NULL GROUP BY 1) g""")
def priority_distribution(d: Data):
    return R.priority_distribution(d.fact)


@query(f"""SELECT family, events, alert_count, {_pct('events', 'SUM(events) OVER ()')} AS pct FROM (SELECT attack_family_denorm AS family, COUNT(*) AS events,
  COUNT(*) FILTER (WHERE priority_label IN ('critical', 'high')) AS alert_count FROM fx_fact GROUP BY 1) g""")
def family_distribution(d: Data):
    return R.family_distribution(d.fact)


KPIS = """SELECT COUNT(*) AS total_events, COUNT(*) FILTER (WHERE priority_label = 'critical') AS critical_count,
  COUNT(*) FILTER (WHERE priority_label = 'high') AS high_count, COUNT(*) FILTER (WHERE attack_family_denorm <> 'Benign') AS attack_count,
  COUNT(DISTINCT src_asset_sk) AS unique_src, COUNT(DISTINCT dest_asset_sk) AS unique_dest FROM fx_fact"""


@query(KPIS)
def headline_kpis(d: Data):
    return R.headline_kpis(d.fact)


@query(f"SELECT {_pct('attack_count', 'total_events', 1)} AS attack_pct, {_pct('critical_count', 'total_events', 1)} AS critical_pct FROM ({KPIS}) k")
def headline_shares(d: Data):
    return R.headline_shares(d.fact)


@query("""SELECT date_trunc('hour', event_time) AS hour_bucket, attack_family_denorm AS family, COUNT(*) AS events FROM fx_fact
  WHERE attack_family_denorm <> 'Benign' GROUP BY 1, 2""")
def attack_timeline(d: Data):
    return R.attack_timeline(d.fact)


@query(f"""SELECT country_iso, country_name, attack_count, unique_targets, attack_families_used, first_seen, last_seen FROM ({TOP_ATTACKERS}) v
  WHERE country_iso IS NOT NULL""")
def attackers_with_country(d: Data):
    return R.attackers_with_country(V.top_attackers(d.fact, d.asset, _types(d)))


@query("SELECT country_iso, country_name, COUNT(*) AS distinct_ips FROM fx_asset WHERE is_internal = 0 AND country_iso IS NOT NULL GROUP BY 1, 2")
def addresses_per_country(d: Data):
    return R.addresses_per_country(d.asset)


@query("""SELECT country_iso, country_name, COUNT(*) AS distinct_ips FROM fx_asset WHERE is_internal = 0 AND country_iso IS NOT NULL GROUP BY 1, 2
  ORDER BY 3 DESC, 1, 2 LIMIT 15""")
def top_countries(d: Data):
    return R.addresses_per_country(d.asset, 15)


@query(f"SELECT dayname(event_time) AS day_name, hour(event_time) AS hour_24, t.attack_family, COUNT(*) AS event_count FROM {STAR} WHERE is_attack = 1 GROUP BY ALL")
def heatmap_cells(d: Data):
    return R.heatmap(V.hourly_threat_pattern(d.fact, _dates(d), D.dim_time(d.spark), _types(d)))


ALERTS = """SELECT event_id, event_time, s.asset_identifier AS src_ip, s.country_iso AS src_country, s.is_internal AS src_internal,
  t.asset_identifier AS dest_ip, t.country_iso AS dest_country, t.is_internal AS dest_internal, attack_family_denorm AS attack_family,
  round(priority_score::DECIMAL(20,9), 4)::DOUBLE AS priority_score, priority_label, round(anomaly_score::DECIMAL(20,9), 4)::DOUBLE AS anomaly_score,
  flow_duration, total_fwd_packets, total_bwd_packets, is_attack FROM fx_fact f
  JOIN fx_asset s ON s.asset_sk = src_asset_sk JOIN fx_asset t ON t.asset_sk = dest_asset_sk WHERE {where}
  ORDER BY f.priority_score DESC, event_time DESC, event_id, dest_asset_sk, flow_duration, src_asset_sk LIMIT 100"""
TIES = ["event_id", "dest_asset_sk", "flow_duration", "src_asset_sk"]


@query(ALERTS.format(where="priority_label IS NOT NULL"))
def top_alerts(d: Data):
    return R.top_alerts(d.fact, d.asset, tie=TIES)


@query(ALERTS.format(where="priority_label IN ('critical', 'high') AND attack_family_denorm IN ('DDoS', 'DoS') AND s.country_iso IN ('N1', 'N2', 'N3') AND priority_score >= 0.6"))
def top_alerts_filtered(d: Data):
    return R.top_alerts(
        d.fact, d.asset, labels=["critical", "high"], families=["DDoS", "DoS"], source_countries=["N1", "N2", "N3"], min_score=0.6, tie=TIES)


@query("SELECT DISTINCT attack_family_denorm AS family FROM fx_fact WHERE attack_family_denorm IS NOT NULL")
def family_options(d: Data):
    return R.family_options(d.fact)


@query("""SELECT DISTINCT country_iso AS iso, country_name AS name FROM fx_fact JOIN fx_asset ON asset_sk = src_asset_sk
  WHERE country_iso IS NOT NULL AND priority_label IN ('critical', 'high')""")
def country_options(d: Data):
    return R.country_options(d.fact, d.asset)


@query("""SELECT asset_identifier AS ip, country_iso, country_name, city, latitude, longitude, asn_org, is_known_attacker, COUNT(event_id) AS attack_count,
  COUNT(DISTINCT dest_asset_sk) AS unique_targets FROM fx_fact JOIN fx_asset ON asset_sk = src_asset_sk WHERE is_internal = 0 AND is_attack = 1
  AND country_iso IS NOT NULL GROUP BY ALL HAVING COUNT(event_id) > 0 ORDER BY attack_count DESC, ip LIMIT 100""")
def attacker_details(d: Data):
    return R.attacker_details(d.fact, d.asset)


@query("""SELECT COUNT(DISTINCT asset_identifier) AS total_external_ips, COUNT(DISTINCT country_iso) AS distinct_countries,
  COUNT(DISTINCT CASE WHEN country_iso IS NULL THEN asset_identifier END) AS unmapped_ips FROM fx_asset WHERE is_internal = 0""")
def geo_summary(d: Data):
    return R.geo_summary(d.asset)


@query("""SELECT asset_identifier AS internal_ip, COUNT(event_id) AS attack_count, COUNT(DISTINCT src_asset_sk) AS unique_attackers,
  COUNT(DISTINCT attack_sk) AS attack_types_seen FROM fx_fact JOIN fx_asset ON asset_sk = dest_asset_sk WHERE is_internal = 1 AND is_attack = 1 GROUP BY 1""")
def internal_targets(d: Data):
    return R.internal_targets(d.fact, d.asset)


@query("""SELECT s.asset_identifier AS src_ip, s.latitude AS src_lat, s.longitude AS src_lon, s.country_iso AS src_country_iso, s.country_name AS src_country,
  s.city AS src_city, t.asset_identifier AS dest_ip, COUNT(event_id) AS attack_count, COUNT(DISTINCT attack_sk) AS attack_families,
  MIN(event_time) AS first_seen, MAX(event_time) AS last_seen FROM fx_fact JOIN fx_asset s ON s.asset_sk = src_asset_sk
  JOIN fx_asset t ON t.asset_sk = dest_asset_sk WHERE is_attack = 1 AND s.is_internal = 0 AND t.is_internal = 1 AND s.latitude IS NOT NULL
  AND s.longitude IS NOT NULL GROUP BY ALL""")
def attack_edges(d: Data):
    return R.attack_edges(d.fact, d.asset)


@query(f"""SELECT CASE WHEN hour(event_time) BETWEEN 9 AND 16 THEN 'Working hours (9 AM - 5 PM)' ELSE 'After hours' END AS time_period,
  t.attack_family, COUNT(*) AS events FROM {STAR} WHERE is_attack = 1 GROUP BY ALL""")
def working_hours(d: Data):
    return R.working_hours(d.fact, D.dim_time(d.spark), _types(d))


@query(f"SELECT {DAY}::DATE AS full_date, dayname({DAY}) AS day_name, COUNT(*) AS events FROM fx_fact f GROUP BY ALL")
def events_per_day(d: Data):
    return R.events_per_day(d.fact, _dates(d))


@query(f"""SELECT t.attack_label, t.attack_family, {DAY}::DATE AS full_date, strftime(MIN(event_time), '%H:%M:%S') AS first_seen,
  strftime(MAX(event_time), '%H:%M:%S') AS last_seen, COUNT(*) AS events FROM {STAR} WHERE t.attack_label NOT IN ('BENIGN', 'Unlabeled') GROUP BY ALL""")
def attack_periods(d: Data):
    return R.attack_periods(d.fact, _dates(d), _types(d))


@query("""SELECT event_time, s.asset_identifier AS src_ip, t.asset_identifier AS dest_ip, flow_duration FROM fx_fact JOIN fx_asset s ON s.asset_sk = src_asset_sk
  JOIN fx_asset t ON t.asset_sk = dest_asset_sk WHERE attack_label = 'Heartbleed'""")
def label_events(d: Data):
    return R.label_events(d.fact, d.asset, _types(d), "Heartbleed")


@query(f"""SELECT COUNT(*) AS external_ips, COUNT(country_iso) AS with_country, COUNT(latitude) AS with_coords, COUNT(abuse_confidence) AS with_reputation,
  {_pct('COUNT(country_iso)', 'COUNT(*)')} AS pct_geo, {_pct('COUNT(abuse_confidence)', 'COUNT(*)')} AS pct_rep FROM fx_asset WHERE is_internal = 0""")
def geo_coverage(d: Data):
    return R.geo_coverage(d.asset)


# ---- load validation and quality --------------------------------------------------------------------

@query("""SELECT COUNT(*) AS total_rows, COUNT(src_asset_sk) AS has_src_asset, COUNT(dest_asset_sk) AS has_dest_asset, COUNT(attack_sk) AS has_attack,
  COUNT(is_attack) AS has_flag FROM fx_fact""")
def key_presence(d: Data):
    return G.key_presence(d.fact, {
        "has_src_asset": "src_asset_sk", "has_dest_asset": "dest_asset_sk", "has_attack": "attack_sk", "has_flag": "is_attack"})


@query("""SELECT COUNT(*) AS fact_rows, COUNT(DISTINCT f.date_sk) AS distinct_dates, COUNT(d) AS resolved_dates, MIN(d) AS earliest, MAX(d) AS latest
  FROM fx_fact f LEFT JOIN (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) o ON year(d) * 10000 + month(d) * 100 + day(d) = f.date_sk""")
def date_integrity(d: Data):
    dates = D.dim_date_over(d.orders, "o_orderdate")
    seen = d.orders.select(F.col("o_orderdate").cast("date").alias("full_date")).distinct()
    return G.date_integrity(d.fact, dates.join(seen, "full_date", "left_semi"))


@query("""SELECT l_orderkey, COUNT(*) AS rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1""")
def orphan_rows(d: Data):
    known = d.orders.filter(F.col("o_orderstatus") != "P")
    return J.orphans(d.lineitem, known, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("rows"))


def _checks(d: Data):
    known = d.asset.filter((F.col("is_internal") == 1) | F.col("country_iso").isNotNull())
    return {
        "row_count": Q.row_count(d.fact, 60000),
        "assets": Q.asset_keys(d.fact, known),
        "attack_type": Q.foreign_keys(d.fact, _types(d).filter(F.col("severity") != "low"), "attack_sk", "attack_sk"),
        "dates": Q.foreign_keys(d.fact, D.dim_date(d.spark), "date_sk", "date_sk", True),
        "benign": Q.benign_share(d.fact),
        "window": Q.label_window(d.fact, _types(d), "Heartbleed", "2017-07-05", 15),
        "coverage": Q.coverage(d.asset),
        "population": Q.population(d.customer),
    }


@query(f"""SELECT 'row_count' AS check_name, COUNT(*) = 60000 AS passed, COUNT(*)::VARCHAR AS actual FROM fx_fact
  UNION ALL SELECT 'assets', COUNT(*) = 0, COUNT(*)::VARCHAR FROM fx_fact WHERE src_asset_sk NOT IN (SELECT asset_sk FROM fx_asset WHERE is_internal = 1 OR country_iso IS NOT NULL)
  UNION ALL SELECT 'attack_type', COUNT(*) = 0, COUNT(*)::VARCHAR FROM fx_fact JOIN fx_attack_type t USING (attack_sk) WHERE severity = 'low'
  UNION ALL SELECT 'dates', COUNT(*) = 0, COUNT(*)::VARCHAR FROM fx_fact WHERE date_sk NOT BETWEEN 20100101 AND 20171231
  UNION ALL SELECT 'benign', p BETWEEN 50 AND 95, p::VARCHAR || '%' FROM (SELECT {_pct("COUNT(*) FILTER (WHERE attack_family_denorm = 'Benign')", 'COUNT(*)')} AS p FROM fx_fact) b
  UNION ALL SELECT 'coverage', p >= 80, p::VARCHAR || '% (' || k || '/' || n || ')' FROM (SELECT COUNT(country_iso) AS k, COUNT(*) AS n, {_pct('COUNT(country_iso)', 'COUNT(*)')} AS p FROM fx_asset WHERE is_internal = 0) c
  UNION ALL SELECT 'population', true, COUNT(*)::VARCHAR FROM customer""")
def quality_checks(d: Data):
    frames = {k: v for k, v in _checks(d).items() if k != "window"}
    return FL.union_all([
        f.select(F.lit(name).alias("check_name"), "passed", "actual") for name, f in frames.items()])


@query("""SELECT CASE WHEN COUNT(*) = 0 THEN true ELSE min(event_time)::DATE = DATE '2017-07-05' AND max(event_time)::DATE = DATE '2017-07-05' AND hour(min(event_time)) = 15 END AS passed,
  '2017-07-05 15h' AS expected, 'events outside the documented window' AS message, 'error' AS severity FROM fx_fact WHERE attack_label = 'Heartbleed'""")
def quality_label_window(d: Data):
    return _checks(d)["window"].select("passed", "expected", "message", "severity")


@query()
def quality_results(d: Data):
    checks = Q.flow_checks(d.fact, d.asset, _types(d), D.dim_date(d.spark), d.customer, 1)
    broken = Q.Check("broken", "row_count", lambda: d.fact.select("no_such_column"))
    return Q.run_checks(d.spark, [*checks, broken], "run").drop("checked_at")


@query(f"""WITH x AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE attack_family_denorm = 'Benign') AS benign,
    COUNT(*) FILTER (WHERE src_asset_sk NOT IN (SELECT asset_sk FROM fx_asset WHERE is_internal = 1 OR country_iso IS NOT NULL)
      OR dest_asset_sk NOT IN (SELECT asset_sk FROM fx_asset WHERE is_internal = 1 OR country_iso IS NOT NULL)) AS hosts,
    COUNT(*) FILTER (WHERE attack_sk IN (SELECT attack_sk FROM fx_attack_type WHERE severity = 'low')) AS types,
    COUNT(*) FILTER (WHERE date_sk IS NULL OR date_sk NOT BETWEEN 20100101 AND 20171231) AS days FROM fx_fact),
  c AS (SELECT COUNT(country_iso) AS k, COUNT(*) AS n, coalesce({_pct('COUNT(country_iso)', 'COUNT(*)')}, 0.0) AS p FROM fx_asset
    WHERE is_internal = 0 AND country_iso IS NOT NULL),
  b AS (SELECT n, coalesce({_pct('benign', 'n')}, 0.0) AS p FROM x),
  h AS (SELECT COUNT(*) AS n, min(event_time) AS a, max(event_time) AS z FROM fx_fact WHERE attack_label = 'Heartbleed')
  SELECT 'fact_row_count_matches_loaded' AS check_name, 'row_count' AS check_category, 'error' AS severity, (n = 60000)::INT AS passed, '60000' AS expected_value,
    n::VARCHAR AS actual_value, 'fact has ' || n || ' rows, loader reported 60000' AS message FROM x
  UNION ALL SELECT 'fk_integrity_assets', 'fk_integrity', 'error', (hosts = 0)::INT, '0', hosts::VARCHAR, hosts || ' rows with unknown hosts' FROM x
  UNION ALL SELECT 'fk_integrity_attack_type', 'fk_integrity', 'error', (types = 0)::INT, '0', types::VARCHAR, types || ' rows with unknown attack_sk' FROM x
  UNION ALL SELECT 'fk_integrity_dates', 'fk_integrity', 'error', (days = 0)::INT, '0', days::VARCHAR, days || ' rows with unknown date_sk' FROM x
  UNION ALL SELECT 'attack_distribution_benign_ratio', 'distribution', CASE WHEN n < 100 THEN 'info' ELSE 'warning' END, (n < 100 OR p BETWEEN 50 AND 95)::INT, '50-95%', p::VARCHAR || '%',
    CASE WHEN n < 100 THEN 'Skipped: dataset too small' ELSE 'share of benign rows' END FROM b
  UNION ALL SELECT 'label_window_matches_documentation', 'temporal', CASE WHEN n = 0 THEN 'info' ELSE 'error' END,
    coalesce(n = 0 OR (a::DATE = DATE '2017-07-05' AND z::DATE = DATE '2017-07-05' AND hour(a) = 15), false)::INT, '2017-07-05 15h',
    CASE WHEN n = 0 THEN 'absent' ELSE a::VARCHAR || ' to ' || z::VARCHAR || ' (' || n || ' events)' END,
    CASE WHEN n = 0 THEN 'Skipped: label not present' WHEN a::DATE = DATE '2017-07-05' AND z::DATE = DATE '2017-07-05' AND hour(a) = 15 THEN 'OK' ELSE 'events outside the documented window' END FROM h
  UNION ALL SELECT 'external_ip_geo_coverage', 'enrichment', CASE WHEN n = 0 THEN 'info' ELSE 'warning' END, (n = 0 OR p >= 80)::INT, '>=80%', p::VARCHAR || '% (' || k || '/' || n || ')',
    CASE WHEN n = 0 THEN 'nothing to check' ELSE 'country_iso known for external hosts' END FROM c
  UNION ALL SELECT 'user_population', 'row_count', 'info', 1, 'any', COUNT(*)::VARCHAR, COUNT(*) || ' rows' FROM customer""")
def quality_findings(d: Data):
    """All standard checks of a load as one plan over one pass of the fact; some hosts and types count as unknown."""
    known = d.asset.filter((F.col("is_internal") == 1) | F.col("country_iso").isNotNull())
    return Q.flow_findings(d.fact, known, _types(d).filter(F.col("severity") != "low"), D.dim_date(d.spark), d.customer, 60000)


@query(f"""SELECT k AS table_name, n AS rows FROM (SELECT 'events' AS k, COUNT(*) AS n FROM events UNION ALL SELECT 'orders', COUNT(*) FROM orders
  UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem UNION ALL SELECT 'documents', COUNT(*) FROM documents) c""")
def table_counts(d: Data):
    return G.table_counts({t: getattr(d, t) for t in ("events", "orders", "lineitem", "documents")})


# ---- scores -------------------------------------------------------------------------------------------

FUSED = "0.65::DOUBLE * greatest(a, b) + 0.15::DOUBLE * c + 0.20::DOUBLE * w"


@query(f"""WITH named AS (SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN 'DDoS' WHEN 'MACHINERY' THEN 'DoS' WHEN 'AUTOMOBILE' THEN 'Web Attack'
    WHEN 'FURNITURE' THEN 'Reconnaissance' ELSE 'Mystery' END AS family FROM customer),
  rated AS (SELECT c_custkey, family, (c_acctbal + 1000) / 10000 AS a, (10000 - c_acctbal) / 10000 AS b, c_nationkey / 25.0::DOUBLE AS c,
    CASE family WHEN 'DDoS' THEN 'critical' WHEN 'DoS' THEN 'high' WHEN 'Web Attack' THEN 'medium' WHEN 'Reconnaissance' THEN 'low' ELSE 'info' END AS severity FROM named),
  weighed AS (SELECT *, CASE severity WHEN 'critical' THEN 1e0 WHEN 'high' THEN 7e-1 WHEN 'medium' THEN 4e-1 WHEN 'low' THEN 2e-1 ELSE 0e0 END AS w FROM rated)
  SELECT c_custkey, family, severity, w, greatest(least({FUSED}, 1e0), 0e0) AS priority_score,
  greatest(least({FUSED} + CASE WHEN least(a, b) > 0.95 THEN 1e-1 ELSE 0e0 END, 1e0), 0e0) AS with_bonus FROM weighed""")
def priority_fusion(d: Data):
    family = NUM.lookup(F.col("c_mktsegment"), {
        "BUILDING": "DDoS", "MACHINERY": "DoS", "AUTOMOBILE": "Web Attack", "FURNITURE": "Reconnaissance", "HOUSEHOLD": "Mystery"})
    rows = d.customer.select(
        "c_custkey", family.alias("family"), ((F.col("c_acctbal") + 1000) / 10000).alias("a"),
        ((10000 - F.col("c_acctbal")) / 10000).alias("b"), (F.col("c_nationkey") / F.lit(25.0)).alias("c"))
    severity = S.family_severity(F.col("family"))
    parts = (F.col("a"), F.col("b"), F.col("c"), S.severity_weight(severity))
    return rows.select(
        "c_custkey", "family", severity.alias("severity"), parts[3].alias("w"), S.priority_score(*parts).alias("priority_score"),
        S.priority_score(*parts, certainty_bonus=True).alias("with_bonus"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s >= 0.75 THEN 'critical' WHEN s >= 0.55 THEN 'high' WHEN s >= 0.35 THEN 'medium' WHEN s >= 0.15 THEN 'low' ELSE 'info' END AS priority,
  CASE WHEN s >= 0.5 THEN 'high' WHEN s >= 0.315 THEN 'elevated' WHEN s >= 0.1 THEN 'low' ELSE 'baseline' END AS risk FROM (SELECT *, l_quantity / 50 AS s FROM lineitem) x""")
def score_labels(d: Data):
    score = F.col("l_quantity") / 50
    return d.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", S.priority_label(score).alias("priority"), S.risk_label(score).alias("risk"))


@query("""SELECT event_id, user_id, CASE WHEN r.e IS NOT NULL THEN round(r.v, 4) ELSE NULL END AS priority_score, CASE WHEN r.e IS NOT NULL THEN 'new' ELSE 'old' END AS priority_label
  FROM events LEFT JOIN (SELECT event_id AS e, value / 500 AS v FROM events WHERE event_type = 'error') r ON r.e = event_id""")
def score_write_back(d: Data):
    fact = d.events.select("event_id", "user_id", F.lit("old").alias("priority_label"))
    scores = d.events.filter(F.col("event_type") == "error").select(
        "event_id", (F.col("value") / 500).alias("priority_score"), F.lit("new").alias("priority_label"), F.lit(0.5).alias("anomaly_score"))
    return scoring.write_back(fact, scores, "v1").select("event_id", "user_id", "priority_score", "priority_label")


@query("""SELECT event_id, date_sk, CASE WHEN event_type = 'error' THEN round(value / 500, 4) WHEN date_sk % 2 = 1 THEN 0.125 END AS priority_score,
    CASE WHEN event_type = 'error' OR date_sk % 2 = 1 THEN 'v2' ELSE 'v1' END AS model_version
  FROM (SELECT event_id, event_type, value, year(ts) * 100 + month(ts) AS date_sk FROM events) e
  WHERE date_sk IN (SELECT year(ts) * 100 + month(ts) FROM events WHERE event_type = 'error')""")
def score_write_back_by_bucket(d: Data):
    """Months as days: all are scored once, then the odd ones once more and errors anew; both runs join bucket with bucket."""
    name = f"scored_{uuid.uuid4().hex}"
    month = F.year("ts") * 100 + F.month("ts")
    rows = d.events.select("event_id", "event_type", "value", month.alias("date_sk"))
    write_bucketed(rows.drop("value"), f"{name}_fact", "event_id", 8, "date_sk")
    error = F.col("event_type") == "error"
    for version, part in (("v1", rows.where(F.lit(True))), ("v2", rows)):
        score = F.when(error, F.col("value") / 500).when(F.col("date_sk") % 2 == 1, 0.125)
        labels = [score.alias("priority_score"), F.lit("x").alias("priority_label"), F.lit(0.5).alias("anomaly_score")]
        wanted = part if version == "v1" else part.where(error | (F.col("date_sk") % 2 == 1))
        write_bucketed(wanted.select("event_id", "date_sk", *labels), f"{name}_{version}", "event_id", 8)
        out = scoring.write_back_days(f"{name}_fact", f"{name}_{version}", f"{name}_out", version, 8)
    hit = F.when(F.col("model_version").isNull(), "v1").otherwise(F.col("model_version"))
    return out.select("event_id", "date_sk", "priority_score", hit.alias("model_version"))


# ---- order, sets, samples ----------------------------------------------------------------------------

@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def global_sort(d: Data):
    return d.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy("l_extendedprice")


@query("""SELECT event_id, attack_label, priority_score FROM fx_fact WHERE priority_label = 'critical'
  ORDER BY priority_score DESC, event_id, attack_label LIMIT 10""")
def largest_scores(d: Data):
    critical = d.fact.filter(F.col("priority_label") == "critical")
    return O.largest(critical, [F.desc("priority_score"), F.asc("event_id"), F.asc("attack_label")], 10).select("event_id", "attack_label", "priority_score")


@query("SELECT id, kind, amount FROM (SELECT o_orderkey AS id, 'order' AS kind, o_totalprice AS amount FROM orders UNION ALL SELECT c_custkey, 'customer', NULL FROM customer) u")
def union_with_missing_columns(d: Data):
    return FL.union_all([
        d.orders.select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_totalprice").alias("amount")),
        d.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))])


@query("SELECT (SELECT COUNT(*) FROM orders) + (SELECT COUNT(*) FROM customer) AS rows, (SELECT COUNT(*) FROM orders) + (SELECT COUNT(*) FROM customer) AS expected, true AS matches")
def union_reconciliation(d: Data):
    parts = [d.orders.select(F.col("o_orderkey").alias("id")), d.customer.select(F.col("c_custkey").alias("id"))]
    return reconcile(FL.union_all(parts), parts)


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def distinct_union(d: Data):
    return FL.distinct_union([
        d.orders.select(F.col("o_custkey").alias("k")), d.customer.filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("k"))], ["k"])


RECENT = "(SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')"
ALL_KEYS = "(SELECT DISTINCT o_custkey AS k FROM orders)"


def _key_sets(d: Data):
    everyone = d.orders.select(F.col("o_custkey").alias("k"))
    recent = d.orders.filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("k"))
    return everyone, recent


@query(f"SELECT k FROM {ALL_KEYS} a WHERE k NOT IN (SELECT k FROM {RECENT} r)")
def keys_missing(d: Data):
    return FL.keys_missing(*_key_sets(d), ["k"])


@query(f"SELECT k FROM {ALL_KEYS} a WHERE k IN (SELECT k FROM {RECENT} r)")
def keys_shared(d: Data):
    return FL.keys_shared(*_key_sets(d), ["k"])


@query(f"SELECT COUNT(DISTINCT o_custkey) AS in_left, (SELECT COUNT(*) FROM {RECENT} r) AS in_right, (SELECT COUNT(*) FROM {RECENT} r) AS in_both FROM orders")
def key_overlap(d: Data):
    return J.key_overlap(*_key_sets(d), "k")


@query("""SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR || '|42')) <= 50""")
def stratified_sample(d: Data):
    return SA.stratified_sample(d.events.select("event_id", "event_type"), ["event_type"], ["event_id"], 50)


@query("""SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR || '|42')) <= 12""")
def extract_sample(d: Data):
    return SA.extract_sample(d.events.select("event_id", "event_type"), "event_type", ["event_id"], 120)


SPLIT = """(SELECT *, CASE WHEN rn <= round(n * 0.2::DOUBLE) THEN 'test' WHEN rn <= round(n * 0.2::DOUBLE) + round(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM (
  SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR || '|42')) AS rn, COUNT(*) OVER (PARTITION BY event_type) AS n FROM events) r)"""


@query(f"SELECT event_id, event_type, split FROM {SPLIT} s")
def stratified_split(d: Data):
    return SA.stratified_split(d.events.select("event_id", "event_type"), ["event_type"], ["event_id"])


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 1000")
def row_limited_run(d: Data):
    return SA.first_rows(d.events.select("event_id", "value"), "event_id", 1000)


@query("""SELECT l_returnflag, l_shipmode_day, cnt FROM (SELECT l_returnflag, dayname(l_shipdate) AS l_shipmode_day, COUNT(*) AS cnt FROM lineitem GROUP BY 1, 2) g
  QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY cnt DESC, l_shipmode_day) = 1""")
def top_item_per_group(d: Data):
    rows = d.lineitem.select("l_returnflag", F.date_format("l_shipdate", "EEEE").alias("l_shipmode_day"))
    return O.top_per_group(rows, ["l_returnflag"], ["l_shipmode_day"])


@query("SELECT round(avg(l_quantity), 1) AS avg_l_quantity, round(stddev(l_quantity), 1) AS std_l_quantity FROM lineitem")
def mean_and_spread(d: Data):
    return G.mean_and_spread(d.lineitem, ["l_quantity"])


@query("""SELECT CASE WHEN p_size < 10 THEN '00-09' WHEN p_size < 20 THEN '10-19' WHEN p_size < 30 THEN '20-29' WHEN p_size < 40 THEN '30-39' ELSE '40+' END AS bucket,
  COUNT(*) AS cnt, MIN(p_size) AS lowest FROM part GROUP BY 1""")
def tens_buckets(d: Data):
    from threatlake.functions.activity import tens_bucket

    return G.bucket_counts(d.part, tens_bucket(F.col("p_size")), "p_size")


@query("""SELECT CASE WHEN l_extendedprice < 10000 THEN '< 10 KB' WHEN l_extendedprice < 100000 THEN '10-100 KB' WHEN l_extendedprice < 1000000 THEN '100 KB - 1 MB'
  WHEN l_extendedprice < 10000000 THEN '1-10 MB' ELSE '> 10 MB' END AS bucket, COUNT(*) AS cnt, MIN(l_extendedprice) AS lowest FROM lineitem GROUP BY 1""")
def size_buckets(d: Data):
    from threatlake.functions.activity import size_bucket

    return G.bucket_counts(d.lineitem, size_bucket(F.col("l_extendedprice")), "l_extendedprice")


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, COUNT(*) AS events FROM orders GROUP BY 1")
def monthly_events(d: Data):
    return G.monthly(d.orders, "o_orderdate")


@query("SELECT hour(ts) AS hour, COUNT(*) AS events FROM events GROUP BY 1")
def hourly_events(d: Data):
    return G.hourly(d.events, "ts")


LABELS = ["critical", "high", "medium", "low", "info"]


@query("""SELECT COALESCE(CASE WHEN grouping(attack_family_denorm) = 1 THEN 'Total' ELSE attack_family_denorm END) AS attack_family_denorm,
  {0}, COUNT(*) AS "Total" FROM fx_fact WHERE priority_label IS NOT NULL GROUP BY ROLLUP (attack_family_denorm)""".format(
    ", ".join(f"COUNT(*) FILTER (WHERE priority_label = '{x}') AS {x}" for x in LABELS)))
def cross_tab(d: Data):
    return G.cross_tab(d.fact.filter(F.col("priority_label").isNotNull()), "attack_family_denorm", "priority_label", LABELS)


@query("""SELECT l_returnflag, COUNT(l_extendedprice) AS count, round(AVG(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
  round(stddev_samp(l_extendedprice), 4) AS std, round(MIN(l_extendedprice), 4) AS min, round(MAX(l_extendedprice), 4) AS max FROM lineitem GROUP BY 1""")
def score_summary(d: Data):
    return G.score_summary(d.lineitem, ["l_returnflag"], "l_extendedprice")


@query("""SELECT COUNT(value) AS count, round(AVG(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(MIN(value), 4) AS min, round(MAX(value), 4) AS max,
  round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75 FROM events""")
def score_description(d: Data):
    return G.describe_score(d.events, "value")


@query("SELECT round(quantile_cont(l_extendedprice, 0.99), 6) AS threshold FROM lineitem")
def percentile_threshold(d: Data):
    return O.exact_percentile(d.lineitem, [], "l_extendedprice", 0.99, "threshold").select(F.round("threshold", 6).alias("threshold"))


@query(f"""SELECT 'tax_ratio' AS feature, COUNT(*) FILTER (WHERE l_discount = 0 AND l_tax = 0) AS missing, COUNT(*) FILTER (WHERE l_discount = 0 AND l_tax <> 0) AS infinite,
  {_pct('COUNT(*) FILTER (WHERE l_discount = 0 AND l_tax = 0)', 'COUNT(*)')} AS pct FROM lineitem UNION ALL SELECT 'l_quantity', 0, 0, 0.0 FROM (SELECT COUNT(*) FROM lineitem) x""")
def feature_gaps(d: Data):
    ratio = F.when((F.col("l_discount") == 0) & (F.col("l_tax") == 0), F.lit(float("nan"))).when(
        F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax"))
    return G.feature_gaps(d.lineitem.withColumn("tax_ratio", ratio), ["tax_ratio", "l_quantity"])
