"""Report queries: executive numbers, alerts, geography, insider pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.functions.numbers import flag, percent
from threatlake.functions.scores import is_alert, is_flagged, priority_rank
from threatlake.functions.times import hour_bucket, period_label, sunday_zero, window_days
from threatlake.operators.aggregates import table_counts
from threatlake.operators.filters import after_baseline, all_of, at_least, is_in
from threatlake.operators.joins import two_role_join
from threatlake.operators.ordering import largest, latest_per_key, with_share
from threatlake.plans.views import attack_pairs


def _score(c: str, places: int = 4) -> Column:
    return F.round(F.col(c).cast("decimal(20,9)"), places).cast("double")


def warehouse_stats(tables: dict[str, DataFrame], fact: DataFrame) -> DataFrame:
    counts = table_counts(tables)
    return counts.withColumn("latest_scored_at", fact.agg(F.max("scored_at")).scalar())


def priority_distribution(fact: DataFrame) -> DataFrame:
    counts = fact.filter(F.col("priority_label").isNotNull()).groupBy("priority_label").agg(F.count("*").alias("events"))
    return with_share(counts).orderBy(priority_rank(F.col("priority_label")))


def family_distribution(fact: DataFrame) -> DataFrame:
    counts = fact.filter(F.col("attack_family_denorm").isNotNull()).groupBy(
        F.col("attack_family_denorm").alias("family"),
    ).agg(F.count("*").alias("events"), F.count_if(is_alert(F.col("priority_label"))).alias("alert_count"))
    return with_share(counts).orderBy(F.desc("events"))


def headline_kpis(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.count("*").alias("total_events"),
        F.count_if(F.col("priority_label") == "critical").alias("critical_count"),
        F.count_if(F.col("priority_label") == "high").alias("high_count"),
        F.count_if(F.col("attack_family_denorm") != "Benign").alias("attack_count"),
        F.countDistinct("src_asset_sk").alias("unique_src"), F.countDistinct("dest_asset_sk").alias("unique_dest"),
    )


def headline_shares(fact: DataFrame) -> DataFrame:
    k = headline_kpis(fact)
    return k.select(
        percent(F.col("attack_count"), F.col("total_events"), 1).alias("attack_pct"),
        percent(F.col("critical_count"), F.col("total_events"), 1).alias("critical_pct"))


def attack_timeline(fact: DataFrame) -> DataFrame:
    hostile = fact.filter(F.col("attack_family_denorm") != "Benign")
    return hostile.groupBy(
        hour_bucket(F.col("event_time")).alias("hour_bucket"), F.col("attack_family_denorm").alias("family"),
    ).agg(F.count("*").alias("events"))


def attackers_with_country(attackers: DataFrame) -> DataFrame:
    """Rows per address, not per country."""
    return attackers.filter(F.col("country_iso").isNotNull()).select(
        "country_iso", "country_name", "attack_count", "unique_targets", "attack_families_used", "first_seen", "last_seen",
    ).orderBy(F.desc("attack_count"))


def addresses_per_country(assets: DataFrame, limit: int | None = None) -> DataFrame:
    external = assets.filter((F.col("is_internal") == 0) & F.col("country_iso").isNotNull())
    counts = external.groupBy("country_iso", "country_name").agg(F.count("*").alias("distinct_ips"))
    ordered = counts.orderBy(F.desc("distinct_ips"), "country_iso", "country_name")
    return ordered.limit(limit) if limit else ordered


def heatmap(pattern: DataFrame) -> DataFrame:
    return pattern.select("day_name", "hour_24", "attack_family", "event_count")


def top_alerts(
    fact: DataFrame, assets: DataFrame, limit: int = 100, labels: list | None = None, families: list | None = None,
    source_countries: list | None = None, min_score: float = 0.0, tie: list[str] | None = None,
) -> DataFrame:
    """Highest scored alerts with both hosts; filters are optional and AND-ed.

    The first rows are taken before the hosts are looked up; every host key of the fact is known (a quality check).
    """
    scored = fact.filter(all_of(
        F.col("priority_label").isNotNull(), is_in(F.col("priority_label"), labels),
        is_in(F.col("attack_family_denorm"), families), at_least(F.col("priority_score"), min_score)))
    order = [F.desc("priority_score"), F.desc("event_time"), *[F.col(c) for c in tie or ["event_id"]]]
    scored = scored.filter(F.col("src_asset_sk").isNotNull() & F.col("dest_asset_sk").isNotNull())
    if source_countries:
        origins = assets.filter(is_in(F.col("country_iso"), source_countries)).select(F.col("asset_sk").alias("src_asset_sk"))
        scored = scored.join(origins, "src_asset_sk", "left_semi")
    first = two_role_join(
        largest(scored, order, limit), assets, "asset_sk", {"src": "src_asset_sk", "dest": "dest_asset_sk"},
        ["asset_identifier", "country_iso", "is_internal"])
    return first.orderBy(*order).select(
        "event_id", "event_time", F.col("src_asset_identifier").alias("src_ip"), F.col("src_country_iso").alias("src_country"),
        F.col("src_is_internal").alias("src_internal"), F.col("dest_asset_identifier").alias("dest_ip"),
        F.col("dest_country_iso").alias("dest_country"), F.col("dest_is_internal").alias("dest_internal"),
        F.col("attack_family_denorm").alias("attack_family"), _score("priority_score").alias("priority_score"),
        "priority_label", _score("anomaly_score").alias("anomaly_score"), "flow_duration", "total_fwd_packets",
        "total_bwd_packets", "is_attack")


def family_options(fact: DataFrame) -> DataFrame:
    families = fact.filter(F.col("attack_family_denorm").isNotNull())
    return families.select(F.col("attack_family_denorm").alias("family")).distinct().orderBy("family")


def country_options(fact: DataFrame, assets: DataFrame) -> DataFrame:
    """Countries of sources with critical or high alerts; sources are made distinct before the join."""
    sources = fact.filter(is_alert(F.col("priority_label"))).select("src_asset_sk").distinct()
    located = assets.filter(F.col("country_iso").isNotNull()).select(
        F.col("asset_sk").alias("src_asset_sk"), F.col("country_iso").alias("iso"), F.col("country_name").alias("name"))
    return sources.join(located, "src_asset_sk").select("iso", "name").distinct().orderBy("iso", "name")


def attacker_details(fact: DataFrame, assets: DataFrame, limit: int = 100) -> DataFrame:
    columns = ("country_iso", "country_name", "city", "latitude", "longitude", "asn_org", "is_known_attacker")
    located = assets.filter((F.col("is_internal") == 0) & F.col("country_iso").isNotNull()).select(
        F.col("asset_sk").alias("src_asset_sk"), F.col("asset_identifier").alias("ip"), *columns)
    attacks = attack_pairs(fact).join(located, "src_asset_sk")
    details = attacks.groupBy("ip", *columns).agg(
        F.sum("events").alias("attack_count"), F.countDistinct("dest_asset_sk").alias("unique_targets"))
    return largest(details.filter(F.col("attack_count") > 0), [F.desc("attack_count"), F.asc("ip")], limit)


def geo_summary(assets: DataFrame) -> DataFrame:
    return assets.filter(F.col("is_internal") == 0).agg(
        F.countDistinct("asset_identifier").alias("total_external_ips"),
        F.countDistinct("country_iso").alias("distinct_countries"),
        F.countDistinct(F.when(F.col("country_iso").isNull(), F.col("asset_identifier"))).alias("unmapped_ips"))


def internal_targets(fact: DataFrame, assets: DataFrame) -> DataFrame:
    inside = assets.filter(F.col("is_internal") == 1).select(
        F.col("asset_sk").alias("dest_asset_sk"), F.col("asset_identifier").alias("internal_ip"))
    return attack_pairs(fact).join(inside, "dest_asset_sk").groupBy("internal_ip").agg(
        F.sum("events").alias("attack_count"), F.countDistinct("src_asset_sk").alias("unique_attackers"),
        F.countDistinct("attack_sk").alias("attack_types_seen")).orderBy(F.desc("attack_count"), "internal_ip")


def attack_edges(fact: DataFrame, assets: DataFrame) -> DataFrame:
    """External source to internal target with coordinates."""
    sources = assets.filter(
        (F.col("is_internal") == 0) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
    ).select(
        F.col("asset_sk").alias("src_asset_sk"), F.col("asset_identifier").alias("src_ip"),
        F.col("latitude").alias("src_lat"), F.col("longitude").alias("src_lon"),
        F.col("country_iso").alias("src_country_iso"), F.col("country_name").alias("src_country"),
        F.col("city").alias("src_city"))
    targets = assets.filter(F.col("is_internal") == 1).select(
        F.col("asset_sk").alias("dest_asset_sk"), F.col("asset_identifier").alias("dest_ip"))
    edge = ["src_ip", "src_lat", "src_lon", "src_country_iso", "src_country", "src_city", "dest_ip"]
    return attack_pairs(fact).join(sources, "src_asset_sk").join(targets, "dest_asset_sk").groupBy(*edge).agg(
        F.sum("events").alias("attack_count"), F.countDistinct("attack_sk").alias("attack_families"),
        F.min("first").alias("first_seen"), F.max("last").alias("last_seen")).orderBy(F.desc("attack_count"), "src_ip", "dest_ip")


def working_hours(fact: DataFrame, times: DataFrame, attack_types: DataFrame) -> DataFrame:
    counted = fact.filter(F.col("is_attack") == 1).groupBy("time_sk", "attack_sk").agg(F.count("*").alias("n"))
    joined = counted.join(times.select("time_sk", "hour_24"), "time_sk").join(
        attack_types.select("attack_sk", "attack_family"), "attack_sk")
    return joined.groupBy(period_label(F.col("hour_24")).alias("time_period"), "attack_family").agg(
        F.sum("n").alias("events"))


# ---- insider pages -----------------------------------------------------------------------------

def latest_users(users: DataFrame) -> DataFrame:
    return latest_per_key(users, ["user_id"], ["valid_from"])


def insider_kpis(scores: DataFrame, fact: DataFrame) -> DataFrame:
    """Recall and precision of the flagged users plus event totals, one row."""
    flagged = is_flagged(F.col("risk_label"))
    truth = F.col("is_malicious_truth") == 1
    users = scores.agg(
        F.count("*").alias("total_users"), F.count_if(truth).alias("malicious_truth"),
        F.count_if(flagged).alias("flagged_users"), F.count_if(flagged & truth).alias("flagged_correctly"))
    events = fact.agg(F.struct(
        F.count("*").alias("total_events"), F.sum("in_attack_window").alias("attack_window_events"),
        F.sum("is_after_hours").alias("after_hours_events"), F.countDistinct("user_sk").alias("distinct_users")))
    one = F.lit(1).cast("bigint")
    return users.withColumns({
        "recall": percent(F.col("flagged_correctly"), F.greatest("malicious_truth", one), 1),
        "precision": percent(F.col("flagged_correctly"), F.greatest("flagged_users", one), 1),
        "_events": events.scalar(),
    }).select("*", "_events.*").drop("_events")


def risk_leaderboard(
    scores: DataFrame, users: DataFrame, min_score: float = 0.0, labels: list | None = None, scenarios: list | None = None,
) -> DataFrame:
    """Scores on the latest version of each user."""
    columns = ("user_sk", "user_id", "employee_name", "role", "department", "team", "supervisor_name",
               "malicious_scenario", "attack_window_start", "attack_window_end", "is_current")
    newest = latest_users(users).select(*columns)
    wanted = scores.filter(all_of(at_least(F.col("risk_score"), min_score), is_in(F.col("risk_label"), labels)))
    joined = wanted.drop("malicious_scenario").join(newest, "user_sk").filter(
        all_of(is_in(F.coalesce(F.col("malicious_scenario"), F.lit(0)), scenarios)))
    return joined.select(
        "user_id", "employee_name", "role", "department", "team", "supervisor_name",
        F.col("is_current").alias("employment_active"), _score("risk_score").alias("risk_score"), "risk_label",
        "is_malicious_truth", "malicious_scenario", "attack_window_start", "attack_window_end",
    ).orderBy(F.desc("risk_score"))


def scenario_summary(scores: DataFrame, users: DataFrame) -> DataFrame:
    newest = latest_users(users).select("user_sk", F.coalesce("malicious_scenario", F.lit(0)).alias("scenario"))
    joined = scores.join(newest, "user_sk")
    flagged = F.count_if(is_flagged(F.col("risk_label")))
    return joined.groupBy("scenario").agg(
        F.count("*").alias("users"), flagged.alias("flagged"), F.avg("risk_score").alias("avg_risk_score"),
        F.max("risk_score").alias("max_risk_score"), F.min("risk_score").alias("min_risk_score"),
        percent(flagged, F.count("*"), 1).alias("catch_rate_pct")).orderBy("scenario")


def _of_user(users: DataFrame, user_id) -> DataFrame:
    return users if user_id is None else users.filter(F.col("user_id") == user_id)


def activity_timeline(users: DataFrame, features: DataFrame, baselines: DataFrame, user_id=None) -> DataFrame:
    """Feature days of one user (or of everyone) beside the personal baseline."""
    newest = latest_users(_of_user(users, user_id)).select(
        "user_sk", "attack_window_start", "attack_window_end", "is_malicious", "malicious_scenario")
    days = features.select(
        "user_sk", "feature_date", "events_total", "usb_connects", "emails_sent", "ext_emails", "file_accesses", "logons",
        "after_hours_events", "weekend_events", "usb_zscore_peer", "usb_ratio_personal", "multi_signal_count",
        "in_attack_window")
    usual = baselines.select(
        "user_sk", "baseline_usb_per_day", "baseline_ext_emails_per_day", "baseline_after_hours_pct")
    return newest.join(days, "user_sk").join(usual, "user_sk", "left").orderBy("feature_date", "user_sk")


def user_options(users: DataFrame) -> DataFrame:
    return latest_users(users).select("user_id", "employee_name", "role", "department", "is_current")


def user_profile(users: DataFrame, scores: DataFrame, baselines: DataFrame, user_id=None) -> DataFrame:
    newest = latest_users(_of_user(users, user_id))
    risk = scores.select("user_sk", "risk_score", "risk_label")
    usual = baselines.select(
        "user_sk", "baseline_usb_per_day", "baseline_emails_per_day", "baseline_ext_emails_per_day",
        "baseline_files_per_day", "baseline_after_hours_pct", "baseline_weekend_pct", "baseline_active_days",
        "baseline_from", "baseline_to")
    return newest.join(risk, "user_sk", "left").join(usual, "user_sk", "left")


def scenario_profile(users: DataFrame, features: DataFrame, baselines: DataFrame) -> DataFrame:
    """Means and peaks per user after the baseline, then averaged per scenario."""
    newest = latest_users(users).select("user_sk", F.coalesce("malicious_scenario", F.lit(0)).alias("scenario"))
    later = after_baseline(features.drop("malicious_scenario"), baselines).join(newest, "user_sk")
    means = {"avg_daily_usb": "usb_connects", "avg_daily_ext_emails": "ext_emails", "avg_daily_files": "file_accesses",
             "avg_after_hours_pct": "after_hours_pct"}
    peaks = {"avg_peak_usb_z": "usb_zscore_peer", "avg_peak_usb_ratio": "usb_ratio_personal",
             "avg_peak_signals": "multi_signal_count"}
    per_user = later.groupBy("user_sk", "scenario").agg(
        *[F.avg(c).alias(out) for out, c in means.items()], *[F.max(c).alias(out) for out, c in peaks.items()])
    return per_user.groupBy("scenario").agg(
        F.count("*").alias("users"), *[F.avg(out).alias(out) for out in [*means, *peaks]]).orderBy("scenario")


def insiders_detail(users: DataFrame, scores: DataFrame) -> DataFrame:
    newest = latest_users(users.filter(F.col("is_malicious") == 1))
    joined = newest.join(scores.select("user_sk", "risk_score", "risk_label"), "user_sk")
    return joined.select(
        "user_id", "employee_name", "role", "department", "malicious_scenario", "attack_window_start",
        "attack_window_end", window_days(F.col("attack_window_start"), F.col("attack_window_end")).alias("window_days"),
        F.col("is_current").alias("employment_active"), _score("risk_score").alias("risk_score"), "risk_label",
        flag(is_flagged(F.col("risk_label"))).alias("caught"),
    ).orderBy("malicious_scenario", F.desc("risk_score"))


def user_hours(users: DataFrame, fact: DataFrame, activity_types: DataFrame, user_id=None) -> DataFrame:
    """Hour x weekday x category counts of one user, or of everyone when no user is named."""
    newest = latest_users(_of_user(users, user_id)).select("user_sk")
    kinds = activity_types.select("activity_sk", "activity_category")
    counted = fact.groupBy(
        "user_sk", "activity_sk", F.hour("event_time").alias("hour_24"), sunday_zero(F.col("event_time")).alias("day_of_week"),
    ).agg(F.count("*").alias("n"))
    mine = counted.join(newest, "user_sk", "left_semi").join(kinds, "activity_sk")
    return mine.groupBy("hour_24", "day_of_week", "activity_category").agg(F.sum("n").alias("events"))


# ---- load validation ---------------------------------------------------------------------------

def events_per_day(fact: DataFrame, dates: DataFrame) -> DataFrame:
    counted = fact.groupBy("date_sk").agg(F.count("*").alias("events"))
    return counted.join(dates.select("date_sk", "full_date", "day_name"), "date_sk").select(
        "full_date", "day_name", "events").orderBy("full_date")


def attack_periods(fact: DataFrame, dates: DataFrame, attack_types: DataFrame) -> DataFrame:
    """First and last clock time of each hostile label on each day."""
    counted = fact.groupBy("date_sk", "attack_sk").agg(
        F.count("*").alias("events"), F.min("event_time").alias("a"), F.max("event_time").alias("b"))
    hostile = attack_types.filter(~F.col("attack_label").isin("BENIGN", "Unlabeled")).select(
        "attack_sk", "attack_label", "attack_family")
    clock = "HH:mm:ss"
    return counted.join(hostile, "attack_sk").join(dates.select("date_sk", "full_date"), "date_sk").select(
        "attack_label", "attack_family", "full_date", F.date_format("a", clock).alias("first_seen"),
        F.date_format("b", clock).alias("last_seen"), "events")


def label_events(fact: DataFrame, assets: DataFrame, attack_types: DataFrame, label: str) -> DataFrame:
    wanted = attack_types.filter(F.col("attack_label") == label).select("attack_sk")
    hosts = two_role_join(
        fact.join(wanted, "attack_sk", "left_semi"), assets, "asset_sk",
        {"src": "src_asset_sk", "dest": "dest_asset_sk"}, ["asset_identifier"])
    return hosts.select(
        "event_time", F.col("src_asset_identifier").alias("src_ip"), F.col("dest_asset_identifier").alias("dest_ip"),
        "flow_duration").orderBy("event_time")


def geo_coverage(assets: DataFrame) -> DataFrame:
    return assets.filter(F.col("is_internal") == 0).agg(
        F.count("*").alias("external_ips"), F.count("country_iso").alias("with_country"),
        F.count("latitude").alias("with_coords"), F.count("abuse_confidence").alias("with_reputation"),
        percent(F.count("country_iso"), F.count("*")).alias("pct_geo"),
        percent(F.count("abuse_confidence"), F.count("*")).alias("pct_rep"))
