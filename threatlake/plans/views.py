"""The five analytical views over the flow and activity facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _attacks(fact: DataFrame) -> DataFrame:
    return fact.filter(F.col("is_attack") == 1)


def daily_pairs(fact: DataFrame) -> DataFrame:
    """Attacks by day, source, target and label, with the sums that views need; rows of several loads add up.

    Floods repeat few pairs very often, so a hot source or target shrinks to its partners
    inside the map tasks and does not travel row by row.
    """
    identified = F.count("event_id" if "event_id" in fact.columns else "*")
    measures = {name: F.col(name) if name in fact.columns else F.lit(None).cast("double") for name in ("flow_bytes_per_sec", "flow_duration")}
    return _attacks(fact).groupBy("date_sk", "src_asset_sk", "dest_asset_sk", "attack_sk").agg(
        F.count("*").alias("n"), identified.alias("events"), F.min("event_time").alias("first"), F.max("event_time").alias("last"),
        F.sum(measures["flow_bytes_per_sec"]).alias("bytes"), F.sum(measures["flow_duration"]).alias("duration"), F.count(measures["flow_duration"]).alias("timed"))


def daily_minutes(fact: DataFrame) -> DataFrame:
    """Attacks by day, minute and label."""
    return _attacks(fact).groupBy("date_sk", "time_sk", "attack_sk").agg(F.count("*").alias("n"))


def summary_of(pairs: DataFrame, dates: DataFrame, attack_types: DataFrame) -> DataFrame:
    d = dates.select("date_sk", "full_date", "day_name")
    a = attack_types.select("attack_sk", "attack_family", "severity")
    daily = pairs.join(a, "attack_sk").groupBy("date_sk", "attack_family", "severity").agg(
        F.sum("n").alias("event_count"), F.countDistinct("src_asset_sk").alias("unique_attackers"),
        F.countDistinct("dest_asset_sk").alias("unique_targets"), F.sum("bytes").alias("total_byte_throughput"),
        F.try_divide(F.sum("duration").cast("double"), F.sum("timed")).alias("avg_flow_duration_us"))
    return daily.join(d, "date_sk").drop("date_sk")


def attack_summary(fact: DataFrame, dates: DataFrame, attack_types: DataFrame) -> DataFrame:
    """Attacks per day, family and severity. Rows are counted by pairs of hosts first, so the distinct hosts are sought among pairs;
    the calendar joins the few aggregated rows, not the fact."""
    return summary_of(daily_pairs(fact), dates, attack_types)


def attack_pairs(fact: DataFrame) -> DataFrame:
    """Attacks counted by source, target and label, before any host is joined.

    Floods repeat few pairs very often, so a hot source or target shrinks to its partners
    inside the map tasks and does not travel row by row.
    """
    identified = F.count("event_id" if "event_id" in fact.columns else "*")
    return _attacks(fact).groupBy("src_asset_sk", "dest_asset_sk", "attack_sk").agg(
        F.count("*").alias("n"), identified.alias("events"),
        F.min("event_time").alias("first"), F.max("event_time").alias("last"))


GEO = ("country_iso", "country_name", "city", "latitude", "longitude", "asn_org", "abuse_confidence")


def top_attackers(fact: DataFrame, assets: DataFrame, attack_types: DataFrame) -> DataFrame:
    """External sources with location, reach and period of their attacks."""
    return attackers_of(attack_pairs(fact), assets, attack_types)


def attackers_of(pairs: DataFrame, assets: DataFrame, attack_types: DataFrame) -> DataFrame:
    a = assets.filter(F.col("is_internal") == 0).select(
        F.col("asset_sk").alias("src_asset_sk"), F.col("asset_identifier").alias("attacker_ip"), *GEO)
    t = attack_types.select("attack_sk", "attack_family")
    return pairs.join(a, "src_asset_sk").join(t, "attack_sk").groupBy("attacker_ip", *GEO).agg(
        F.sum("n").alias("attack_count"), F.countDistinct("dest_asset_sk").alias("unique_targets"),
        F.countDistinct("attack_family").alias("attack_families_used"),
        F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
    )


def attack_targets(fact: DataFrame, assets: DataFrame, attack_types: DataFrame) -> DataFrame:
    columns = ("asset_type", "business_unit", "criticality")
    a = assets.select(F.col("asset_sk").alias("dest_asset_sk"), F.col("asset_identifier").alias("target_ip"), *columns)
    t = attack_types.select("attack_sk", "attack_family")
    return attack_pairs(fact).join(a, "dest_asset_sk").join(t, "attack_sk").groupBy("target_ip", *columns).agg(
        F.sum("n").alias("attacks_received"), F.countDistinct("src_asset_sk").alias("unique_attackers"),
        F.countDistinct("attack_family").alias("attack_families_seen"),
        F.min("first").alias("first_attacked"), F.max("last").alias("last_attacked"),
    )


USER_COLUMNS = (
    "user_id", "employee_name", "role", "department", "team",
    "ocean_o", "ocean_c", "ocean_e", "ocean_a", "ocean_n", "is_malicious", "malicious_scenario",
)


def user_risk_scoring(users: DataFrame, fact: DataFrame, activity_types: DataFrame) -> DataFrame:
    """Current users with their event mix; users without events stay.

    Events are aggregated per user key before the join, so a user with a third of all
    events costs one partial aggregate row per task.
    """
    category = F.col("activity_category")
    mix = fact.join(activity_types.select("activity_sk", "activity_category"), "activity_sk", "left").groupBy(
        "user_sk",
    ).agg(
        F.count("*").alias("n"), F.sum("is_after_hours").alias("late"),
        *[F.count_if(category == kind).alias(kind) for kind in ("device", "email", "file")],
        F.sum("risk_score").alias("risk_sum"), F.count("risk_score").alias("risk_n"),
        F.max("risk_score").alias("risk_max"),
    )
    joined = users.filter(F.col("is_current") == 1).join(mix, "user_sk", "left")

    def events(c):
        return F.coalesce(F.sum(c), F.lit(0))

    return joined.groupBy(*USER_COLUMNS).agg(
        events("n").alias("total_events"), F.sum("late").alias("after_hours_events"),
        events("device").alias("usb_events"), events("email").alias("email_events"),
        events("file").alias("file_events"),
        F.try_divide(F.sum("risk_sum"), F.sum("risk_n")).alias("avg_risk_score"),
        F.max("risk_max").alias("max_risk_score"),
    )


def hourly_threat_pattern(fact: DataFrame, dates: DataFrame, times: DataFrame, attack_types: DataFrame) -> DataFrame:
    """Attacks per weekday, hour, part of day and family.

    The fact is first counted by its three small keys, so the dimension joins see at most
    days x minutes x labels rows.
    """
    return pattern_of(daily_minutes(fact), dates, times, attack_types)


def pattern_of(minutes: DataFrame, dates: DataFrame, times: DataFrame, attack_types: DataFrame) -> DataFrame:
    joined = (
        minutes.join(dates.select("date_sk", "day_name"), "date_sk")
        .join(times.select("time_sk", "hour_24", "day_part"), "time_sk")
        .join(attack_types.select("attack_sk", "attack_family"), "attack_sk")
    )
    return joined.groupBy("day_name", "hour_24", "day_part", "attack_family").agg(F.sum("n").alias("event_count"))


def refresh_views(
    fact: DataFrame, assets: DataFrame, dates: DataFrame, times: DataFrame, attack_types: DataFrame,
) -> dict[str, DataFrame]:
    """The three views kept as tables, from all rows of the fact."""
    return views_of(daily_pairs(fact), daily_minutes(fact), assets, dates, times, attack_types)


def views_of(
    pairs: DataFrame, minutes: DataFrame, assets: DataFrame, dates: DataFrame, times: DataFrame, attack_types: DataFrame,
) -> dict[str, DataFrame]:
    """The three views from states; several rows of one key, as several loads leave them, add up."""
    return {
        "mv_attack_summary": summary_of(pairs, dates, attack_types),
        "mv_top_attackers": attackers_of(pairs, assets, attack_types),
        "mv_hourly_threat_pattern": pattern_of(minutes, dates, times, attack_types),
    }
