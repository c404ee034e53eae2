"""User-day features, personal baselines, peer scores, per-user risk profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.functions import activity as A
from threatlake.functions.times import date_key, in_window, outside_hours, sunday_zero, time_key, weekend
from threatlake.operators.filters import after_baseline
from threatlake.operators.joins import resolve_key, version_join

PEER_METRICS = {
    "usb_connects": "usb_zscore_peer",
    "ext_emails": "ext_emails_zscore_peer",
    "after_hours_events": "after_hours_zscore_peer",
}


def activity_fact(
    activity: DataFrame, users: DataFrame, assets: DataFrame, types: DataFrame, source_system: str = "activity",
) -> DataFrame:
    """Unified activity with resolved keys, time flags and window labels; unresolved rows are dropped."""
    named = activity.withColumn("activity_name", A.activity_name(F.col("activity_type")))
    typed = resolve_key(named, types, {"activity_name": "activity_name"}, "activity_sk", "activity_sk")
    placed = resolve_key(typed, assets, {"pc_id": "asset_identifier"}, "asset_sk", "asset_sk")
    versions = users.select(
        "user_id", "user_sk", "valid_from", "valid_to", "is_malicious", "attack_window_start", "attack_window_end")
    owned = version_join(placed, versions, "user_id", "event_time")
    ts = F.col("event_time")
    columns = {
        "source_system": F.lit(source_system), "date_sk": date_key(ts), "time_sk": time_key(ts),
        "user_sk": F.col("user_sk"), "asset_sk": F.col("asset_sk"), "activity_sk": F.col("activity_sk"),
        "natural_event_id": F.col("event_id_src"), "event_time": ts, "filename": F.col("filename"),
        "file_extension": A.file_extension(F.col("filename")),
        "to_recipients_count": F.col("email_recipients_count"),
        "external_recipient_count": F.col("email_to_external_domain"),
        "attachment_count": F.col("email_attachments_count"), "size_bytes": F.col("email_size"),
        "url_domain": F.lit(None).cast("string"),
        "is_after_hours": outside_hours(ts, 9, 17), "is_weekend": weekend(ts),
        "is_malicious_user": F.coalesce(F.col("is_malicious"), F.lit(0)),
        "in_attack_window": in_window(F.col("is_malicious"), ts, F.col("attack_window_start"), F.col("attack_window_end")),
        "risk_score": F.lit(None).cast("double"), "model_version": F.lit(None).cast("string"), "scored_at": F.lit(None).cast("timestamp"),
    }
    rows = owned.select(*[c.alias(name) for name, c in columns.items()])
    return rows.dropna(subset=["user_sk", "activity_sk", "date_sk", "time_sk"])


def user_days(fact: DataFrame, types: DataFrame, user: str = "user_sk") -> DataFrame:
    """One row per user and day; activity names come from the small type dimension."""
    f = fact.join(types.select("activity_sk", "activity_name"), "activity_sk")
    name, ts = F.col("activity_name"), F.col("event_time")

    def count_of(kind, extra=None):
        hit = (name == kind) if extra is None else (name == kind) & extra
        return F.count_if(hit)

    return f.groupBy(user, ts.cast("date").alias("feature_date"), sunday_zero(ts).alias("day_of_week")).agg(
        F.count("*").alias("events_total"), count_of("Connect").alias("usb_connects"),
        count_of("Email Send").alias("emails_sent"),
        count_of("Email Send", F.col("external_recipient_count") > 0).alias("ext_emails"),
        count_of("File Access").alias("file_accesses"), count_of("Logon").alias("logons"),
        F.sum("is_after_hours").alias("after_hours_events"), F.sum("is_weekend").alias("weekend_events"),
        F.countDistinct("asset_sk").alias("distinct_pcs"), F.max("in_attack_window").alias("in_attack_window"),
    )


def personal_baselines(days: DataFrame, user: str = "user_sk", baseline_days: int = 60) -> DataFrame:
    """Averages over the first calendar days of each user; one grouped aggregate after a lookup of first days."""
    first = days.groupBy(user).agg(F.min("feature_date").alias("baseline_from"))
    start = days.join(first, user).withColumn("baseline_to", F.date_add("baseline_from", baseline_days))
    early = start.filter(F.col("feature_date") < F.col("baseline_to"))
    active, events = F.count("*"), F.greatest(F.sum("events_total"), F.lit(1))

    def per_day(c):
        return F.bround(F.sum(c) / active, 3)

    return early.groupBy(user, "baseline_from", "baseline_to").agg(
        active.alias("baseline_active_days"),
        per_day("usb_connects").alias("baseline_usb_per_day"),
        per_day("emails_sent").alias("baseline_emails_per_day"),
        per_day("ext_emails").alias("baseline_ext_emails_per_day"),
        per_day("file_accesses").alias("baseline_files_per_day"),
        per_day("logons").alias("baseline_logon_count"),
        F.bround(F.sum("after_hours_events") / events, 3).alias("baseline_after_hours_pct"),
        F.bround(F.sum("weekend_events") / events, 3).alias("baseline_weekend_pct"),
        F.max("distinct_pcs").alias("baseline_distinct_pcs"),
        F.lit(0.0).alias("baseline_avg_session_hours"),
    )


def assemble_features(days: DataFrame, users: DataFrame, baselines: DataFrame, user: str = "user_sk") -> DataFrame:
    """User days with attributes (inner) and baselines (left)."""
    attributes = users.select(user, "role", "department", "is_malicious", "malicious_scenario")
    usual = baselines.select(
        user, "baseline_usb_per_day", "baseline_emails_per_day", "baseline_ext_emails_per_day",
        "baseline_files_per_day", "baseline_after_hours_pct", F.col("baseline_to").alias("baseline_end"))
    return days.join(attributes, user).join(usual, user, "left")


def personal_deviations(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "usb_dev_personal": A.deviation(c("usb_connects"), c("baseline_usb_per_day")),
        "emails_dev_personal": A.deviation(c("emails_sent"), c("baseline_emails_per_day")),
        "ext_emails_dev_personal": A.deviation(c("ext_emails"), c("baseline_ext_emails_per_day")),
        "files_dev_personal": A.deviation(c("file_accesses"), c("baseline_files_per_day")),
        "usb_ratio_personal": A.ratio(c("usb_connects"), c("baseline_usb_per_day")),
        "ext_emails_ratio_personal": A.ratio(c("ext_emails"), c("baseline_ext_emails_per_day")),
        "after_hours_pct": A.share(c("after_hours_events"), c("events_total")),
    })


def peer_scores(df: DataFrame, peer_keys=("department",), day: str = "feature_date", metrics=None) -> DataFrame:
    """(x - mean) / sample deviation inside a peer group and day.

    Group statistics are aggregated (with map-side partials) and joined back, so a department
    that holds most rows is never sorted in one task. Rows without a group, groups of one and
    groups without spread: 0, 0 and (x - mean) / 1.
    """
    metrics = metrics or PEER_METRICS
    keys = [*peer_keys, day]
    stats = df.dropna(subset=keys).groupBy(*keys).agg(
        *[F.avg(m).alias(f"_mean_{m}") for m in metrics], *[F.stddev_samp(m).alias(f"_std_{m}") for m in metrics])
    joined = df.join(stats, keys, "left")

    def z(m):
        spread = F.when(F.col(f"_std_{m}") == 0, 1.0).otherwise(F.col(f"_std_{m}"))
        score = (F.col(m) - F.col(f"_mean_{m}")) / spread
        return F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0))

    scored = joined.withColumns({out: z(m) for m, out in metrics.items()})
    return scored.drop(*[f"_{s}_{m}" for s in ("mean", "std") for m in metrics])


ROUNDED = (
    "usb_dev_personal", "emails_dev_personal", "ext_emails_dev_personal", "files_dev_personal",
    "usb_ratio_personal", "ext_emails_ratio_personal", "usb_zscore_peer", "ext_emails_zscore_peer",
    "after_hours_zscore_peer", "after_hours_pct",
)
USER_DAY_COLUMNS = (
    "feature_date", "day_of_week", "events_total", "usb_connects", "emails_sent", "ext_emails", "file_accesses",
    "logons", "after_hours_events", "weekend_events", "distinct_pcs", *ROUNDED[:9], "after_hours_pct",
    "multi_signal_count", "is_malicious_user", "in_attack_window", "malicious_scenario",
)


def user_day_features(
    days: DataFrame, users: DataFrame, baselines: DataFrame, user: str = "user_sk", peer_keys=("department",),
) -> DataFrame:
    """The user-day feature table: deviations, ratios, peer scores, signal count, rounded at the end."""
    wide = peer_scores(personal_deviations(assemble_features(days, users, baselines, user)), peer_keys)
    signals = A.signal_count(
        [F.col(z) for z in PEER_METRICS.values()],
        [F.col("usb_ratio_personal"), F.col("ext_emails_ratio_personal")])
    named = wide.withColumn("multi_signal_count", signals).withColumns({
        "is_malicious_user": F.col("is_malicious"),
        "malicious_scenario": F.coalesce(F.col("malicious_scenario"), F.lit(0)),
        **{c: F.bround(F.col(c), 3) for c in ROUNDED},
    })
    return named.select(user, *USER_DAY_COLUMNS)


def user_profiles(features: DataFrame, baselines: DataFrame, user: str = "user_sk") -> DataFrame:
    """Peak, sustained and counted signals per user after the baseline; missing values are 0."""
    later = after_baseline(features, baselines, user)
    peaks = {
        "max_usb_ratio": "usb_ratio_personal", "max_usb_z": "usb_zscore_peer",
        "max_ext_email_z": "ext_emails_zscore_peer", "max_after_hours_z": "after_hours_zscore_peer",
        "max_signals_in_day": "multi_signal_count", "max_usb_in_day": "usb_connects",
        "max_ext_emails_in_day": "ext_emails", "max_files_in_day": "file_accesses",
    }
    means = {
        "avg_usb_ratio": "usb_ratio_personal", "avg_usb_z": "usb_zscore_peer",
        "avg_ext_email_z": "ext_emails_zscore_peer", "avg_after_hours_pct": "after_hours_pct",
        "avg_usb_dev": "usb_dev_personal", "avg_signals_per_day": "multi_signal_count",
    }
    return later.groupBy(user).agg(
        *[F.max(c).alias(out) for out, c in peaks.items()], *[F.avg(c).alias(out) for out, c in means.items()],
        F.count_if(F.col("multi_signal_count") >= 2).alias("days_with_multi_signal"),
        F.count_if(F.col("usb_zscore_peer") > 2).alias("days_high_usb_z"),
        F.count_if(F.col("ext_emails_zscore_peer") > 2).alias("days_high_ext_email_z"),
        F.count("*").alias("total_days_observed"), F.sum("usb_connects").alias("lifetime_usb_total"),
        F.sum("ext_emails").alias("lifetime_ext_emails_total"),
        F.max("is_malicious_user").alias("is_malicious"), F.max("malicious_scenario").alias("malicious_scenario"),
    ).fillna(0)


def baseline_separability(days: DataFrame, users: DataFrame, baselines: DataFrame, user: str = "user_sk") -> DataFrame:
    """How far each kind of user-day lies above the personal baseline, post-baseline days only."""
    later = after_baseline(days, baselines, user)
    wide = assemble_features(later, users, baselines, user)
    group = A.user_day_group(F.col("is_malicious"), F.col("malicious_scenario"), F.col("in_attack_window"))
    late_share = F.col("after_hours_events").cast("double") / F.nullif(F.col("events_total"), F.lit(0))

    def mean(c, places=2):
        return F.round(F.avg(c).cast("decimal(20,9)"), places).cast("double")

    return wide.groupBy(group.alias("user_day_group")).agg(
        F.count("*").alias("user_days"), mean(F.col("usb_connects")).alias("avg_usb"),
        mean(F.col("usb_connects") - F.col("baseline_usb_per_day")).alias("usb_deviation"),
        mean(F.col("ext_emails")).alias("avg_ext_emails"),
        mean(F.col("ext_emails") - F.col("baseline_ext_emails_per_day")).alias("ext_email_deviation"),
        mean(late_share - F.col("baseline_after_hours_pct"), 3).alias("after_hours_deviation"),
    )


def feature_separability(features: DataFrame) -> DataFrame:
    group = A.user_day_group(
        F.col("is_malicious_user"), F.col("malicious_scenario"), F.col("in_attack_window"), "short")

    def mean(c):
        return F.round(F.avg(c).cast("decimal(20,9)"), 2).cast("double")

    return features.groupBy(group.alias("user_day_group")).agg(
        F.count("*").alias("days"), mean("usb_dev_personal").alias("usb_dev"),
        mean("usb_ratio_personal").alias("usb_ratio"), mean("usb_zscore_peer").alias("usb_z_peer"),
        mean("ext_emails_zscore_peer").alias("ext_email_z_peer"),
        mean("multi_signal_count").alias("avg_signals_triggered"),
    )


def activity_totals(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.count("*").alias("total_rows"), F.countDistinct("user_sk").alias("distinct_users"),
        F.sum("is_malicious_user").alias("malicious_user_events"),
        F.sum("in_attack_window").alias("in_attack_window_events"),
        F.sum("is_after_hours").alias("after_hours_events"),
        F.min("event_time").alias("earliest"), F.max("event_time").alias("latest"),
        F.countDistinct("activity_sk").alias("activity_types_used"),
    )


def history_totals(users: DataFrame) -> DataFrame:
    """Counts over all versions; the average length takes closed versions only."""
    closed = F.col("is_current") == 0
    days = F.when(closed, F.date_diff("valid_to", "valid_from"))
    return users.agg(
        F.count("*").alias("total_rows"), F.countDistinct("user_id").alias("distinct_users"),
        F.sum("is_current").alias("currently_active"), F.min("valid_from").alias("earliest_from"),
        F.max(F.when(closed, F.col("valid_to"))).alias("latest_to"),
        F.bround(F.avg(days)).cast("bigint").alias("avg_period_days"),
    )


def insider_totals(users: DataFrame) -> DataFrame:
    listed = F.col("is_malicious") == 1
    return users.agg(
        F.count_if(listed).alias("malicious_users"), F.count_if(F.col("is_malicious") == 0).alias("legitimate_users"),
        *[F.count_if(listed & (F.col("malicious_scenario") == n)).alias(f"scenario_{n}_users") for n in (1, 2, 3)],
    )
