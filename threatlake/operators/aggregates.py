"""Distributions, address profiles, event-class reports, cross-tabulations, score summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.functions import activity as A
from threatlake.functions.labels import class_name
from threatlake.functions.network import ipv4_class
from threatlake.functions.numbers import flag, percent
from threatlake.functions.times import hour_bucket, month_bucket
from threatlake.operators.filters import union_all
from threatlake.operators.joins import class_of_events
from threatlake.operators.ordering import exact_percentile, exact_percentiles, join_on, with_share

HARMLESS = ("Benign", "Unlabeled")


def distribution(df: DataFrame, keys: list[str], count: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(count))


def distribution_with_share(df: DataFrame, keys: list[str], count: str = "cnt", out: str = "pct") -> DataFrame:
    return with_share(distribution(df, keys, count), count, out)


def class_balance(df: DataFrame, attack: str = "is_attack") -> DataFrame:
    return distribution_with_share(df.select(class_name(F.col(attack)).alias("class")), ["class"])


def spans(df: DataFrame, keys: list[str], ts: str, names=("earliest", "latest", "events")) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(ts).alias(names[0]), F.max(ts).alias(names[1]), F.count("*").alias(names[2]))


def attack_windows(df: DataFrame, keys: list[str], ts: str, family: str) -> DataFrame:
    hostile = df.filter(~F.col(family).isin(*HARMLESS))
    return spans(hostile, keys, ts, ("first_seen", "last_seen", "events"))


def parse_report(df: DataFrame, day: str, raw: str, parsed: str) -> DataFrame:
    blank = F.col(raw).isNull() | (F.trim(raw) == "")
    return df.groupBy(day).agg(
        F.min(parsed).alias("earliest"), F.max(parsed).alias("latest"),
        F.hour(F.min(parsed)).alias("earliest_hour"), F.hour(F.max(parsed)).alias("latest_hour"),
        F.count(parsed).alias("parsed_count"), F.count_if(blank).alias("null_input"),
        F.count_if(F.col(parsed).isNull() & ~blank).alias("parse_failed"),
    )


def address_profiles(df: DataFrame, address: str, attack: str, family: str) -> DataFrame:
    """Events, attacks and families per address of one direction, with its class."""
    known = df.filter(F.col(address).isNotNull())
    profile = known.groupBy(F.col(address).alias("ip")).agg(
        F.count("*").alias("event_count"), F.count_if(F.col(attack) == 1).alias("attack_count"),
        F.countDistinct(family).alias("unique_attack_families"),
    )
    return profile.withColumn("ip_class", ipv4_class(F.col("ip")))


def class_totals(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("ip_class").agg(
        F.count("*").alias("unique_ips"), F.sum("event_count").alias("total_events"),
        F.sum("attack_count").alias("total_attacks"))


def external_attackers(sources: DataFrame) -> DataFrame:
    return sources.filter((F.col("ip_class") == "external") & (F.col("attack_count") > 0))


def external_master(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per external address over both roles."""
    def role(frame, name):
        return frame.filter(F.col("ip_class") == "external").withColumn("role", F.lit(name))

    both = role(sources, "source").unionByName(role(targets, "destination"))
    return both.groupBy("ip").agg(
        F.bool_or(F.col("role") == "source").alias("appears_as_source"),
        F.bool_or(F.col("role") == "destination").alias("appears_as_dest"),
        F.sum("event_count").alias("total_events"), F.sum("attack_count").alias("total_attacks"),
        F.max("unique_attack_families").alias("unique_attack_families"),
    )


def host_breakdown(df: DataFrame, address: str, attack: str, family: str, prefix: str) -> DataFrame:
    """Hosts under a text prefix with their hostile families; the family set is small by nature."""
    hosts = df.filter(F.col(address).like(f"{prefix}%"))
    hostile = F.when(~F.col(family).isin(*HARMLESS), F.col(family))
    families = F.nullif(F.array_join(F.sort_array(F.collect_set(hostile)), ", "), F.lit(""))
    return hosts.groupBy(address).agg(
        F.count("*").alias("total_events"), F.count_if(F.col(attack) == 1).alias("attack_count"),
        families.alias("attack_families"))


def mean_and_spread(df: DataFrame, columns: list[str], places: int = 1) -> DataFrame:
    return df.agg(
        *[F.round(F.avg(c), places).alias(f"avg_{c}") for c in columns],
        *[F.round(F.stddev_samp(c), places).alias(f"std_{c}") for c in columns])


def bucket_counts(df: DataFrame, bucket: Column, value: str, count: str = "cnt") -> DataFrame:
    """Rows per bucket with the smallest value, by which buckets are put in order."""
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias(count), F.min(value).alias("lowest"))


def monthly(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(month_bucket(F.col(ts)).alias("month")).agg(F.count("*").alias("events"))


def hourly(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("events"))


def hour_timeline(df: DataFrame, ts: str, family: str) -> DataFrame:
    return df.groupBy(hour_bucket(F.col(ts)).alias("hour_bucket"), F.col(family).alias("family")).agg(
        F.count("*").alias("events"))


def event_class_counts(events: DataFrame, insiders: DataFrame, user: str, ts: str) -> DataFrame:
    return class_of_events(events, insiders, user, ts).groupBy("event_class").agg(F.count("*").alias("events"))


def volume_by_user_class(events: DataFrame, insiders: DataFrame, user: str, ts: str) -> DataFrame:
    marked = class_of_events(events, insiders, user, ts)
    kind = F.when(F.col("is_insider"), "Malicious").otherwise("Benign").alias("user_class")
    return marked.groupBy(kind).agg(
        F.countDistinct(user).alias("unique_users"), F.count("*").alias("events"),
        F.round(F.count("*") / F.countDistinct(user), 0).alias("avg_events_per_user"))


def hour_signal(events: DataFrame, insiders: DataFrame, user: str, ts: str) -> DataFrame:
    """Share of each hour inside the attack windows against its share for other users."""
    marked = class_of_events(events, insiders, user, ts)
    hours = marked.groupBy(F.hour(ts).alias("hour")).agg(
        F.count_if(F.col("event_class").endswith("(during attack window)")).alias("attack_window_events"),
        F.count_if(~F.col("is_insider")).alias("benign_events"))
    attack, benign = hours.agg(F.sum("attack_window_events")).scalar(), hours.agg(F.sum("benign_events")).scalar()
    shares = hours.withColumns({
        "attack_pct": percent(F.col("attack_window_events"), attack),
        "benign_pct": percent(F.col("benign_events"), benign)})
    usual = F.coalesce(F.nullif("benign_pct", F.lit(0.0)), F.lit(0.01))
    return shares.withColumn("signal", F.round(F.col("attack_pct") / usual, 2))


def window_mail_stats(mails: DataFrame, insiders: DataFrame, user: str, ts: str, scenario: int) -> DataFrame:
    """Mail of one scenario's users inside their windows, per user."""
    inside = class_of_events(mails, insiders, user, ts).filter(
        (F.col("scenario") == scenario) & F.col(ts).between(F.col("window_start"), F.col("window_end")))
    return inside.groupBy(user).agg(
        F.count("*").alias("emails_during_attack"),
        F.round(F.avg("attachment_count"), 2).alias("avg_attachments"),
        F.max("attachment_count").alias("max_attachments"),
        F.round(F.max("size_bytes") / 1024.0, 0).alias("max_size_kb"))


def mass_mails(mails: DataFrame, insiders: DataFrame, user: str, ts: str, scenario: int, least: int, limit: int) -> DataFrame:
    inside = class_of_events(mails, insiders, user, ts).filter(
        (F.col("scenario") == scenario) & F.col(ts).between(F.col("window_start"), F.col("window_end"))
        & (A.separators(F.col("recipients")) >= least))
    return inside.select(
        F.col(user), F.col(ts), "attachment_count", F.round(F.col("size_bytes") / 1024.0, 0).alias("size_kb"),
        A.approx_recipients(F.col("recipients")).alias("approx_recipient_count"),
    ).orderBy(F.desc("approx_recipient_count"), ts, user).limit(limit)


def cross_tab(df: DataFrame, row: str, column: str, values: list[str], total: str = "Total") -> DataFrame:
    """Counts of row x column with totals both ways; ``values`` are the columns wanted, in order."""
    def named(c):
        return F.when(F.grouping(c) == 1, total).otherwise(F.col(c))

    cells = df.cube(row, column).agg(
        F.count("*").alias("n"), named(row).alias("_row"), named(column).alias("_column"))
    pivoted = cells.groupBy(F.col("_row").alias(row)).pivot("_column", [*values, total]).agg(F.sum("n"))
    return pivoted.fillna(0)


def pivot_sum(df: DataFrame, row: Column, column: str, values: list[str], measure: Column) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.sum(measure)).fillna(0)


def score_summary(df: DataFrame, keys: list[str], score: str, places: int = 4) -> DataFrame:
    """Count, mean, exact median, deviation, least and greatest score per class."""
    basic = df.groupBy(*keys).agg(
        F.count(score).alias("count"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"),
        F.min(score).alias("min"), F.max(score).alias("max"))
    joined = join_on(basic, exact_percentile(df, keys, score, 0.5, "median"), keys)
    return joined.withColumns({c: F.round(c, places) for c in ("mean", "median", "std", "min", "max")})


def describe_score(df: DataFrame, score: str, places: int = 4) -> DataFrame:
    """One row: count, mean, deviation, extremes and exact quartiles."""
    names = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    out = df.agg(
        F.count(score).alias("count"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"),
        F.min(score).alias("min"), F.max(score).alias("max"),
    ).withColumn("_p", exact_percentiles(df, [], score, names).select(F.struct(*names)).scalar())
    out = out.withColumns({n: F.col(f"_p.{n}") for n in names}).drop("_p")
    return out.withColumns({c: F.round(c, places) for c in ("mean", "std", "min", "max", *names)})


def feature_gaps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing and infinite values per feature with percent, in one pass over the table."""
    rows = [
        F.struct(
            F.lit(c).alias("feature"), F.count_if(F.col(c).isNull() | F.isnan(c)).alias("missing"),
            F.count_if(F.abs(F.col(c)) == float("inf")).alias("infinite"), F.count("*").alias("rows"))
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows")).withColumn(
        "pct", percent(F.col("missing"), F.col("rows"))).drop("rows")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all([
        t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, t in tables.items()])


def key_presence(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.agg(F.count("*").alias("total_rows"), *[F.count(c).alias(out) for out, c in columns.items()])


def date_integrity(fact: DataFrame, dates: DataFrame) -> DataFrame:
    joined = fact.select("date_sk").join(dates.select("date_sk", "full_date"), "date_sk", "left")
    return joined.agg(
        F.count("*").alias("fact_rows"), F.countDistinct("date_sk").alias("distinct_dates"),
        F.count("full_date").alias("resolved_dates"), F.min("full_date").alias("earliest"),
        F.max("full_date").alias("latest"))

