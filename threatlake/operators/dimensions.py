"""Dimension tables: calendar, clock, fixed ones, stable keys for new rows, user history."""

from __future__ import annotations

from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threatlake import constants as C
from threatlake.functions.network import address_class
from threatlake.functions.numbers import flag, ladder
from threatlake.functions.times import date_key, monday_one
from threatlake.operators.ordering import join_on, rank_by_hash


def _calendar_columns(day: Column) -> list[Column]:
    weekday = monday_one(day)
    return [
        date_key(day).alias("date_sk"), day.alias("full_date"), weekday.alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"), F.dayofmonth(day).alias("day_of_month"),
        F.dayofyear(day).alias("day_of_year"), F.weekofyear(day).alias("week_of_year"),
        F.month(day).alias("month_num"), F.date_format(day, "MMMM").alias("month_name"),
        F.quarter(day).alias("quarter"), F.year(day).alias("year"),
        flag(weekday >= 6).alias("is_weekend"), flag(weekday <= 5).alias("is_business_day"),
        F.lit(0).alias("holiday_flag"),
    ]


def dim_date(spark: SparkSession, first: date = C.CALENDAR_START, last: date = C.CALENDAR_END) -> DataFrame:
    days = spark.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("_day"))
    return days.select(*_calendar_columns(F.col("_day")))


def dim_date_over(df: DataFrame, ts: str) -> DataFrame:
    """Calendar from the first to the last day of a time column."""
    span = df.agg(F.min(F.col(ts).cast("date")).alias("a"), F.max(F.col(ts).cast("date")).alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("_day")).select(*_calendar_columns(F.col("_day")))


def dim_time(spark: SparkSession) -> DataFrame:
    hour, minute = F.floor(F.col("id") / 60).cast("int"), (F.col("id") % 60).cast("int")
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return spark.range(1440).select(
        F.col("id").cast("int").alias("time_sk"), hour.alias("hour_24"), minute.alias("minute"),
        twelve.alias("hour_12"), F.when(hour < 12, "AM").otherwise("PM").alias("am_pm"),
        ladder(hour, C.DAY_PARTS, None).alias("day_part"),
        flag((hour >= 8) & (hour < 17)).alias("is_business_hour"),
        flag((hour < 7) | (hour >= 19)).alias("is_after_hours"),
    )


def _numbered(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Fixed rows with a running key; an Arrow table becomes a local relation of known size, so joins broadcast it."""
    names = [part.split()[0] for part in schema.split(", ")]
    columns = list(zip(*[(i, *r) for i, r in enumerate(rows, 1)]))
    return spark.createDataFrame(pa.table(dict(zip(names, (pa.array(c) for c in columns)))), schema)


def dim_attack_type(spark: SparkSession) -> DataFrame:
    return _numbered(spark, C.ATTACK_TYPES, "attack_sk int, attack_label string, attack_family string, "
                     "severity string, mitre_technique_id string, mitre_tactic string")


def dim_activity_type(spark: SparkSession) -> DataFrame:
    return _numbered(spark, C.ACTIVITY_TYPES, "activity_sk int, activity_name string, activity_category string, "
                     "risk_weight double")


def dim_protocol(spark: SparkSession) -> DataFrame:
    return _numbered(spark, C.PROTOCOLS, "protocol_sk int, protocol_num int, protocol_name string")


def dim_port(spark: SparkSession) -> DataFrame:
    ports = _numbered(spark, C.PORTS, "port_sk bigint, port_number int, service_name string, port_category string")
    return ports.withColumn("is_well_known", flag(F.col("port_number") < 1024))


def with_new_keys(new_rows: DataFrame, existing: DataFrame, key: str, natural: list[str]) -> DataFrame:
    """New rows numbered from the greatest existing key on, in hash order of their natural key."""
    order = F.concat_ws("|", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in natural])), *natural)
    ranked = rank_by_hash(new_rows, [], order, out="_rn").drop("_size")
    highest = F.coalesce(existing.agg(F.max(key)).scalar(), F.lit(0))
    return ranked.withColumn(key, (highest + F.col("_rn")).cast("bigint")).drop("_rn")


def upsert(existing: DataFrame, candidates: DataFrame, key: str, natural: list[str]) -> DataFrame:
    """Existing rows untouched, plus candidates with an unseen natural key under fresh surrogate keys."""
    unseen = candidates.join(existing.select(*natural), natural, "left_anti")
    return existing.unionByName(with_new_keys(unseen, existing, key, natural), allowMissingColumns=True)


def observed_addresses(flows: DataFrame, source: str = "src_ip", target: str = "dest_ip") -> DataFrame:
    """Distinct addresses of both roles and families with their class."""
    both = flows.select(F.col(source).alias("ip")).unionByName(flows.select(F.col(target).alias("ip")))
    addresses = both.filter(F.col("ip").isNotNull()).distinct()
    return addresses.withColumn("ip_class", address_class(F.col("ip")))


def upsert_assets(
    assets: DataFrame, addresses: DataFrame, enriched: DataFrame | None = None, source_system: str = "flows",
) -> DataFrame:
    """Hosts for unseen addresses; identity is (identifier, source system)."""
    hosts = addresses if enriched is None else addresses.join(enriched, "ip", "left")
    rows = hosts.withColumns({
        "asset_identifier": F.col("ip"), "asset_type": F.lit("host"), "ip_address": F.col("ip"),
        "is_internal": flag(F.col("ip_class") == "internal"), "source_system": F.lit(source_system),
    })
    if "is_known_attacker" in rows.columns:
        rows = rows.withColumn("is_known_attacker", F.coalesce("is_known_attacker", F.lit(0)))
    return upsert(assets, rows.drop("ip", "ip_class"), "asset_sk", ["asset_identifier", "source_system"])


def upsert_ports(ports: DataFrame, flows: DataFrame, columns=("src_port", "dest_port")) -> DataFrame:
    seen = None
    for c in columns:
        part = flows.select(F.col(c).alias("port_number")).filter(F.col(c).isNotNull()).distinct()
        seen = part if seen is None else seen.unionByName(part)
    rows = seen.distinct().withColumns(
        {"port_category": F.lit("observed"), "is_well_known": flag(F.col("port_number") < 1024)})
    return upsert(ports, rows, "port_sk", ["port_number"])


def upsert_workstations(assets: DataFrame, activity: DataFrame, pc: str = "pc_id", source_system: str = "activity") -> DataFrame:
    rows = activity.filter(F.col(pc).isNotNull()).select(F.col(pc).alias("asset_identifier")).distinct().withColumns(
        {"asset_type": F.lit("Workstation"), "is_internal": F.lit(1), "source_system": F.lit(source_system)})
    return upsert(assets, rows, "asset_sk", ["asset_identifier"])


def build_history(
    snapshots: DataFrame, key: str, day: str, attributes: list[str], arrival: str | None = None,
) -> DataFrame:
    """Slowly changing history from full snapshots.

    A version opens at first sight, on return after an absence, and on any attribute change; it
    ends on the snapshot that shows the change or absence, or stays open until 9999-12-31.
    Equal (key, day) rows are reduced to the one with the greatest ``arrival``. A key has one
    row per snapshot day at most, so the window partitions stay as short as the calendar.
    """
    values = F.struct(*attributes)
    last = F.max_by(values, arrival) if arrival else F.max(values)
    rows = snapshots.groupBy(key, day).agg(last.alias("_values"))
    ordered = W.orderBy(day)
    calendar = snapshots.select(day).distinct().select(
        day, F.row_number().over(ordered).alias("_place"), F.lead(day).over(ordered).alias("_following"))
    placed = join_on(rows, calendar, [day])
    own = W.partitionBy(key).orderBy("_place")
    previous, before = F.lag("_place").over(own), F.lag("_values").over(own)
    opens = previous.isNull() | (previous != F.col("_place") - 1) | ~before.eqNullSafe(F.col("_values"))
    versions = placed.withColumn("_opens", flag(opens)).withColumn("_version", F.sum("_opens").over(own))
    closed = versions.groupBy(key, "_version").agg(
        F.min(day).alias("valid_from"), F.max_by(F.struct("_following"), "_place").alias("_end"), F.first("_values").alias("_values"))
    end = F.col("_end._following")
    return closed.select(
        key, *[F.col(f"_values.{a}").alias(a) for a in attributes], "valid_from",
        F.coalesce(end, F.lit(C.OPEN_END)).alias("valid_to"), flag(end.isNull()).alias("is_current"),
    )


def flag_users(users: DataFrame, insiders: DataFrame, key: str = "user_id") -> DataFrame:
    """Every version of a listed user gets flag, scenario and window."""
    side = insiders.select(
        key, F.col("scenario").alias("malicious_scenario"),
        F.col("window_start").alias("attack_window_start"), F.col("window_end").alias("attack_window_end"))
    listed = side.withColumn("_listed", F.lit(1))
    return users.join(listed, key, "left").withColumn("is_malicious", F.coalesce("_listed", F.lit(0))).drop("_listed")
