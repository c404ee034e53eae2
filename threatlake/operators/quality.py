"""Data-quality checks: each yields one row; a failing check becomes an error row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake import constants as C
from threatlake.functions.numbers import percent
from threatlake.operators.joins import orphans

RESULT_SCHEMA = (
    "run_id string, check_name string, check_category string, severity string, passed int, "
    "expected_value string, actual_value string, message string, checked_at timestamp"
)


@dataclass(frozen=True)
class Check:
    """A named check; ``frame`` yields one row (passed, expected, actual, message, severity)."""

    name: str
    category: str
    frame: Callable[[], DataFrame]


def _row(df: DataFrame, passed: Column, expected: Column | str, actual: Column, message: Column | str,
         severity: Column | str = "error") -> DataFrame:
    def text(v):
        return v if isinstance(v, Column) else F.lit(v)

    return df.select(
        passed.alias("passed"), text(expected).cast("string").alias("expected"), actual.cast("string").alias("actual"),
        text(message).alias("message"), text(severity).alias("severity"))


def require_columns(df: DataFrame, required=C.REQUIRED_FLOW_COLUMNS, at_least: int = C.MIN_FLOW_COLUMNS) -> DataFrame:
    """The frame itself, or an error naming what is missing; looks at the schema only."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    if len(df.columns) < at_least:
        raise ValueError(f"only {len(df.columns)} columns, expected at least {at_least}")
    return df


def require_rows(count: int, mode: str, least: int = C.MIN_FLOW_ROWS) -> None:
    """Full runs need a minimum volume; samples do not."""
    if mode == "full" and count < least:
        raise ValueError(f"only {count} rows, expected at least {least}")


def transform_metrics(first: int = 20170703, last: int = 20170707) -> dict[str, Column]:
    """Counts behind the checks after the transform step, for one aggregate or to be observed while the rows are written."""
    return {
        "null_dates": F.count_if(F.col("date_sk").isNull()), "bad_times": F.count_if(~F.col("time_sk").between(0, 1439)),
        "dates_outside": F.count_if(~F.col("date_sk").between(first, last)), "first_date": F.min("date_sk"), "last_date": F.max("date_sk"),
        "invalid_src": F.count_if(F.col("src_ip_class") == "invalid"), "invalid_dest": F.count_if(F.col("dest_ip_class") == "invalid")}


def transform_findings(df: DataFrame, first: int = 20170703, last: int = 20170707) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in transform_metrics(first, last).items()])


def enforce_transform(findings: DataFrame | dict) -> list[str]:
    """Raises on missing dates and impossible times, returns warnings for the rest."""
    found = findings.first() if isinstance(findings, DataFrame) else findings
    if found["null_dates"]:
        raise ValueError(f"{found['null_dates']} rows without date key")
    if found["bad_times"]:
        raise ValueError(f"{found['bad_times']} rows with an invalid time key")
    warnings = []
    if found["dates_outside"]:
        warnings.append(f"dates {found['first_date']} to {found['last_date']} leave the expected window")
    if found["invalid_src"] or found["invalid_dest"]:
        warnings.append(f"invalid addresses: {found['invalid_src']} sources, {found['invalid_dest']} targets")
    return warnings


Verdict = tuple[Column, Column | str, Column, Column | str, Column | str]


def _rows_verdict(n: Column, expected: int) -> Verdict:
    return n == expected, str(expected), n, F.format_string("fact has %d rows, loader reported " + str(expected), n), "error"


def _lost_verdict(n: Column, named: str) -> Verdict:
    return n == 0, "0", n, F.format_string("%d rows with unknown " + named, n), "error"


def row_count(fact: DataFrame, expected: int) -> DataFrame:
    return _row(fact.agg(F.count("*").alias("n")), *_rows_verdict(F.col("n"), expected))


def foreign_keys(fact: DataFrame, dim: DataFrame, foreign: str, key: str, null_is_orphan: bool = False) -> DataFrame:
    counted = orphans(fact, dim, foreign, key, null_is_orphan).agg(F.count("*").alias("n"))
    return _row(counted, *_lost_verdict(F.col("n"), foreign))


def asset_keys(fact: DataFrame, assets: DataFrame) -> DataFrame:
    """Rows whose source or target host is unknown; a row with both counts once."""
    side = assets.select("asset_sk")
    s, d = side.withColumnRenamed("asset_sk", "_s"), side.withColumnRenamed("asset_sk", "_d")
    roles = fact.select("src_asset_sk", "dest_asset_sk").groupBy("src_asset_sk", "dest_asset_sk").agg(F.count("*").alias("c"))
    joined = roles.join(s, F.col("src_asset_sk") == F.col("_s"), "left").join(d, F.col("dest_asset_sk") == F.col("_d"), "left")
    lost = (F.col("src_asset_sk").isNotNull() & F.col("_s").isNull()) | (
        F.col("dest_asset_sk").isNotNull() & F.col("_d").isNull())
    counted = joined.filter(lost).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    return _row(counted, *_lost_verdict(F.col("n"), "hosts"))


def _benign_verdict(n: Column, benign: Column, low: float, high: float, least: int) -> Verdict:
    share = F.coalesce(percent(benign, n), F.lit(0.0))
    small = n < least
    return (small | share.between(low, high), f"{low:g}-{high:g}%", F.concat(share.cast("string"), F.lit("%")),
            F.when(small, "Skipped: dataset too small").otherwise("share of benign rows"), F.when(small, "info").otherwise("warning"))


def benign_share(fact: DataFrame, low: float = 50.0, high: float = 95.0, least: int = 100) -> DataFrame:
    counted = fact.agg(
        F.count("*").alias("n"), F.count_if(F.col("attack_family_denorm") == "Benign").alias("benign"))
    return _row(counted, *_benign_verdict(F.col("n"), F.col("benign"), low, high, least))


def _window_verdict(n: Column, first: Column, last: Column, day: str, hour: int) -> Verdict:
    absent = n == 0
    on_day = (F.to_date(first) == F.lit(day).cast("date")) & (F.to_date(last) == F.lit(day).cast("date"))
    right = on_day & (F.hour(first) == hour)
    return (absent | F.coalesce(right, F.lit(False)), f"{day} {hour:02d}h",
            F.when(absent, "absent").otherwise(F.format_string("%s to %s (%d events)", first.cast("string"), last.cast("string"), n)),
            F.when(absent, "Skipped: label not present").when(right, "OK").otherwise("events outside the documented window"),
            F.when(absent, "info").otherwise("error"))


def label_window(fact: DataFrame, attack_types: DataFrame, label: str, day: str, hour: int) -> DataFrame:
    """A label is seen on the expected day only and starts in the expected hour; absent labels pass."""
    wanted = attack_types.filter(F.col("attack_label") == label).select("attack_sk")
    seen = fact.join(wanted, "attack_sk", "left_semi").agg(
        F.count("*").alias("n"), F.min("event_time").alias("a"), F.max("event_time").alias("b"))
    return _row(seen, *_window_verdict(F.col("n"), F.col("a"), F.col("b"), day, hour))


def _coverage_verdict(n: Column, known: Column, column: str, least: float) -> Verdict:
    share = F.coalesce(percent(known, n), F.lit(0.0))
    empty = n == 0
    return (empty | (share >= least), f">={least:g}%", F.format_string("%s%% (%d/%d)", share.cast("string"), known, n),
            F.when(empty, "nothing to check").otherwise(f"{column} known for external hosts"), F.when(empty, "info").otherwise("warning"))


def coverage(assets: DataFrame, column: str = "country_iso", least: float = 80.0) -> DataFrame:
    """Share of external hosts with a value."""
    counted = assets.filter(F.col("is_internal") == 0).agg(F.count("*").alias("n"), F.count(column).alias("k"))
    return _row(counted, *_coverage_verdict(F.col("n"), F.col("k"), column, least))


def population(df: DataFrame, expected: str = "any") -> DataFrame:
    n = F.col("n")
    return _row(df.agg(F.count("*").alias("n")), F.lit(True), expected, n, F.format_string("%d rows", n), "info")


def run_checks(spark: SparkSession, checks: list[Check], run_id: str = "") -> DataFrame:
    """Every check gives one result row; one that raises gives an execution error, the others still run."""
    rows, now = [], datetime.now()
    for check in checks:
        try:
            r = check.frame().first()
            rows.append((run_id, check.name, check.category, r["severity"], int(r["passed"]), r["expected"],
                         r["actual"], r["message"], now))
        except Exception as error:  # noqa: BLE001 - a broken check is a result, not an abort
            rows.append((run_id, check.name, "execution_error", "error", 0, None, None, f"Exception: {error}", now))
    return spark.createDataFrame(rows, RESULT_SCHEMA)


FINDING_COLUMNS = {
    "src_asset_sk": "fk_integrity_assets", "dest_asset_sk": "fk_integrity_assets", "attack_sk": "fk_integrity_attack_type", "date_sk": "fk_integrity_dates",
    "attack_family_denorm": "attack_distribution_benign_ratio", "event_time": "label_window_matches_documentation"}


def fact_findings(fact: DataFrame, assets: DataFrame, attack_types: DataFrame, dates: DataFrame, label: str) -> DataFrame:
    """One row of all counts that the checks of a fact need, from one pass over it.

    The pass counts rows, with their first and last time, by the keys that are looked up; dimensions meet the counted keys, never the rows.
    """
    keys = ["src_asset_sk", "dest_asset_sk", "attack_sk", "date_sk"]
    counted = fact.groupBy(*keys, "attack_family_denorm").agg(F.count("*").alias("n"), F.min("event_time").alias("a"), F.max("event_time").alias("b"))

    def known(frame, dim, foreign, key, *more):
        side = dim.select(F.col(key).alias(f"_{foreign}"), *more, F.lit(True).alias(f"_has_{foreign}"))
        return frame.join(side, F.col(foreign) == F.col(f"_{foreign}"), "left").drop(f"_{foreign}")

    met = known(counted, attack_types, "attack_sk", "attack_sk", F.col("attack_label").alias("_label"))
    met = known(known(known(met, dates, "date_sk", "date_sk"), assets, "src_asset_sk", "asset_sk"), assets, "dest_asset_sk", "asset_sk")

    def lost(foreign, null_is_orphan=False):
        unknown = F.col(f"_has_{foreign}").isNull()
        return unknown if null_is_orphan else unknown & F.col(foreign).isNotNull()

    def rows(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    named = F.coalesce(F.col("_label") == label, F.lit(False))
    return met.agg(
        rows(F.lit(True)).alias("rows"), rows(F.col("attack_family_denorm") == "Benign").alias("benign"),
        rows(lost("src_asset_sk") | lost("dest_asset_sk")).alias("lost_assets"), rows(lost("attack_sk")).alias("lost_attacks"),
        rows(lost("date_sk", True)).alias("lost_dates"), rows(named).alias("labeled"), F.min(F.when(named, F.col("a"))).alias("first"),
        F.max(F.when(named, F.col("b"))).alias("last"))


def flow_findings(fact: DataFrame, assets: DataFrame, attack_types: DataFrame, dates: DataFrame, users: DataFrame, rows_loaded: int | None = None,
                  label: str = "Heartbleed", day: str = "2017-07-05", hour: int = 15) -> DataFrame:
    """The results of ``flow_checks`` (check_name, check_category, severity, passed, expected_value, actual_value, message) as one plan that
    reads the fact once. A check whose column the fact lacks gives an execution error, the others their results."""
    missing = [c for c in FINDING_COLUMNS if c not in fact.columns]
    broken = {FINDING_COLUMNS[c]: c for c in missing}
    whole = fact.withColumns({c: F.lit(None).cast("timestamp" if c == "event_time" else "string" if c == "attack_family_denorm" else "bigint") for c in missing})
    found = fact_findings(whole, assets, attack_types, dates, label)
    external = assets.filter(F.col("is_internal") == 0).agg(F.struct(F.count("*").alias("n"), F.count("country_iso").alias("k"))).scalar()
    people = users.agg(F.count("*")).scalar()
    found = found.withColumns({"external": external, "people": people})
    c = F.col
    verdicts: dict[tuple[str, str], Verdict] = {} if rows_loaded is None else {("fact_row_count_matches_loaded", "row_count"): _rows_verdict(c("rows"), rows_loaded)}
    verdicts |= {
        ("fk_integrity_assets", "fk_integrity"): _lost_verdict(c("lost_assets"), "hosts"),
        ("fk_integrity_attack_type", "fk_integrity"): _lost_verdict(c("lost_attacks"), "attack_sk"),
        ("fk_integrity_dates", "fk_integrity"): _lost_verdict(c("lost_dates"), "date_sk"),
        ("attack_distribution_benign_ratio", "distribution"): _benign_verdict(c("rows"), c("benign"), 50.0, 95.0, 100),
        ("label_window_matches_documentation", "temporal"): _window_verdict(c("labeled"), c("first"), c("last"), day, hour),
        ("external_ip_geo_coverage", "enrichment"): _coverage_verdict(c("external")["n"], c("external")["k"], "country_iso", 80.0),
        ("user_population", "row_count"): (F.lit(True), "any", c("people"), F.format_string("%d rows", c("people")), "info"),
    }

    def result(name, category, passed, expected, actual, message, severity):
        if name in broken:
            category, passed, expected, actual, message, severity = "execution_error", F.lit(False), F.lit(None), F.lit(None), f"Exception: no column {broken[name]}", "error"
        text = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
        return F.struct(F.lit(name).alias("check_name"), F.lit(category).alias("check_category"), text(severity).alias("severity"), passed.cast("int").alias("passed"),
                        text(expected).alias("expected_value"), text(actual).alias("actual_value"), text(message).alias("message"))

    return found.select(F.inline(F.array(*[result(*named, *verdict) for named, verdict in verdicts.items()])))


def run_flow_checks(spark: SparkSession, fact: DataFrame, assets: DataFrame, attack_types: DataFrame, dates: DataFrame, users: DataFrame,
                    rows_loaded: int | None = None, run_id: str = "") -> DataFrame:
    """Result rows of the standard checks from one plan; if that fails as a whole, each check runs by itself and fails by itself."""
    try:
        found = [tuple(r) for r in flow_findings(fact, assets, attack_types, dates, users, rows_loaded).collect()]
    except Exception:  # noqa: BLE001 - which check is to blame shows when each runs alone
        return run_checks(spark, flow_checks(fact, assets, attack_types, dates, users, rows_loaded), run_id)
    now = datetime.now()
    return spark.createDataFrame([(run_id, *row, now) for row in found], RESULT_SCHEMA)


def check_summary(results: DataFrame) -> DataFrame:
    failed = F.col("passed") == 0
    return results.agg(
        F.count_if(~failed).alias("passed"), F.count_if(failed & (F.col("severity") == "warning")).alias("warnings"),
        F.count_if(failed & (F.col("severity") == "error")).alias("errors"))


def flow_checks(fact, assets, attack_types, dates, users, rows_loaded: int | None = None) -> list[Check]:
    """The standard list run after a flow load."""
    checks = [] if rows_loaded is None else [
        Check("fact_row_count_matches_loaded", "row_count", lambda: row_count(fact, rows_loaded))]
    return checks + [
        Check("fk_integrity_assets", "fk_integrity", lambda: asset_keys(fact, assets)),
        Check("fk_integrity_attack_type", "fk_integrity",
              lambda: foreign_keys(fact, attack_types, "attack_sk", "attack_sk")),
        Check("fk_integrity_dates", "fk_integrity", lambda: foreign_keys(fact, dates, "date_sk", "date_sk", True)),
        Check("attack_distribution_benign_ratio", "distribution", lambda: benign_share(fact)),
        Check("label_window_matches_documentation", "temporal",
              lambda: label_window(fact, attack_types, "Heartbleed", "2017-07-05", 15)),
        Check("external_ip_geo_coverage", "enrichment", lambda: coverage(assets)),
        Check("user_population", "row_count", lambda: population(users)),
    ]
