"""User activity: mail recipients, files, activity names, deviations from a personal baseline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatlake.constants import ACTIVITY_NAMES, CORPORATE_DOMAIN, DEVICE_ACTIONS
from threatlake.functions.numbers import flag, ladder, lookup


def recipient_count(*lists: Column) -> Column:
    """Entries of semicolon lists, summed over the non-empty ones."""
    total = F.lit(0)
    for c in lists:
        total = total + F.when(c.isNull() | (c == ""), 0).otherwise(F.size(F.split(c, ";")))
    return total


def to_external(recipients: Column, domain: str = CORPORATE_DOMAIN) -> Column:
    def outside(address):
        clean = F.lower(F.trim(address))
        return (clean != "") & ~clean.contains(domain)

    return flag(F.exists(F.split(recipients, ";"), outside))


def from_external(sender: Column, domain: str = CORPORATE_DOMAIN) -> Column:
    return flag(~F.lower(sender).contains(domain))


def destination_pattern(recipients: Column, domain: str = CORPORATE_DOMAIN) -> Column:
    inside = recipients.like(f"%{domain}%")
    return (
        F.when(recipients.isNull(), "No recipient")
        .when(inside & ~recipients.like("%;%@%"), "Internal only (single)")
        .when(inside & recipients.like("%;%"), "Mixed internal/external")
        .otherwise("External only")
    )


def separators(text: Column, mark: str = ";") -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def approx_recipients(recipients: Column) -> Column:
    return separators(recipients) + 1


def file_extension(name: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)), F.lit(""))


def activity_name(kind: Column) -> Column:
    return lookup(kind, ACTIVITY_NAMES)


def device_activity(action: Column) -> Column:
    return lookup(action, DEVICE_ACTIONS)


def tens_bucket(score: Column) -> Column:
    return ladder(score, ((10, "00-09"), (20, "10-19"), (30, "20-29"), (40, "30-39")), "40+")


def size_bucket(size: Column) -> Column:
    steps = ((10**4, "< 10 KB"), (10**5, "10-100 KB"), (10**6, "100 KB - 1 MB"), (10**7, "1-10 MB"))
    return ladder(size, steps, "> 10 MB")


def deviation(today: Column, baseline: Column) -> Column:
    return today - F.coalesce(baseline.cast("double"), F.lit(0.0))


def ratio(today: Column, baseline: Column, empty: float = 0.1, cap: float = 50.0) -> Column:
    usual = F.coalesce(F.nullif(baseline.cast("double"), F.lit(0.0)), F.lit(empty))
    return F.least(today / usual, F.lit(cap))


def share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1))


def signal_count(z_scores: list[Column], ratios: list[Column], z_limit: float = 2, ratio_limit: float = 3) -> Column:
    total = F.lit(0)
    for c in z_scores:
        total = total + flag(c > z_limit)
    for c in ratios:
        total = total + flag(c > ratio_limit)
    return total


def user_day_group(malicious: Column, scenario: Column, attack_day: Column, style: str = "long") -> Column:
    day, rest = {
        "long": ("Scen {} (attack day)", "Malicious (non-attack day)"),
        "short": ("Scen {} attack day", "Malicious non-attack"),
    }[style]
    group = F.when(malicious == 0, "Legitimate")
    for number in (1, 2, 3):
        group = group.when((scenario == number) & (attack_day == 1), day.format(number))
    return group.otherwise(rest)


def event_class(insider: Column, ts: Column, start: Column, end: Column) -> Column:
    return (
        F.when(insider.isNull(), "Benign user")
        .when(ts.between(start, end), "Malicious user (during attack window)")
        .otherwise("Malicious user (outside attack window)")
    )
