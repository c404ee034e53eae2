"""Event times: parsing, calendar keys, office hours. Three weekday counts exist and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatlake.functions.labels import is_blank
from threatlake.functions.numbers import flag

LOG_FORMAT = "MM/dd/yyyy HH:mm:ss"


def parse_text(text: Column, fmt: str) -> Column:
    """Text to a zone-free timestamp, NULL when it does not fit."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def parse_log_time(text: Column, fmt: str = LOG_FORMAT) -> Column:
    return parse_text(text, fmt)


def clock_part(text: Column, index: int) -> Column:
    """Hour (1) or minute (2) text of a 'date time' string."""
    return F.split_part(F.split_part(F.trim(text), F.lit(" "), F.lit(2)), F.lit(":"), F.lit(index))


def text_time_parts(text: Column) -> dict[str, Column]:
    """The pieces of a 'd/m/y h:m' string, still text."""
    slash = F.lit("/")
    return {
        "day_part": F.split_part(text, slash, F.lit(1)),
        "month_part": F.split_part(text, slash, F.lit(2)),
        "year_and_time_part": F.split_part(text, slash, F.lit(3)),
        "time_part": F.split_part(text, F.lit(" "), F.lit(2)),
        "hour_part": clock_part(text, 1),
        "minute_part": clock_part(text, 2),
    }


def parse_flow_time(text: Column, source_day: Column, padded_day: str = "Monday") -> Column:
    """Day-first text on a 12-hour clock without am/pm: hours 1 to 5 are afternoon."""
    trimmed = F.trim(text)
    padded, loose = parse_text(trimmed, "dd/MM/yyyy HH:mm:ss"), parse_text(trimmed, "d/M/yyyy H:mm")
    parsed = F.when(source_day == padded_day, padded).otherwise(loose)
    afternoon = clock_part(text, 1).try_cast("int").between(1, 5)
    shifted = F.when(afternoon, parsed + F.expr("INTERVAL 12 HOURS")).otherwise(parsed)
    return F.when(is_blank(text), None).otherwise(shifted)


def date_key(ts: Column) -> Column:
    return F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)


def time_key(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def outside_hours(ts: Column, start: int = 7, end: int = 19) -> Column:
    """1 before ``start`` or from ``end`` on: 7 to 19 for flows, 9 to 17 for user activity."""
    hour = F.hour(ts)
    return F.when(ts.isNull(), None).otherwise(flag((hour < start) | (hour >= end)))


def weekend(ts: Column) -> Column:
    return F.when(ts.isNull(), None).otherwise(flag(monday_zero(ts) >= 5))


def sunday_zero(ts: Column) -> Column:
    return F.dayofweek(ts) - 1


def monday_zero(ts: Column) -> Column:
    return F.weekday(ts)


def monday_one(ts: Column) -> Column:
    return F.weekday(ts) + 1


def hour_bucket(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def month_bucket(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def period_label(hour: Column) -> Column:
    return F.when(hour.between(9, 16), "Working hours (9 AM - 5 PM)").otherwise("After hours")


def window_days(start: Column, end: Column) -> Column:
    return F.date_diff(end.cast("date"), start.cast("date"))


def in_window(malicious: Column, ts: Column, start: Column, end: Column) -> Column:
    """Both ends belong to the window."""
    return flag((malicious == 1) & (ts >= start) & (ts <= end))
