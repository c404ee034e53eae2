"""Casts that never fail, and rounding rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ladder(value: Column, steps, above, *, inclusive: bool = False) -> Column:
    """First label whose upper limit lies above ``value`` (half-open steps), else ``above``."""
    out = None
    for limit, label in steps:
        hit = value <= limit if inclusive else value < limit
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(above)


def floor_ladder(value: Column, steps, below) -> Column:
    """First label whose lower limit (inclusive) is reached, steps given from the highest."""
    out = None
    for limit, label in steps:
        out = F.when(value >= limit, label) if out is None else out.when(value >= limit, label)
    return out.otherwise(below)


def lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed map, NULL for unknown keys."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition counts as 0."""
    return F.when(condition, 1).otherwise(0)


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """100 * part / whole, half away from zero, in whole-number arithmetic; NULL when whole is 0."""
    scale = 10**places
    twice = F.nullif(whole.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")) * 2
    scaled = part.cast("decimal(20,0)") * (200 * scale) + whole.cast("decimal(20,0)")
    return ((scaled - scaled % twice) / twice).cast("double") / scale


def to_double(text: Column) -> Column:
    """Text holding inf or nan in any case is NULL, the rest a safe cast."""
    return F.when(text.rlike("(?i)inf|nan"), None).otherwise(text.try_cast("double"))


def to_integer(text: Column, type_name: str = "bigint") -> Column:
    """Number text to an integer, half to even; bad text is NULL."""
    number = text.try_cast("double")
    finite = F.when(~(F.isnan(number) | (F.abs(number) == float("inf"))), number)
    return F.bround(finite).try_cast(type_name)


def finite_or_zero(value: Column) -> Column:
    """Infinite, NaN and missing measures become 0."""
    number = value.cast("double")
    bad = F.isnan(number) | (F.abs(number) == float("inf")) | number.isNull()
    return F.when(bad, 0.0).otherwise(number)


def cast_by_map(df: DataFrame, types: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One projection with safe casts: column -> string, integer, bigint or double."""
    cast = {
        "string": lambda c: c,
        "double": to_double,
        "int": lambda c: to_integer(c, "int"),
        "bigint": to_integer,
    }
    typed = [cast[kind](F.col(f"`{name}`")).alias(name) for name, kind in types.items()]
    return df.select(*typed, *[F.col(f"`{name}`") for name in keep])


def coerce_integers(df: DataFrame, columns) -> DataFrame:
    """Nullable longs; columns that are whole numbers already are widened only, so no digit is lost, and doubles need no text in between."""
    kinds = dict(df.dtypes)
    whole = ("tinyint", "smallint", "int", "bigint")
    return df.withColumns({
        c: F.col(c).cast("bigint") if kinds[c] in whole else to_integer(F.col(c) if kinds[c] == "double" else F.col(c).cast("string")) for c in columns if c in kinds})


def clean_features(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: finite_or_zero(F.col(c)) for c in columns})
