"""Key lookups, as-of and range joins, orphan search, enrichment, score merge.

No side is broadcast by hint: Catalyst and the adaptive planner broadcast a side whose
measured size lies under the session threshold and shuffle (splitting skewed keys) otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threatlake.functions.numbers import percent
from threatlake.functions.network import ipv4_number, ipv6_digits
from threatlake.operators.ordering import largest


def resolve_key(
    fact: DataFrame, dim: DataFrame, natural: dict[str, str], key: str, out: str,
) -> DataFrame:
    """Left lookup of a surrogate key; ``natural`` maps fact columns to dimension columns."""
    side = dim.select(*[F.col(d).alias(f"_k_{i}") for i, d in enumerate(natural.values())], F.col(key).alias(out))
    condition = [F.col(f) == F.col(f"_k_{i}") for i, f in enumerate(natural)]
    return fact.join(side, condition, "left").drop(*[f"_k_{i}" for i in range(len(natural))])


def resolution_rates(fact: DataFrame, keys: list[str], places: int = 4) -> DataFrame:
    """Percent of rows with each key, all keys in one pass."""
    return fact.agg(*[percent(F.count(k), F.count("*"), places).alias(k) for k in keys])


def asof_join(
    left: DataFrame, right: DataFrame, by: str, on: str, start: str, until: str | None = None,
) -> DataFrame:
    """Latest right row with ``start`` <= ``on`` per key; rows past its ``until`` or without one are dropped.

    Each right row is valid until the next start of the same key, so the match is an equi-join
    with a range residual and every left row finds one partner at most. The window runs over
    the right side only, after equal (key, start) rows were reduced to the last one.
    """
    columns = [c for c in right.columns if c not in (by, start)]
    unique = right.groupBy(by, start).agg(F.max_by(F.struct(*columns), F.struct(*columns)).alias("_row"))
    following = F.lead(start).over(W.partitionBy(by).orderBy(start))
    spans = unique.select(F.col(by).alias("_by"), F.col(start).alias("_from"), following.alias("_next"), "_row.*")
    when = F.col(on)
    inside = (when >= F.col("_from")) & (F.col("_next").isNull() | (when < F.col("_next")))
    condition = (F.col(by) == F.col("_by")) & inside
    if until:
        condition = condition & (when < F.col(until))
    return left.join(spans, condition).withColumnRenamed("_from", start).drop("_by", "_next")


def version_join(left: DataFrame, dim: DataFrame, by: str, on: str) -> DataFrame:
    """Version of a dimension row valid at ``on``: [valid_from, valid_to) intervals do not overlap."""
    side = dim.withColumnRenamed(by, "_by")
    inside = (F.col(on) >= F.col("valid_from")) & (F.col(on) < F.col("valid_to"))
    return left.join(side, (F.col(by) == F.col("_by")) & inside).drop("_by")


def range_join(points: DataFrame, ranges: DataFrame, number: str, low: str, high: str, shift: int = 16) -> DataFrame:
    """Left join of numbers into ranges: equal prefix (number >> shift), then the exact range test."""
    prefixes = F.explode(F.sequence(F.shiftright(low, shift), F.shiftright(high, shift)))
    pieces = ranges.withColumn("_range_prefix", prefixes)
    marked = points.withColumn("_prefix", F.shiftright(number, shift))
    condition = (F.col("_prefix") == F.col("_range_prefix")) & F.col(number).between(F.col(low), F.col(high))
    return marked.join(pieces, condition, "left").drop("_prefix", "_range_prefix", low, high)


def digits_join(points: DataFrame, ranges: DataFrame, digits: str, low: str, high: str) -> DataFrame:
    """Left join of numbers into ranges, all as hexadecimal text of one length; ranges do not overlap.

    A range that is one block of a shared prefix keeps that prefix as key, any other is cut at its first digit that differs, into 16 pieces
    at most. A number has one key per prefix length that occurs, so the match is an equi-join with the range as residual. Equal numbers
    are looked up once.
    """
    shared = F.regexp_extract(F.concat_ws("|", low, high), r"^([0-9a-f]*)[0-9a-f]*\|\1", 1)
    cut = ranges.withColumn("_shared", shared).withColumn("_n", F.length("_shared"))
    rest = [F.substr(c, F.col("_n") + 1) for c in (F.col(low), F.col(high))]
    whole = rest[0].rlike("^0*$") & rest[1].rlike("^f*$")
    first, last = (F.conv(F.left(r, F.lit(1)), 16, 10).cast("int") for r in rest)
    keys = F.when(whole, F.array("_shared")).otherwise(F.transform(F.sequence(first, last), lambda d: F.concat("_shared", F.lower(F.hex(d)))))
    pieces = cut.withColumn("_key", F.explode(keys)).drop("_shared", "_n")
    lengths = [r.n for r in pieces.select(F.length("_key").alias("n")).distinct().collect()]
    numbers = points.where(F.col(digits).isNotNull()).select(F.col(digits).alias("_digits")).distinct()
    keyed = numbers.withColumn("_key", F.explode(F.array(*[F.left("_digits", F.lit(n)) for n in lengths]).cast("array<string>")))
    found = keyed.join(pieces, (keyed["_key"] == pieces["_key"]) & F.col("_digits").between(F.col(low), F.col(high))).drop("_key", low, high)
    return points.join(found, F.col(digits) == F.col("_digits"), "left").drop("_digits")


def geo_join(addresses: DataFrame, ranges: DataFrame, address: str = "ip") -> DataFrame:
    """Country columns of the network range an address falls into, NULL outside all ranges.

    IPv4 ranges have numbers ``ip_from`` and ``ip_to``; IPv6 ranges, where the table has them, text ``ip6_from`` and ``ip6_to``.
    """
    ends = ["ip6_from", "ip6_to"]
    colon = F.coalesce(F.contains(F.col(address), F.lit(":")), F.lit(False))
    has6 = set(ends) <= set(ranges.columns)
    numbered = (addresses.where(~colon) if has6 else addresses).withColumn("_number", ipv4_number(F.col(address)))
    out = range_join(numbered, ranges.where(F.col("ip_from").isNotNull()).drop(*ends) if has6 else ranges, "_number", "ip_from", "ip_to").drop("_number")
    if not has6:
        return out
    nets = ranges.where(F.col("ip6_from").isNotNull()).drop("ip_from", "ip_to").withColumns({c: ipv6_digits(F.col(c)) for c in ends})
    points = addresses.where(colon).withColumn("_digits6", ipv6_digits(F.col(address)))
    return out.unionByName(digits_join(points, nets, "_digits6", *ends).drop("_digits6"))


def reputation_join(addresses: DataFrame, reputation: DataFrame, address: str = "ip", limit: int = 50) -> DataFrame:
    """Confidence of listed addresses; known attacker from ``limit`` on, 0 when unlisted."""
    scores = reputation.select(F.col(address), "abuse_confidence")
    known = F.coalesce((F.col("abuse_confidence") >= limit).cast("int"), F.lit(0))
    return addresses.join(scores, address, "left").withColumn("is_known_attacker", known)


def busiest_misses(events: DataFrame, cache: DataFrame, address: str = "ip", limit: int = 500) -> DataFrame:
    """Most frequent addresses that the cache does not hold."""
    volume = events.groupBy(address).agg(F.count("*").alias("events"))
    missing = volume.join(cache.select(address), address, "left_anti")
    return largest(missing, [F.desc("events"), F.asc(address)], limit)


def enrich_with_cache(
    addresses: DataFrame, cache: DataFrame, ranges: DataFrame, reputation: DataFrame, address: str = "ip",
) -> tuple[DataFrame, DataFrame]:
    """(this run's enriched addresses, grown cache): only addresses the cache lacks are looked up.

    ``enrichment_status`` tells cached misses from hits. Write the second frame to a new
    folder version: it reads the old one.
    """
    wanted = addresses.select(address).distinct()
    misses = wanted.join(cache.select(address), address, "left_anti")
    fresh = reputation_join(geo_join(misses, ranges, address), reputation, address)
    status = F.when(F.col("country_iso").isNull() & F.col("abuse_confidence").isNull(), "not_found").otherwise("found")
    grown = cache.unionByName(fresh.withColumn("enrichment_status", status), allowMissingColumns=True)
    return grown.join(wanted, address, "left_semi"), grown


def orphans(fact: DataFrame, dim: DataFrame, foreign: str, key: str, null_is_orphan: bool = False) -> DataFrame:
    """Fact rows whose key is unknown to the dimension."""
    candidates = fact if null_is_orphan else fact.filter(F.col(foreign).isNotNull())
    return candidates.join(dim.select(F.col(key).alias("_key")), F.col(foreign) == F.col("_key"), "left_anti")


def key_overlap(left: DataFrame, right: DataFrame, key: str, names=("in_left", "in_right", "in_both")) -> DataFrame:
    """Distinct keys of each side and of both, from one aggregate over tagged keys."""
    tagged = left.select(F.col(key), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(F.col(key), F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = tagged.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(
        F.sum("l").alias(names[0]), F.sum("r").alias(names[1]), F.sum(F.col("l") * F.col("r")).alias(names[2])
    )


def merge_columns(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Target rows with ``columns`` replaced where the update table has the key."""
    side = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = target.join(side, keys, "left")
    have = set(target.columns)
    new = {
        c: F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c) if c in have else None) for c in columns
    }
    return joined.withColumns(new).drop("_hit", *[f"_u_{c}" for c in columns])


def two_role_join(fact: DataFrame, dim: DataFrame, key: str, roles: dict[str, str], columns: list[str]) -> DataFrame:
    """Inner joins of one dimension in several roles; its columns get the role as prefix."""
    out = fact
    for role, foreign in roles.items():
        side = dim.select(F.col(key).alias(f"_{role}"), *[F.col(c).alias(f"{role}_{c}") for c in columns])
        out = out.join(side, F.col(foreign) == F.col(f"_{role}")).drop(f"_{role}")
    return out


def class_of_events(events: DataFrame, insiders: DataFrame, user: str, ts: str) -> DataFrame:
    """Adds the insider columns and ``event_class`` (benign user, inside or outside the window)."""
    from threatlake.functions.activity import event_class

    side = insiders.select(
        F.col("user_id").alias("_insider"), "scenario", "window_start", "window_end")
    joined = events.join(side, F.col(user) == F.col("_insider"), "left")
    named: Column = event_class(F.col("_insider"), F.col(ts), F.col("window_start"), F.col("window_end"))
    return joined.withColumns({"event_class": named, "is_insider": F.col("_insider").isNotNull()}).drop("_insider")
