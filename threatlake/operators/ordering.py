"""Ranks, running totals and exact percentiles that never put a whole group into one task.

A plain window over a hot group sorts that group in a single task. Here every row first
falls into a bucket or range that preserves the order wanted; its totals (few rows) give each
bucket its offset, and the row-level window runs inside one bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threatlake.session import cut_lineage


def seeded_order(*ids: Column, seed: int = 42) -> Column:
    """Pseudo-random but repeatable order text of a row: the same draw on every run and engine."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in ids], F.lit(str(seed))))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the right keys are dropped."""
    if not keys:
        raise ValueError("keys needed")
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = None
    for k in keys:
        same = left[k].eqNullSafe(other[f"_r_{k}"])
        condition = same if condition is None else condition & same
    return left.join(other, condition, how).drop(*[f"_r_{k}" for k in keys])


#: Bytes up to which a measured table is sent to every task.
BROADCAST_BYTES = 8 << 20


def broadcast_if_small(df: DataFrame, texts: list[str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """The stored frame, marked for a broadcast if its rows, counted, and the longest values of ``texts`` prove it small."""
    stored = cut_lineage(df)
    width = sum((F.coalesce(F.max(F.octet_length(F.col(c).cast("string"))), F.lit(0)) for c in texts), F.lit(16 * len(df.columns)))
    size = stored.agg((F.count("*") * width).alias("bytes")).first()["bytes"]
    return F.broadcast(stored) if size <= limit else stored


def rank_by_hash(
    df: DataFrame, keys: list[str], order: Column, out: str = "rn", first: int | None = None, digits: int = 4,
) -> DataFrame:
    """Row number inside ``keys`` by hash text ``order`` (hex digits, evenly spread).

    16**digits buckets per group keep the window partitions small even when one group
    holds most rows. Adds ``out`` (1-based) and ``_size``, the number of rows of the group.
    With ``first`` only the first rows of every group are wanted: just the buckets in which they lie are kept, and
    the join with these cuts the rows where they are read while that list is small, else by a shuffle on its keys.
    """
    hashed = df.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, digits))
    totals = hashed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    per_group = W.partitionBy(*keys)
    before = F.coalesce(
        F.sum("_n").over(per_group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = totals.select(*keys, "_bucket", before.alias("_before"), F.sum("_n").over(per_group).alias("_size"))
    if first is not None:
        offsets = broadcast_if_small(offsets.filter(F.col("_before") < first), [*keys, "_bucket"])
    placed = join_on(hashed, offsets, [*keys, "_bucket"])
    inside = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy("_order"))
    ranked = placed.withColumn(out, F.col("_before") + inside)
    if first is not None:
        ranked = ranked.filter(F.col(out) <= first)
    return ranked.drop("_before", "_bucket", "_order")


def running_totals(df: DataFrame, keys: list[str], by: str, measures: list[str]) -> DataFrame:
    """For rows with distinct ``by`` inside ``keys``: totals of smaller rows and of the whole group.

    Adds ``<m>_below`` (rows with a smaller ``by``) and ``<m>_total`` per measure. Rows are dealt out by ranges whose
    bounds are sampled from the data, so a heavy tail does not crowd one task; the ranges are stored once and read for
    their totals and for the rows.
    """
    ranged = cut_lineage(df.repartitionByRange(*keys, by).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_part").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])

    def below(column, window):
        return F.coalesce(F.sum(column).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    group = W.partitionBy(*keys)
    offsets = totals.select(
        *keys, "_part", *[below(f"_t_{m}", group.orderBy("_part")).alias(f"_before_{m}") for m in measures],
        *[F.sum(f"_t_{m}").over(group).alias(f"{m}_total") for m in measures])
    inside = W.partitionBy(*keys, "_part").orderBy(by)
    local = ranged.withColumns({f"_inside_{m}": below(m, inside) for m in measures})
    joined = join_on(local, offsets, [*keys, "_part"])
    placed = joined.withColumns({f"{m}_below": F.col(f"_inside_{m}") + F.col(f"_before_{m}") for m in measures})
    return placed.drop("_part", *[f"_{p}_{m}" for p in ("inside", "before") for m in measures])


def exact_percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Percentiles (name -> fraction) with linear interpolation per group, all from one pass over the value counts;
    NULL values are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_totals(counts, keys, "_v", ["_n"])
    places = {name: F.lit(float(fraction)) * (F.col("_n_total") - 1) for name, fraction in fractions.items()}

    def covers(k):
        return (F.col("_n_below") <= k) & (k < F.col("_n_below") + F.col("_n"))

    ends = {}
    for name, place in places.items():
        ends[f"_a_{name}"] = F.max(F.when(covers(F.floor(place)), F.col("_v")))
        ends[f"_b_{name}"] = F.max(F.when(covers(F.ceil(place)), F.col("_v")))
        ends[f"_w_{name}"] = F.max(place - F.floor(place))
    picked = placed.groupBy(*keys).agg(*[c.alias(n) for n, c in ends.items()])

    def blended(name):
        low, high, weight = (F.col(f"_{p}_{name}") for p in "abw")
        return low + (high - low) * weight

    return picked.select(*keys, *[blended(name).alias(name) for name in fractions])


def exact_percentile(df: DataFrame, keys: list[str], value: str, fraction: float, out: str) -> DataFrame:
    return exact_percentiles(df, keys, value, {out: fraction})


def latest_per_key(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row with the greatest ``by`` per key, as a partial aggregate instead of a window."""
    row = F.struct(*[F.col(c) for c in df.columns])
    newest = df.groupBy(*keys).agg(F.max_by(row, F.struct(*by)).alias("_row"))
    return newest.select("_row.*")


def top_per_group(df: DataFrame, group: list[str], item: list[str]) -> DataFrame:
    """Most frequent ``item`` of each group with its count; ties go to the smallest item."""
    counts = df.groupBy(*group, *item).agg(F.count("*").alias("cnt"))
    best = counts.groupBy(*group).agg(F.max("cnt").alias("cnt"), F.min_by(
        F.struct(*item), F.struct((-F.col("cnt")).alias("n"), *item)).alias("_item"))
    return best.select(*group, "_item.*", "cnt")


def with_share(counts: DataFrame, count: str = "events", out: str = "pct", places: int = 2) -> DataFrame:
    """Share of the grand total, from a scalar subquery over the aggregated rows."""
    from threatlake.functions.numbers import percent

    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(out, percent(F.col(count), total, places))


def value_counts(df: DataFrame, column: str, limit: int | None = 10, out: str = "cnt") -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias(out)).orderBy(F.desc(out), F.asc(column))
    return counts.limit(limit) if limit else counts


def largest(df: DataFrame, by: list[Column], limit: int) -> DataFrame:
    """First rows of an order: each task keeps ``limit`` rows, nothing is sorted as a whole."""
    return df.orderBy(*by).limit(limit)
