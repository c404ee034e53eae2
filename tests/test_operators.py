"""Operators against straight loops on small data, with hot groups."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threatlake.operators import aggregates as G
from threatlake.operators import dimensions as D
from threatlake.operators import insider as I
from threatlake.operators import joins as J
from threatlake.operators import ordering as O
from threatlake.operators import sampling as SA

MONTHS = [dt.date(2010 + i // 12, 1 + i % 12, 1) for i in range(8)]


def loop_history(snapshots):
    """Walks snapshots in order, closing and opening versions."""
    open_, done = {}, []
    for day in sorted({s[0] for s in snapshots}):
        now = {u: a for d, u, a in snapshots if d == day}
        for user in [u for u in open_ if u not in now]:
            start, attr = open_.pop(user)
            done.append((user, attr, start, day, 0))
        for user, attr in now.items():
            if user in open_ and open_[user][1] != attr:
                start, old = open_.pop(user)
                done.append((user, old, start, day, 0))
            open_.setdefault(user, (day, attr))
    return sorted(done + [(u, a, s, dt.date(9999, 12, 31), 1) for u, (s, a) in open_.items()], key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(MONTHS), st.integers(1, 4), st.sampled_from(["a", "b", None])), min_size=1, max_size=40))
def test_history_equals_loop(spark, rows):
    rows = list({(d, u): (d, u, a) for d, u, a in rows}.values())
    df = spark.createDataFrame(rows, "day date, user int, attr string")
    got = [tuple(r) for r in D.build_history(df, "user", "day", ["attr"]).collect()]
    assert sorted(got, key=str) == loop_history(rows)


def test_history_keeps_the_last_duplicate(spark):
    rows = [(MONTHS[0], 1, "old", 1), (MONTHS[0], 1, "new", 2)]
    df = spark.createDataFrame(rows, "day date, user int, attr string, line int")
    assert [r["attr"] for r in D.build_history(df, "user", "day", ["attr"], "line").collect()] == ["new"]


def test_asof_join_equals_loop(spark):
    rng = random.Random(1)
    left = [(i, 1 if i % 3 else rng.randrange(5), rng.randrange(100)) for i in range(300)]
    right = list({(rng.randrange(5), t): None for t in rng.sample(range(100), 25)})
    right = [(k, t, t + rng.randrange(1, 40), f"v{k}-{t}") for k, t in right]
    got = J.asof_join(
        spark.createDataFrame(left, "i int, k int, at int"), spark.createDataFrame(right, "k int, start int, stop int, name string"),
        "k", "at", "start", "stop")
    want = []
    for i, k, at in left:
        earlier = [r for r in right if r[0] == k and r[1] <= at]
        if earlier:
            best = max(earlier, key=lambda r: r[1])
            if at < best[2]:
                want.append((i, best[3]))
    assert sorted((r["i"], r["name"]) for r in got.collect()) == sorted(want)


def test_range_join_spans_prefixes(spark):
    ranges = spark.createDataFrame([(0, 70000, "a"), (70001, 70001, "b"), (200000, 900000, "c")], "lo bigint, hi bigint, name string")
    numbers = [0, 65535, 65536, 70000, 70001, 70002, 199999, 200000, 500000, 900000, 900001, None]
    points = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    got = {r["n"]: r["name"] for r in J.range_join(points, ranges, "n", "lo", "hi").collect()}
    assert got == {0: "a", 65535: "a", 65536: "a", 70000: "a", 70001: "b", 70002: None, 199999: None, 200000: "c", 500000: "c", 900000: "c", 900001: None, None: None}


def hot_rows(n=3000):
    """One group holds most rows; NULL is a group too."""
    return [(i, "hot" if i % 10 else ("cold", None, "rare")[i // 10 % 3]) for i in range(n)]


def test_rank_by_hash_is_a_permutation(spark):
    df = spark.createDataFrame(hot_rows(), "i int, g string")
    ranked = O.rank_by_hash(df, ["g"], O.seeded_order(F.col("i"))).collect()
    groups = {}
    for r in ranked:
        groups.setdefault(r["g"], []).append(r["rn"])
        assert r["_size"] == sum(1 for x in ranked if x["g"] == r["g"])
    assert len(ranked) == 3000 and all(sorted(v) == list(range(1, len(v) + 1)) for v in groups.values())


def test_samples_take_small_groups_whole(spark):
    df = spark.createDataFrame(hot_rows(), "i int, g string")
    rows = SA.stratified_sample(df, ["g"], ["i"], 150).collect()
    sizes = {g: sum(1 for r in rows if r["g"] == g) for g in ("hot", "cold", "rare", None)}
    assert sizes == {"hot": 150, "cold": 100, "rare": 100, None: 100}
    again = SA.stratified_sample(df.repartition(13), ["g"], ["i"], 150).collect()
    assert {r["i"] for r in rows} == {r["i"] for r in again}


@pytest.mark.parametrize("test,val", [(0.2, 0.1), (0.3, 0.1)])
def test_split_is_disjoint_and_proportional(spark, test, val):
    df = spark.createDataFrame(hot_rows(), "i int, g string")
    rows = SA.stratified_split(df, ["g"], ["i"], test, val).collect()
    assert len({r["i"] for r in rows}) == len(rows) == 3000
    for g, size in (("hot", 2700), ("cold", 100), ("rare", 100), (None, 100)):
        mine = [r["split"] for r in rows if r["g"] == g]
        assert mine.count("test") == round(size * test) and mine.count("val") == round(size * val)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.floats(-1e6, 1e6) | st.sampled_from([0.5, 0.5000001])), min_size=1, max_size=60))
def test_running_totals_equal_loop(spark, rows):
    rows = [(g, v, i + 1) for i, (g, v) in enumerate(dict.fromkeys((g, v + 0.0) for g, v in rows))]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    for r in O.running_totals(df, ["g"], "v", ["n"]).collect():
        assert r["n_below"] == sum(n for g, v, n in rows if g == r["g"] and v < r["v"])
        assert r["n_total"] == sum(n for g, _, n in rows if g == r["g"])


def test_heavy_tail_is_dealt_out_evenly(spark):
    rows = spark.range(20_000).select((F.col("id") * 0.005).alias("v"), F.lit(1).alias("n")).union(spark.sql("SELECT 1e15D, 1"))
    ranged = rows.repartitionByRange("v").groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count").alias("most"), F.avg("count").alias("mean")).first()
    assert ranged["most"] < 3 * ranged["mean"]
    top = O.running_totals(rows, [], "v", ["n"]).orderBy(F.desc("v")).first()
    assert (top["n_below"], top["n_total"]) == (20_000, 20_001)


def test_exact_percentile(spark):
    rng = random.Random(5)
    rows = [("a", rng.random()) for _ in range(501)] + [("a", 0.25)] * 400 + [("b", float(i)) for i in range(10)] + [("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for fraction in (0.0, 0.25, 0.5, 0.99, 1.0):
        got = {r["g"]: r["p"] for r in O.exact_percentile(df, ["g"], "v", fraction, "p").collect()}
        for g in "abc":
            values = sorted(v for k, v in rows if k == g)
            place = fraction * (len(values) - 1)
            low, high = values[math.floor(place)], values[math.ceil(place)]
            assert got[g] == pytest.approx(low + (high - low) * (place - math.floor(place)), abs=1e-12)


def test_latest_and_top(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, None)], "k int, t int, v string")
    assert sorted((r["k"], r["v"]) for r in O.latest_per_key(df, ["k"], ["t"]).collect()) == [(1, "c"), (2, None)]
    df = spark.createDataFrame([("p", "x")] * 3 + [("p", "a")] * 3 + [("q", "z")], "g string, i string")
    assert sorted(tuple(r) for r in O.top_per_group(df, ["g"], ["i"]).collect()) == [("p", "a", 3), ("q", "z", 1)]


def test_peer_scores(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a", day, 1, 0, 0), ("a", day, 3, 0, 0), ("a", day, 8, 0, 0), ("b", day, 4, 0, 0), (None, day, 9, 0, 0)]
    df = spark.createDataFrame(rows, "department string, feature_date date, usb_connects int, ext_emails int, after_hours_events int")
    got = {(r["department"], r["usb_connects"]): r for r in I.peer_scores(df).collect()}
    spread = statistics.stdev([1, 3, 8])
    assert got[("a", 8)]["usb_zscore_peer"] == pytest.approx((8 - 4) / spread)
    assert got[("a", 8)]["ext_emails_zscore_peer"] == 0.0
    assert got[("b", 4)]["usb_zscore_peer"] == 0.0 and got[(None, 9)]["usb_zscore_peer"] == 0.0


def test_new_keys_leave_old_rows_alone(spark):
    existing = spark.createDataFrame([(5, "a"), (9, "b")], "sk bigint, name string")
    candidates = spark.createDataFrame([("a",), ("c",), ("d",)], "name string")
    rows = {r["name"]: r["sk"] for r in D.upsert(existing, candidates, "sk", ["name"]).collect()}
    assert rows["a"] == 5 and rows["b"] == 9 and {rows["c"], rows["d"]} == {10, 11}
    again = {r["name"]: r["sk"] for r in D.upsert(existing, candidates.repartition(3), "sk", ["name"]).collect()}
    assert rows == again


def test_cross_tab_margins(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "r string, c string")
    got = {row["r"]: (row["x"], row["y"], row["Total"]) for row in G.cross_tab(df, "r", "c", ["x", "y"]).collect()}
    assert got == {"a": (1, 1, 2), "b": (1, 0, 1), "Total": (2, 1, 3)}


def test_calendar_and_clock(spark):
    dates = D.dim_date(spark)
    assert dates.count() == 2922
    row = dates.filter("date_sk = 20170705").first()
    assert (row["day_name"], row["day_of_week"], row["week_of_year"], row["is_weekend"]) == ("Wednesday", 3, 27, 0)
    clock = D.dim_time(spark)
    assert clock.count() == 1440
    parts = {r["day_part"]: r["n"] for r in clock.groupBy("day_part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"late_night": 300, "early_morning": 180, "morning": 240, "afternoon": 300, "evening": 180, "night": 240}


def test_geo_join_cuts_ranges_of_both_families(spark):
    from ipaddress import ip_address

    from threatlake.operators import joins

    nets = [("A", "2001:0::5", "2001:1:2::"), ("B", "2001:1:3::", "2001:1:3:ffff:ffff:ffff:ffff:ffff"), ("C", "8000::", "ffff::"), ("D", "::7", "::7")]
    rows = [(n, None, None, a, b) for n, a, b in nets] + [("E", 16, 31, None, None)]
    ranges = spark.createDataFrame(rows, "country_iso string, ip_from long, ip_to long, ip6_from string, ip6_to string")
    points = [str(ip_address(int(ip_address(x)) + d)) for _, *ends in nets for x in ends for d in (-1, 0, 1)] + ["0.0.0.16", "0.0.0.32", "no", None, "2001:1::9", "::6"]
    got = {r.ip: r.country_iso for r in joins.geo_join(spark.createDataFrame([(p,) for p in points], "ip string"), ranges).collect()}

    def want(p):
        if p == "0.0.0.16":
            return "E"
        inside = [n for n, a, b in nets if p and ":" in p and ip_address(a) <= ip_address(p) <= ip_address(b)]
        return inside[0] if inside else None

    assert got == {p: want(p) for p in points} and len(got) == len(set(points))
