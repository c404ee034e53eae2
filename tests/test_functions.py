"""Hand-made edge rows for the column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from threatlake.functions import activity as A
from threatlake.functions import labels as L
from threatlake.functions import network as N
from threatlake.functions import numbers as NUM
from threatlake.functions import scores as S
from threatlake.functions import times as T


def one(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_labels(spark):
    raw = [None, "", "  ", "BENIGN", "Web Attack \x96 XSS", "DDoS", "DoS Hulk", "Bot", "SSH-Patator", " PortScan ", "Strange"]
    assert one(spark, raw, "string", L.label_clean) == [
        "Unlabeled", "Unlabeled", "Unlabeled", "BENIGN", "Web Attack - XSS", "DDoS", "DoS Hulk", "Bot", "SSH-Patator", "PortScan", "Strange"]
    assert one(spark, raw, "string", L.attack_family) == [
        "Unlabeled", "Unlabeled", "Unlabeled", "Benign", "Web Attack", "DDoS", "DoS", "Botnet", "Brute Force", "Reconnaissance", "Other"]
    assert one(spark, raw, "string", L.is_attack) == [None, None, None, 0, 1, 1, 1, 1, 1, 1, 1]


def test_casts(spark):
    raw = ["12", "12.7", "2.5", "3.5", "4093762.0", "Infinity", "NaN", "-inf", "x", "", None, "1e3"]
    assert one(spark, raw, "string", NUM.to_integer) == [12, 13, 2, 4, 4093762, None, None, None, None, None, None, 1000]
    assert one(spark, raw, "string", NUM.to_double) == [
        12.0, 12.7, 2.5, 3.5, 4093762.0, None, None, None, None, None, None, 1000.0]
    assert one(spark, [1.5, float("inf"), float("-inf"), float("nan"), None], "double", NUM.finite_or_zero) == [1.5, 0, 0, 0, 0]


def test_percent_half_up(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (2, 3), (1, 800), (0, 0), (5, 5)], "a bigint, b bigint")
    got = [r[0] for r in df.select(NUM.percent(F.col("a"), F.col("b"), 1)).collect()]
    assert got == [12.5, 33.3, 66.7, 0.1, None, 100.0]


def test_flow_time(spark):
    rows = [
        ("03/07/2017 11:47:00", "Monday"), ("03/07/2017 01:05:09", "Monday"), ("7/7/2017 3:30", "Friday"), ("7/7/2017 12:59", "Friday"),
        ("7/7/2017 9:00", "Friday"), ("", "Friday"), (None, "Monday"), ("garbage", "Friday"), ("  7/7/2017 5:01 ", "Friday"), ("7/7/2017 6:00", "Friday")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, d string").orderBy("i")
    got = [r[0] for r in df.select(T.parse_flow_time(F.col("t"), F.col("d"))).collect()]
    day = dt.datetime(2017, 7, 7)
    assert got == [
        dt.datetime(2017, 7, 3, 11, 47), dt.datetime(2017, 7, 3, 13, 5, 9), day.replace(hour=15, minute=30), day.replace(hour=12, minute=59),
        day.replace(hour=9), None, None, None, day.replace(hour=17, minute=1), day.replace(hour=6)]


def test_time_keys(spark):
    ts = [dt.datetime(2017, 7, 3, 6, 59), dt.datetime(2017, 7, 8, 7, 0), dt.datetime(2017, 7, 9, 19, 0), None]
    assert one(spark, ts, "timestamp_ntz", T.date_key) == [20170703, 20170708, 20170709, None]
    assert one(spark, ts, "timestamp_ntz", T.time_key) == [419, 420, 1140, None]
    assert one(spark, ts, "timestamp_ntz", T.outside_hours) == [1, 0, 1, None]
    assert one(spark, ts, "timestamp_ntz", T.weekend) == [0, 1, 1, None]
    assert one(spark, ts, "timestamp_ntz", T.sunday_zero) == [1, 6, 0, None]
    assert one(spark, ts, "timestamp_ntz", T.monday_zero) == [0, 5, 6, None]


def test_ipv4_classes(spark):
    cases = {
        "192.168.10.50": "internal", "10.0.0.1": "internal", "172.15.0.1": "external", "172.16.0.1": "internal", "172.31.255.255": "internal",
        "172.32.0.1": "external", "127.0.0.1": "internal", "169.254.1.1": "internal", "0.1.2.3": "internal", "192.0.0.8": "internal",
        "192.0.0.9": "external", "192.0.0.10": "external", "192.0.0.100": "internal", "192.0.2.1": "internal", "198.18.0.1": "internal",
        "198.20.0.1": "external", "198.51.100.7": "internal", "203.0.113.9": "internal", "100.64.0.1": "external", "224.0.0.1": "special",
        "239.255.255.250": "special", "240.0.0.1": "internal", "255.255.255.255": "internal", "8.8.8.8": "external", "256.1.1.1": "invalid",
        "1.2.3": "invalid", "01.2.3.4": "invalid", "1.2.3.4 ": "invalid", "": "invalid", "::1": "invalid"}
    assert one(spark, list(cases), "string", N.ipv4_class) == list(cases.values())
    assert one(spark, [None, "0.0.1.0", "255.255.255.255", "x"], "string", N.ipv4_number) == [None, 256, 4294967295, None]


def test_ipv4_classes_agree_with_standard_library(spark):
    import ipaddress
    import random

    rng = random.Random(3)
    texts = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(2000)]
    texts += [f"{a}.{b}.{c}.{d}" for a in (0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240) for b in (0, 16, 18, 64, 168, 254) for c in (0, 2, 100, 113) for d in (0, 9, 10)]

    def expected(text):
        ip = ipaddress.ip_address(text)
        if ip.is_private:
            return "internal"
        return "special" if ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved else "external"

    assert one(spark, texts, "string", N.ipv4_class) == [expected(t) for t in texts]


def test_ipv6_classes_and_digits(spark):
    """Against the standard library: each network's ends and their neighbours, written short, long and with a dotted tail, and odd texts."""
    import ipaddress

    ends = [int(e) for n, _ in N.V6_NETWORKS for net in [ipaddress.IPv6Network(n)] for e in (net.network_address, net.broadcast_address)]
    ends += [0xFFFF_0000_0000 + int(ipaddress.ip_address(a)) for a in ("8.8.8.8", "10.0.0.1", "224.0.0.1", "255.255.255.255", "169.254.1.1")]
    whole = [ipaddress.IPv6Address(min(max(e + d, 0), (1 << 128) - 1)) for e in ends for d in (-1, 0, 1)]
    texts = [f(a) for a in whole for f in (str, lambda a: a.exploded.upper(), lambda a: ":".join(f"{int(a) >> 16 * i & 0xFFFF:x}" for i in range(7, -1, -1)))]
    texts += [":".join(f"{int(a) >> 16 * i & 0xFFFF:x}" for i in range(7, 1, -1)) + f":{ipaddress.IPv4Address(int(a) & 0xFFFFFFFF)}" for a in whole]
    odd = ["::", ":", ":::", "1::2::3", "::1%eth0", "::1%", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "12345::", "g::",
           "1::1.2.3.256", "1::1.2.3", "1.2.3.4::", "::1.2.3.4:5", ":1:2:3:4:5:6:7:8", " ::1", "1:2:3:4:5:6:7:1.2.3.4", "zz::1", "::01.2.3.4"]

    def expected(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return "invalid", None
        inside = ip.ipv4_mapped or ip
        named = "internal" if ip.is_private else "special" if inside.is_loopback or inside.is_link_local or inside.is_multicast or inside.is_reserved else "external"
        return named, f"{int(ip):032x}"

    assert one(spark, texts + odd, "string", N.address_class) == [expected(t)[0] for t in texts + odd]
    assert one(spark, texts + odd, "string", N.ipv6_digits) == [expected(t)[1] for t in texts + odd]
    assert one(spark, ["8.8.8.8", None, "x"], "string", N.address_class) == ["external", "invalid", "invalid"]


def test_ports(spark):
    raw = ["80", "65535", "65536", "-1", "n/a", None, "443.0"]
    assert one(spark, raw, "string", N.port_number) == [80, 65535, None, None, None, None, 443]
    assert one(spark, ["6", "", None, "70000"], "string", N.protocol_number) == [6, None, None, None]


def test_mail(spark):
    raw = [None, "", "a@dtaa.com", "a@dtaa.com;b@x.org", "A@DTAA.COM; ", "; ;", "b@x.org"]
    assert one(spark, raw, "string", A.recipient_count) == [0, 0, 1, 2, 2, 3, 1]
    assert one(spark, raw, "string", A.to_external) == [0, 0, 0, 1, 0, 0, 1]
    assert one(spark, [None, "a@DTAA.com", "x@y.z"], "string", A.from_external) == [0, 0, 1]
    assert one(spark, raw[:4] + ["b@x.org"], "string", A.destination_pattern) == [
        "No recipient", "External only", "Internal only (single)", "Mixed internal/external", "External only"]
    assert one(spark, ["a.DOC", "b", "c.tar.gz", None, "d."], "string", A.file_extension) == ["doc", None, "gz", None, None]
    assert one(spark, ["Connect", "Disconnect", "Other", None], "string", A.device_activity) == ["USB_Connect", "USB_Disconnect", None, None]


def test_personal_ratio(spark):
    df = spark.createDataFrame([(3, 1.5), (3, 0.0), (3, None), (100, 1.0)], "t int, b double")
    assert [r[0] for r in df.select(A.ratio(F.col("t"), F.col("b"))).collect()] == [2.0, 30.0, 30.0, 50.0]
    assert [r[0] for r in df.select(A.deviation(F.col("t"), F.col("b"))).collect()] == [1.5, 3.0, 3.0, 99.0]


def test_scores(spark):
    assert one(spark, [0.75, 0.7499, 0.55, 0.35, 0.15, 0.1, 0.0, -1.0], "double", S.priority_label) == [
        "critical", "high", "high", "medium", "low", "info", "info", "info"]
    assert one(spark, [0.5, 0.315, 0.3149, 0.1, 0.05], "double", S.risk_label) == ["high", "elevated", "low", "low", "baseline"]
    assert one(spark, ["DDoS", "Web Attack", "Nothing", None], "string", lambda c: S.severity_weight(S.family_severity(c))) == [1.0, 0.4, 0.0, 0.0]
    df = spark.createDataFrame([(0.99, 0.97, 1.0, 1.0), (0.5, 0.2, 0.5, 0.4)], "a double, b double, c double, w double")
    cols = [F.col(c) for c in "abcw"]
    plain = [r[0] for r in df.select(S.priority_score(*cols)).collect()]
    bonus = [r[0] for r in df.select(S.priority_score(*cols, certainty_bonus=True)).collect()]
    heavy = [r[0] for r in df.select(S.priority_score(*cols, weights={"supervised": 1.0})).collect()]
    assert [round(x, 6) for x in plain] == [0.9935, 0.48] and bonus[0] == 1.0 and bonus[1] == plain[1] and heavy[0] == 1.0


def test_buckets(spark):
    assert one(spark, [0, 9, 10, 39, 40], "int", A.tens_bucket) == ["00-09", "00-09", "10-19", "30-39", "40+"]
    assert one(spark, [9999, 10000, 10**7], "bigint", A.size_bucket) == ["< 10 KB", "10-100 KB", "> 10 MB"]
