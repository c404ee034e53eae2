"""URL verdicts against plain Python versions of the rules and of the Markov models."""

import math
import random
import re

from pyspark.sql import functions as F

from threatlake.llm import urls

URLS = [None, "", "no scheme", "http://", "https://Example.COM/en/1", "https://www.example.com/en/1?x=/y", "http://a.b.example.com/EN/", "http://notexample.com/en/",
        "http://com/", "http://xcom/", "ftp://x.net/es/1#top", "http://net/fr/", "http://net/fr", "http://x.net?/es/", "http://x.net#a", "a://b://c.com/d",
        "http://host.com", "http://h.org/\npath with\ttabs?q", "http://ünï.com/é/" + "x" * 3000]


def plain(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best or ""):
            best = rule
    return host, path, best


def make(spark, extra=()):
    rows = [(i, u, "h", "a", "p") for i, u in enumerate(URLS)] + [(50 + i, u, "h", "a", "p") for i, u in enumerate(extra)]
    return spark.createDataFrame(rows, "page_id bigint, url string, host string, path string, verdict string")


def test_hosts_paths_and_rules(spark):
    got = {r.page_id: r for r in urls.judge(make(spark)).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        r = got[i]
        assert (r.host, r.path, r.rule) == plain(u), u
        assert r.verdict == urls.RULES[r.rule] if r.rule else r.verdict in ("allow", "block")


def plain_ratio(examples, url, longest=4, smooth=2.0):
    return plain_ratios(examples, [url], longest, smooth)[url]


def plain_ratios(examples, asked, longest=4, smooth=2.0):
    mark = lambda u: "\x02" + u.lower() + "\x03"
    grams, contexts = {}, {}
    for u, verdict in examples:
        m = mark(u)
        for i in range(1, len(m)):
            for k in range(longest):
                g, c = (k, m[max(i - k, 0) : i + 1]), (k, m[max(i - k, 0) : i])
                grams[g, verdict] = grams.get((g, verdict), 0) + 1
                contexts[c, verdict] = contexts.get((c, verdict), 0) + 1
    out = {}
    for url in asked:
        m, total = mark(url), 0.0
        for i in range(1, len(m)):
            p = {"allow": 1 / 256, "block": 1 / 256}
            for k in range(longest):
                for v in p:
                    p[v] = (grams.get(((k, m[max(i - k, 0) : i + 1]), v), 0) + smooth * p[v]) / (contexts.get(((k, m[max(i - k, 0) : i]), v), 0) + smooth)
            total += math.log(p["allow"] / p["block"])
        out[url] = total / (len(m) - 1) if url else 0.0
    return out


def test_ratio_equals_plain_markov_models(spark):
    examples = [(f"http://good{i}.site.com/read/{i}", "allow") for i in range(30)] + [(f"http://spam{i}.bad.net/es/win{i}", "block") for i in range(25)]
    asked = ["", "http://good5.org/read", "http://spam.bad.org/win", "x", "http://good0.site.com/read/0"]
    table = urls.count_table(spark.createDataFrame(examples, "url string, verdict string"))
    frame = spark.createDataFrame([(u,) for u in asked + asked], "url string")
    got = {r.url: r.ratio for r in urls.log_ratios(frame, table).collect()}
    assert len(got) == len(asked)
    for u in asked:
        assert abs(got[u] - plain_ratio(examples, u)) < 1e-9, u
    assert got["http://good5.org/read"] > 0 > got["http://spam.bad.org/win"]


def test_counts_keep_every_gram_apart(spark):
    """Far more different grams than any fixed table of 65,536 cells holds without sharing, by the query's own settings."""
    rng = random.Random(3)
    examples = [("http://" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789-", k=40)) + (".com/" if i % 2 else ".net/fr/"), "allow" if i % 2 else "block")
                for i in range(2500)]
    table = urls.count_table(spark.createDataFrame(examples, "url string, verdict string"))
    assert table.count() > 100_000 and table.where("key = ''").first().allow == sum(len(u) + 1 for u, v in examples if v == "allow")
    asked = [u for u, _ in examples[:20]] + ["http://" + "".join(rng.choices("abcxyz0189", k=30)) for _ in range(20)]
    got = {r.url: r.ratio for r in urls.log_ratios(spark.createDataFrame([(u,) for u in asked], "url string"), table).collect()}
    want = plain_ratios(examples, asked)
    assert all(abs(got[u] - want[u]) < 1e-9 for u in asked)


def test_urls_without_a_rule_follow_the_examples(spark):
    extra = [f"https://news{i}.pages.com/article/{i}" for i in range(60)] + [f"https://win{i}.casino.net/fr/bet{i}" for i in range(60)]
    extra += ["https://news5.pages.org/article/77", "https://win8.casino.org/bet12", "https://win8.casino.org/bet12"]
    got = urls.judge(make(spark, extra)).where("page_id >= 170").orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["allow", "block", "block"] and got[0].ratio > got[0].threshold


def test_empty_table_and_one_kind_of_example(spark):
    assert urls.judge(make(spark).where("false")).count() == 0
    only = urls.judge(make(spark).where(F.col("url").isNull() | F.col("url").contains("org"))).collect()
    assert {r.threshold for r in only} == {0.0}


def test_main_path_is_native(spark):
    plan = urls.judge(make(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Nested" not in plan
