"""Base matches against the plain patterns, bootstrapping against a plain loop over the same rules and on planted contexts."""

import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from threatlake.llm import identifiers as I
from threatlake.llm import queries

PLAIN = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def fits(kind, match):
    number = re.sub("[^0-9]", "", match)
    if kind == 1:
        return all(int(x) <= 255 for x in match.split("."))
    if kind == 2:
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(number)))
        return 13 <= len(number) <= 19 and total % 10 == 0
    return kind == 0 or 9 <= len(number) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PLAIN) for m in p.finditer(text or "") if fits(k, m.group())]


def said(places):
    return ",".join(f"{I.KINDS[k]}:{a}:{b}" for k, a, b in places)


HARD = [
    "a@b.c_d@e.f x.y@z", "a@a@a.b@c.d-e.f", "1.2.3.4.5.6.7.8 256.1.1.1 010.000.0255.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111  11111111", "+1 (603) 555-8791. +49 30 1 +1",
    "é😀 a@b.cc 4397865138547350 +1 (918) 555-2370x 81.190.225.143.", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "1" * 5000, "9-" * 3000, "a" * 5_000, "@" * 3000, "a.b@" * 2000, "+1" + " " * 5000,
    "-" * 20_000 + "7", "x@y." * 500 + "z 0000000000000 00000000000000000000",
]


def test_base_equals_the_plain_patterns(documents):
    rows = [*ODD, *[(100 + i, t, "s") for i, t in enumerate(HARD)]]
    got = I.personal_data(documents(rows)).collect()
    assert len(got) == len(rows)
    want = sorted((d is not None, d or 0, said(base(t)), *[sum(k == n for k, *_ in base(t)) for n in range(4)]) for d, t, _ in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.base_spans, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    for r in got:
        assert set(r.base_spans.split(",")) <= set(r.spans.split(","))


def context_rows():
    """Mails after "write to", phones after "call me at": unseen ones stand in the same places; some numbers stand anywhere."""
    rows = [(i, f"Please write to user{i}@host{i % 7}.example.com today about item {i * 37 % 1000}.", "s") for i in range(40)]
    rows += [(100 + i, f"Then call me at +1 ({200 + i}) 555-{1000 + i} before noon. Total of {5000 + i} in {2000 + i}.", "s") for i in range(40)]
    rows += [(200, "Please write to unseen77@localhost today!", "s"), (201, "So call me at 555 0199 before we go.", "s"), (202, "Total of 7777 in 2099 seen by user 1234x.", "s"),
             (203, "again unseen77@localhost, elsewhere", "s"), (204, "call me at +1 22 before noon", "s")]
    return rows


def test_contexts_find_unseen_identifiers(documents):
    got = {r.doc_id: r for r in I.personal_data(documents(context_rows())).collect()}
    text = {d: t for d, t, _ in context_rows()}
    found = {d: [(x.split(":")[0], text[d][int(x.split(":")[1]) : int(x.split(":")[2])]) for x in r.spans.split(",")] for d, r in got.items() if r.n_found}
    assert found == {200: [("email", "unseen77@localhost")], 201: [("phone", "555 0199")], 203: [("email", "unseen77@localhost")]}
    assert all(r.n_email == 1 and r.n_found == 0 for d, r in got.items() if d < 100) and all(r.n_phone == 1 for d, r in got.items() if 100 <= d < 200)


def plain_found(edges, rounds):
    """{instance: kind} by a loop; edges: {(side, words): {instance: seed kind or None}}."""
    found = {}
    for _ in range(rounds):
        sure = {}
        for p, instances in edges.items():
            for k in range(4):
                total = sum(1.0 if s == k else found[i][1] if s is None and i in found and found[i][0] == k else 0.0 for i, s in instances.items())
                if total >= I.SUPPORT and total >= I.PATTERN_LEAST * (len(instances) + 1):
                    sure[p, k] = total / (len(instances) + 1)
        best = {}
        for (p, k), c in sure.items():
            for i, s in edges[p].items():
                if s is None:
                    best[i, k, p[0]] = max(best.get((i, k, p[0]), 0.0), c)
        found = {}
        for i, k in sorted({(i, k) for i, k, _ in best}):
            score = 1 - (1 - best.get((i, k, "l"), 0.0)) * (1 - best.get((i, k, "r"), 0.0))
            if score >= I.FOUND_LEAST and (i not in found or score > found[i][1]):
                found[i] = (k, score)
    return {i: k for i, (k, _) in found.items()}


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_graph_scores_equal_a_loop(spark, rounds):
    import random

    rng = random.Random(rounds)
    edges = {}
    for p in range(60):
        leaning = rng.choice([0, 1, 2, 3, None])
        for _ in range(rng.randint(20, 120)):
            i = rng.randrange(300)
            seed = i % 5 if i % 5 < 4 and i < 260 else None
            if leaning is None or seed is None and rng.random() < 0.1 or seed == leaning:
                edges.setdefault((rng.choice("lr") if p % 9 == 0 else "lr"[p % 2], f"1 w{p}"), {})[f"i{i}x"] = seed
    rows = [(s, w, i, k) for (s, w), x in edges.items() for i, k in x.items()]
    graph = spark.createDataFrame(rows, "side string, words string, instance string, seed int")
    got = {r.instance: r.kind for r in I._scored(graph, rounds).collect()}
    assert got == plain_found(edges, rounds) and got


def test_empty_table_and_digest(spark, documents, sf_dir):
    assert I.personal_data(documents(ODD).where("false")).collect() == []
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    import hashlib

    got = queries.op13_identifiers(spark, sf_dir).collect()
    assert {r.doc_id: r.base_sha256 for r in got} == {d: hashlib.sha256(said(base(t)).encode()).hexdigest() for d, t in docs.items()}


def test_no_python_in_the_plan(documents):
    found = I.personal_data(documents(ODD))
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and F is not None
