"""Source mix against its SQL twin and against a plain loop."""

import hashlib

import duckdb
import pytest

from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from threatlake.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, passes=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > passes * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = passes * sizes[s]
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return target


def plain_mix(rows):
    docs = [(d, s, len((t or "").encode().split()), t or "") for d, t, s in rows]
    sizes = {}
    for _, s, n, _ in docs:
        sizes[s] = sizes.get(s, 0) + n
    target = plain_targets(sizes)
    place = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    key = lambda d: (hashlib.md5((str("" if d[0] is None else d[0]) + ":" + d[3]).encode()).hexdigest(), -1 if d[0] is None else d[0], d[2])
    entries = []
    for s in sizes:
        mine = [d for d in docs if d[1] == s]
        for d in mine:
            run = sum(x[2] for x in mine if key(x) <= key(d))
            for k in (0, 1):
                finish = (run + k * sizes[s]) / target[s] if target[s] > 0 else 0.0
                entries.append(((finish, place[s], key(d)[0], "" if d[0] is None else str(d[0]), d[2]), d))
    budget, taken = sum(target.values()), {}
    for order, d in entries:
        taken.setdefault(d, 0)
        if sum(e[1][2] for e in entries if e[0] <= order) <= budget:
            taken[d] += d[2] / sum(x == d for x in docs)
    return target, [(d[0], d[1], d[2], taken[d]) for d in docs]


def test_mix_equals_loop(documents):
    rows = [(i, "w " * (i * 7 % 13), f"s{i * i % 5}") for i in range(60)] + [(100, "w " * 400, "s1"), (101, "x y", None)] + [r for r in ODD if r[0] != 4]
    got = mixing.mix(documents(rows)).collect()
    target, taken = plain_mix(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.source, r.size, r.taken) for r in got), key=order) == sorted(taken, key=order)


def test_rows_without_an_id_or_with_one_id_lie_apart(spark):
    docs = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"),
                                    F.concat(F.lit("w "), F.col("id")).alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    keys = docs.select(*mixing._keys("doc_id", "text", "source")).withColumn("part", F.substring("hash", 1, 1))
    for some in ("doc_id IS NULL", "doc_id = 7"):
        counts = [r["count"] for r in keys.where(some).groupBy("part").count().collect()]
        assert len(counts) == 16 and max(counts) < 250
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("goal")).collect()
    assert all(abs(r.n - r.goal) <= 4 for r in got)


def test_a_much_repeated_row_is_one_entry(documents):
    rows = [(None, "a b c", "x")] * 500 + [(i, "w " * (i % 5 + 1), "x" if i % 2 else "y") for i in range(300)]
    docs = documents(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == 800 and len({r.taken for r in got if r.doc_id is None}) == 1
    target, taken = plain_mix(rows)
    assert sum(r.taken for r in got) == pytest.approx(sum(t[3] for t in taken))
    assert mixing.mixed_rows(docs).count() == sum(r.copies for r in got)


def test_mix_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == sorted(con.execute(mixing.SQL).fetchall())


def test_rows_of_the_mix(documents):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 3}") for i in range(90)] + [(7, "w " * 8, "s1"), (None, "a b c", None)]
    docs = documents(rows)
    plan = {}
    for r in mixing.mix(docs).collect():  # the repeated row is there twice
        plan[(r.doc_id, r.source, r.size)] = plan.get((r.doc_id, r.source, r.size), 0) + r.copies
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    counted = {}
    for r in mixed.collect():
        k = (r.doc_id, r.source, len(r.text.split()))
        counted[k] = counted.get(k, 0) + 1
    assert counted == {k: v for k, v in plan.items() if v}


def test_empty_and_wordless_tables(documents):
    assert mixing.mix(documents([]).where("false")).count() == 0
    assert [r.taken for r in mixing.mix(documents([(1, "", "a"), (2, None, None)])).collect()] == [0, 0]
