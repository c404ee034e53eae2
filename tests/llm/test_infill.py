"""Fill-in-middle against a plain loop, the rank index against the boundaries themselves."""

import hashlib
import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from threatlake.llm import infill, queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text, h = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text, text
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", text
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\t\n\x0b😀 ", max_size=60))
def test_boundaries_are_the_tokens_ends(text):
    assert infill.boundaries(text).tolist() == [0, *(m.end() for m in TOKEN.finditer(text))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=300), st.integers(1, 120))
def test_index_is_exact_and_within_its_bound(steps, bound):
    offsets = np.concatenate(([0], np.cumsum(np.array(steps, np.int64))))
    index = infill.RankIndex.fit(offsets, bound)
    ranks = np.arange(len(offsets))
    assert np.array_equal(index.at(ranks), offsets) and np.abs(index.residuals).max() <= bound + 1
    assert index.tokens == len(steps)


def test_long_even_texts_need_few_pieces():
    offsets = np.cumsum(np.random.default_rng(1).integers(2, 9, 200_000))
    index = infill.RankIndex.fit(offsets)
    assert np.array_equal(index.at(np.arange(200_000)), offsets) and len(index.ranks) < 1_000


def test_rows_equal_a_loop(documents):
    rows = [r for r in ODD] + [(i, " a  bé\n" * (i % 9) + "😀 end" * (i % 4), "s") for i in range(10, 200)] + [(300 + i, f"one {m} two three", "s") for i, m in
                                                                                                              enumerate(infill.MARKS * 5)]
    made = infill.fill_in_middle(documents(rows), keep=["doc_id", "text", "n", "source"])
    assert made.columns == ["doc_id", "text", "source", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) == plain(r.doc_id, r.text)


def test_stored_index_gives_the_cuts(documents):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two  three ", "a")]
    got = {r.doc_id: r for r in infill.rank_indexes(documents(rows)).collect()}
    assert got[1].n == got[2].n == 0 and got[3].n == 4 and len(got[3].residuals) == 5 and got[3].pieces[0].rank == 0


def test_empty_table(documents):
    assert infill.fill_in_middle(documents(ODD).where("false")).collect() == []


def test_query_equals_sql(spark, sf_dir):
    got = queries.op11_infill(spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({infill.SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
