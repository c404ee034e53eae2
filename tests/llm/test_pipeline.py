"""The pipeline: stages alone on their own input, and all of them on whole tables."""

import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_mixing import plain_mix
from tests.llm.test_shingles import plain_groups
from threatlake.llm import queries


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        rows = got.collect()
        out.append((name, docs.collect(), got.columns, rows))
        docs = spark.createDataFrame(rows, got.schema)
    return {name: rest for name, *rest in out}


def test_filters_keep_good_documents(spark, sf_dir):
    """On a folder with some hundred labels: the smallest one has a dozen toxic texts, too few to learn from. Some toxic labels
    have no trace in their text, so not all can be caught."""
    folder = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (_, stage), good in zip(corpus_pipeline.STAGES[:2], (lambda r: r.toxic == 0, lambda r: r.quality == 1), strict=True):
        out = stage(spark, docs, folder)
        before, after = docs.collect(), out.collect()
        assert out.columns == corpus_pipeline.COLUMNS and {tuple(r) for r in after} <= {tuple(r) for r in before}
        kept = {r.doc_id for r in after}
        fine = [r.doc_id for r in before if r.doc_id in labels and good(labels[r.doc_id])]
        bad = [r.doc_id for r in before if r.doc_id in labels and not good(labels[r.doc_id])]
        assert sum(i in kept for i in fine) >= 0.95 * len(fine) and sum(i in kept for i in bad) <= 0.5 * len(bad)


def test_one_document_of_each_group(steps):
    before, columns, after = steps["near_duplicates"]
    root = plain_groups([r.text for r in before])
    first = {}
    for r, g in zip(before, root, strict=True):
        first[g] = min(first.get(g, r.doc_id), r.doc_id)
    assert columns == corpus_pipeline.COLUMNS and sorted(r.doc_id for r in after) == sorted(first.values())


def test_mix_takes_effect(steps):
    before, columns, after = steps["mixing"]
    _, taken = plain_mix([(r.doc_id, r.text, r.source) for r in before])
    counted = {}
    for r in after:
        counted[r.doc_id] = counted.get(r.doc_id, 0) + len(r.text.encode().split())
    assert columns == corpus_pipeline.COLUMNS and counted == {d: n for d, _, _, n in taken if n}


def test_token_ids(steps):
    before, _, after = steps["bpe"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, t.encode(r.text, add_special_tokens=False).ids) for r in before)
    assert sorted((r.doc_id, list(r.ids)) for r in after) == want


def test_run_equals_the_stages(spark, sf_dir, steps):
    rows = corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, rows)) == sorted((r.doc_id, r.n_tokens) for r in steps["bpe"][2])


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Null and empty texts, null and repeated ids, a very long text, a column of a clashing name: all stages end, with rows of the first table."""
    texts = [None, "", "  \t", "word " * 30_000, "one two three", "one two three"]
    rows = [(i % 5 if i % 7 else None, texts[i % 6] if i % 2 else f"{i} some words of text {i * i} and more of them {i}", "en", None if i % 3 else "a", 5, 0.5) for i in range(60)]
    docs = "doc_id long, text string, lang string, source string, n_chars int, score double"
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(rows, docs).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {0, 1, 2, 3, 4, None}


def test_empty_tables_pass_all_stages(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered_names():
    assert list(queries.QUERIES) == ["op1_quality", "op2_simhash", "op3_embedding_dedup", "op4_bpe", "op5_nearest", "op6_urls", "op7_toxicity",
                                     "op8_token_counts", "op9_mixing", "op10_language_model", "op11_infill", "op12_whitening", "op13_identifiers"]
    assert set(queries.SQL) <= set(queries.QUERIES) and len(corpus_pipeline.STAGES) == 5
