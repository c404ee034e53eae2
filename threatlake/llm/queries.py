"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.llm import bpe, cosine, counts, curves, identifiers, infill, maxent, mixing, quality, simhash, toxicity, urls, whitening
from threatlake.llm.text import remainder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = quality.fit(docs, _table(spark, folder, "labels"))
    rows = docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "text")
    return quality.score(rows, model, ["doc_id", "held_out"])


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return cosine.similar_vectors(_table(spark, folder, "embeddings"))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


def op5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return curves.nearest(_table(spark, folder, "embeddings"))


def op6_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(docs, _table(spark, folder, "labels"))
    rows = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "text")
    return toxicity.score(rows, model, ["doc_id", "held_out"])


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.token_counts(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return maxent.score(_table(spark, folder, "documents"))


def op11_infill(spark: SparkSession, folder: str) -> DataFrame:
    made = infill.fill_in_middle(_table(spark, folder, "documents"))
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op13_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    found = identifiers.personal_data(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_found")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_simhash, op3_embedding_dedup, op4_bpe, op5_nearest, op6_urls, op7_toxicity, op8_token_counts, op9_mixing,
                            op10_language_model, op11_infill, op12_whitening, op13_identifiers)}
SQL: dict[str, str] = {"op9_mixing": mixing.SQL, "op11_infill": infill.SQL}
