"""The registered queries of this folder: each operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sievemark.llm import crf, curves, huffman, licenses, mixing, packing, pstable, quality, ranking, simhash, surrogates, warc, whitening


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return quality.clean_lines(docs, keep=["doc_id"]).drop("clean_text")


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(_table(spark, folder, "pages")).drop("url", "payload", "intact")


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op4_crf_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = crf.fit(docs.where(~crf.held_out()))
    marked = docs.select("doc_id", "text", crf.held_out().alias("held_out"))
    return crf.identify(marked, model, keep=["doc_id", "held_out"])


def op5_hilbert_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return curves.search(_table(spark, folder, "embeddings"))


def op6_huffman_ids(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return huffman.round_trip(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_source_mixture(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.mix(_table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(_table(spark, folder, "documents"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])


def op10_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    made = surrogates.pseudonymised(_table(spark, folder, "documents").select("doc_id", "text"))
    counts = [F.expr(f"size(filter(entities, e -> e.kind = '{k}'))").alias(f"n_{k}") for k in surrogates.KINDS]
    return made.select("doc_id", "text", *counts)


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_pstable_copies(spark: SparkSession, folder: str) -> DataFrame:
    return pstable.near_copies(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_crf_language": op4_crf_language,
    "op5_hilbert_neighbours": op5_hilbert_neighbours,
    "op6_huffman_ids": op6_huffman_ids,
    "op7_source_mixture": op7_source_mixture,
    "op8_simhash": op8_simhash,
    "op9_license_scan": op9_license_scan,
    "op10_surrogates": op10_surrogates,
    "op11_whitening": op11_whitening,
    "op12_ranked_search": op12_ranked_search,
    "op13_pstable_copies": op13_pstable_copies,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.oracle(),
    "op2_warc": warc.oracle(),
    "op7_source_mixture": mixing.oracle(),
    "op12_ranked_search": ranking.oracle(),
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
