"""Queries of the thirteen operators over the driver's tables, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursewise.llm import (ann_crosspolytope, html_text, license_scan, line_quality, minmax_dedup, piece_codec,
                           shard_lookup, source_mix, spelling_variants, suffix_dedup, token_counts, toxicity_chain,
                           word_runs)
from pursewise.llm.common import table

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> bytes:
    """Content of a public tokenizer's file, read on the driver and sent to the executors."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_crosspolytope.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_lookup.shard_documents(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE).decode())


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mixed_sizes(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_chain.scores(docs, toxicity_chain.fit(docs, table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality(table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.encoded(docs, vocabulary(PIECE_BPE))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.run_digests(word_runs.periodic_runs(word_runs.with_periods(table(spark, sf_dir, "documents"))))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.kept_digests(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.slipped_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_nearest, op2_shards, op3_main_text, op4_near_duplicates, op5_token_counts,
                            op6_licenses, op7_mix, op8_toxicity, op9_quality, op10_pieces, op11_word_runs,
                            op12_substrings, op13_spelling)}

ORACLES: dict[str, str] = {
    "op4_near_duplicates": minmax_dedup.ORACLE,
    "op6_licenses": license_scan.ORACLE,
    "op7_mix": source_mix.ORACLE,
    "op9_quality": line_quality.ORACLE,
    "op12_substrings": suffix_dedup.ORACLE,
}
