"""Corpus pipeline: toxicity, quality rules, near-duplicates, source mix, SentencePiece ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its rows are written as Parquet to
the shared checkpoint folder and read again as the next stage's ``docs``. All stages but the
last return the columns of ``docs``. Every stage works on all rows its predecessor kept:

1. toxicity: documents that the classifier chain rejects go (trained on ``labels``, at most
   ``toxicity_chain.SAMPLE`` documents);
2. quality rules: documents that fail the base rules or lose too many lines go;
3. near-duplicates: one document of each group stays, its smallest doc_id; repeated rows of
   that document stay once;
4. mix: each source's documents as often as its target takes them (0 to 3 times);
5. encoding: the text's piece ids, with a round-trip check.

Null and empty texts pass stage 1 and go in stage 2. Empty tables give empty tables. Columns
beyond those of ``documents`` are carried, whatever their names, except that the last stage
replaces ``text``, ``ids``, ``n_ids`` and ``round_trip``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pursewise.llm import line_quality, minmax_dedup, piece_codec, source_mix, toxicity_chain
from pursewise.llm.common import prepare, stored, table
from pursewise.llm.queries import PIECE_BPE, vocabulary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity_chain.clean_documents(docs, toxicity_chain.fit(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return minmax_dedup.distinct_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return piece_codec.encoded(docs, vocabulary(PIECE_BPE), memo=100_000, batch=1_000_000)


STAGES = [
    ("toxicity", toxicity),
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("mix to target weights", mix),
    ("SentencePiece ids", pieces),
]

#: The classifier and the encoder are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
