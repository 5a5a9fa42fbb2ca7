"""A corpus pipeline: language ID, line dedup, near-duplicate removal, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the docs of the next. All but the last return the
columns of ``documents``; n_chars follows the text.

A null, empty or letterless text goes in the first stage. Every row is a document
of its own; in both deduplications rows equal in doc_id and text are one. Rows with a
null doc_id pass these unchanged. Null lang and source are values of their own.
Texts of any length are taken whole, extra columns stay up to the last stage, and
an empty table goes through all stages empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, langid, line_dedup, mix, ngram_join
from lectern.llm.common import materialise
from lectern.llm.queries import tuned

#: Pieces that the last stage's workers remember: fewer than alone, as the stages before have grown the JVM.
MEMO_PIECES = 120_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from the profile of every language, go."""
    tuned(spark)
    return langid.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of near-equal lines stays; a document of which no line is left goes."""
    tuned(spark)
    cut = line_dedup.dedup_lines(docs).where((F.col("__n_removed") == 0) | (F.trim("text") != ""))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by shingle Jaccard of 0.8 stays."""
    tuned(spark)
    return ngram_join.keep_one_per_component(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the target mix of sources and shuffled."""
    tuned(spark)
    return mix.mix_sources(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and a check that they decode to its text."""
    tuned(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), memo=MEMO_PIECES)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express these stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
