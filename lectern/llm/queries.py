"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, importance, langid, line_dedup, mix, ngram_join, prefix_trie, quality, substring, suffix_dedup, token_store, topk, toxicity
from lectern.llm.common import materialise, scratch_path


#: Rows of an Arrow batch: texts are long, and two workers share an executor's memory with the JVM.
ARROW_ROWS = "1000"


def tuned(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tuned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark, sf_dir):
    # whole documents are shuffled and written; of the four columns alone, the texts would be pruned below the shuffle
    mixed = materialise(mix.mix_sources(_table(spark, sf_dir, "documents")), "mix")
    rows = mixed.select("doc_id", "source", F.col("__copy").alias("copy"), F.col("__order").alias("shuffle_key"))
    return rows.orderBy("shuffle_key", "doc_id", "copy")


def op2_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    cut = line_dedup.dedup_lines(docs)
    return cut.select(
        "doc_id", F.col("__n_removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def op3_ngram_jaccard(spark, sf_dir):
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_token_store(spark, sf_dir):
    target = scratch_path(spark, "store")
    token_store.write_store(_table(spark, sf_dir, "documents"), target, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_store(spark, target, digest=True)


def op5_language_id(spark, sf_dir):
    return langid.predictions(_table(spark, sf_dir, "documents"))


def op6_bpe(spark, sf_dir):
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_substring_dedup(spark, sf_dir):
    return substring.digests(substring.remove_repeats(_table(spark, sf_dir, "documents")))


def op8_exact_topk(spark, sf_dir):
    return topk.top_k(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op9_quality_rules(spark, sf_dir):
    return quality.judge(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark, sf_dir):
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie_nodes(_table(spark, sf_dir, "conversations"))


def op13_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(suffix_dedup.remove_spans(_table(spark, sf_dir, "documents")))


QUERIES = (
    op1_mix_sources, op2_line_dedup, op3_ngram_jaccard, op4_token_store, op5_language_id, op6_bpe, op7_substring_dedup, op8_exact_topk,
    op9_quality_rules, op10_toxicity, op11_importance_resampling, op12_prefix_trie, op13_suffix_dedup,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mix.SQL, "op7_substring_dedup": substring.SQL, "op8_exact_topk": topk.SQL, "op11_importance_resampling": importance.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_suffix_dedup": suffix_dedup.SQL}
