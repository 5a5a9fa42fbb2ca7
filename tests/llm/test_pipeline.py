"""The pipeline and the registration of its operators."""

import hashlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from lectern.llm import queries as Q
from lectern.llm.common import materialise
from tests.compare import numbers_alike, rows
from tests.llm.test_dedup import brute_components, brute_lines, template_lines


def test_names():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(Q.oracle_sql()) <= set(Q.queries())


def test_oracle_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in Q.oracle_sql().items():
        assert rows(numbers_alike(Q.queries()[name](spark, sf).toPandas())) == rows(numbers_alike(c.execute(sql).df())), name


def test_stages_against_brute_force(spark, sf, documents):
    from tokenizers import Tokenizer

    docs, seen = documents.limit(80), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = materialise(stage(spark, docs, sf), name)
        assert docs.columns == documents.columns
        after = [(r.doc_id, r.text) for r in docs.collect()]
        seen[name] = after
        if name == "language_id":
            assert dict(after) == {d: t for d, t in before.items() if any(ch.isalpha() for ch in t or "")}
        elif name == "line_dedup":
            gone = brute_lines(list(before.items()))
            want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in before.items()}
            assert dict(after) == {d: t for d, t in want.items() if t.strip() or t == before[d]}
        elif name == "ngram_jaccard":
            assert set(dict(after)) == {d for d, (_, c) in brute_components(list(before.items())).items() if d == c}
        else:
            assert set(after) <= set(before.items())
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    want = [(d, hashlib.sha256(np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for d, t in seen["mix_sources"]]
    assert sorted((r.doc_id, r.ids_sha256) for r in out) == sorted(want)


def test_line_dedup_stage_loses_no_link_of_long_lists(spark, sf):
    lines = template_lines(7)
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in lines], "doc_id long, text string, n_chars long")
    gone = {d for d, _ in brute_lines(lines)}
    assert gone and {r.doc_id for r in corpus_pipeline.dedup_lines(spark, docs, sf).collect()} == {d for d, _ in lines} - gone


def test_stages_on_odd_and_no_documents(spark, sf, odd_documents, no_documents):
    for first in (odd_documents, no_documents):
        docs = first
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
