"""BPE and the token store against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lectern.llm import bpe, token_store

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def odd_texts(n=3000):
    r = random.Random(4)
    chars = [chr(c) for c in [*range(0x180), 0x300, 0x345, 0x3A3, 0x130, 0x1E9E, 0x2028, 0x2003, 0x3000, 0x180E, 0x200B, 0x4E00, 0x1F600, 0x200D, 0xFB01, 0x661, 0xBD]]
    words = ["the", "don't", "We'Re", "WORLDWIDE,", "1234567", "<|endoftext|>", "<|startoftext|>", " ", "\n\n", "ẖH̱", "étÉ.", "naïve,", "ÀÉÎÕÜÿß.", "Ǆa,", "İx,", "a,b."]
    return ["".join(r.choice(words) if r.random() < 0.4 else r.choice(chars) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_prefix_bpe_equals_the_library():
    ours, lib = bpe.PrefixBpe(public_tokenizers.path(BYTES)), library(BYTES)
    for text in odd_texts():
        ids = lib.encode(text, add_special_tokens=False).ids
        assert ours.encode(text).tolist() == ids
        assert ours.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_chunk_encoder_equals_the_library():
    ours, lib = token_store.ChunkEncoder(public_tokenizers.path(WORDS)), library(WORDS)
    assert ours.direct
    for text in odd_texts():
        assert ours.ids(text.encode()).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_bpe_query_rows(documents, odd_documents, no_documents):
    lib = library(BYTES)
    for df in (documents.limit(40), odd_documents):
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = lib.encode(r.text or "", add_special_tokens=False).ids
            back = lib.decode(ids, skip_special_tokens=False)
            want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        got = [tuple(r) for r in bpe.digests(df, public_tokenizers.path(BYTES)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.digests(no_documents, public_tokenizers.path(BYTES)).count() == 0


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_token_store_round_trip(spark, documents, odd_documents, which, tmp_path):
    df = documents if which == "sf" else odd_documents
    lib, target = library(WORDS), f"file://{tmp_path}/store"
    token_store.write_store(df, target, public_tokenizers.path(WORDS))
    rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, at = [], 0
    for doc, text in rows:
        ids = [*lib.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in token_store.read_store(spark, target, digest=True).collect()), key=lambda r: r[1]) == want
    doc = next(d for d, *_ in want if d is not None)
    assert token_store.fetch(spark, target, doc) == [*lib.encode(dict(rows)[doc], add_special_tokens=False).ids, 1]
    assert token_store.fetch(spark, target, 1 << 40) is None
    ids = token_store.read_store(spark, target)
    assert ids.selectExpr("sum(length(ids)) / 4 as n").first().n == at


def test_token_store_without_documents(spark, no_documents, tmp_path):
    target = f"file://{tmp_path}/empty"
    token_store.write_store(no_documents, target, public_tokenizers.path(WORDS))
    assert token_store.read_store(spark, target).count() == 0


def test_store_spans_blocks_and_partitions(spark, tmp_path, monkeypatch):
    rows = [(i, f"doc number {i} " * (i % 9)) for i in range(1500)]
    target = f"file://{tmp_path}/many"
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), target, public_tokenizers.path(WORDS))
    got = token_store.read_store(spark, target, digest=True).orderBy("doc_id").collect()
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
