"""Suffix dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import suffix_dedup


def plain(rows, window=50):
    """rows: (doc_id, text or None); each cut by its own text."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            if d is not None:
                w = b[i : i + window]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if d is not None and first[b[i : i + window]] < d:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cut(df):
    return sorted((tuple(r) for r in suffix_dedup.digests(suffix_dedup.remove_spans(df)).collect()), key=str)


def passages(seed, n):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice("ab é中 ") for _ in range(k))
    shared = [text(k) for k in (20, 49, 50, 51, 80, 130, 400)] + ["a" * 300, "ab" * 120, "x" + "abc" * 90]
    rows = []
    for d in range(n):
        parts = [r.choice([lambda: text(r.randint(0, 90)), lambda: r.choice(shared)])() for _ in range(r.randint(0, 5))]
        rows.append((d * 7 % n, "".join(parts)))
    return rows + [(n + i, rows[i][1]) for i in range(0, n, 3)] + [(3, "again " * 20), (3, rows[0][1])]


@pytest.mark.parametrize("shard, bucket, hot, run", [(2 << 20, 3 << 20, 50_000, 64), (300, 900, 50_000, 7), (900, 700, 1, 64), (500, 2000, 4, 3)])
def test_equals_brute_force_however_it_is_dealt(spark, monkeypatch, shard, bucket, hot, run):
    for name, value in (("SHARD_BYTES", shard), ("BUCKET_BYTES", bucket), ("HOT_RUNS", hot), ("RUN_WINDOWS", run), ("FILTER_BITS", 1 << 12)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = passages(shard, 70)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert cut(df) == plain(rows)


def test_given_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert cut(documents) == plain(rows)


def test_odd_and_no_rows(odd_documents, no_documents):
    few = odd_documents.where("length(text) < 1000 or text is null")
    more = few.union(few.withColumn("doc_id", F.col("doc_id") + 100)).union(few.withColumn("doc_id", F.lit(None).cast("long")))
    assert cut(more) == plain([(r.doc_id, r.text) for r in more.collect()])
    long = odd_documents.where("doc_id in (6, 7)")
    assert cut(long) == plain([(r.doc_id, r.text) for r in long.collect()])
    assert cut(no_documents) == []


def test_runs_hold_every_window_once_with_a_mark_of_its_content():
    r = np.random.default_rng(5)
    texts = [r.choice(np.frombuffer(b"ab c", np.uint8), k) for k in (0, 10, 49, 50, 51, 200, 0, 300, 64)] + [np.full(200, 97, np.uint8)]
    data, at = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    start, windows, mark, _ = suffix_dedup.marked_runs(data, at)
    covered = [i for s, n in zip(start.tolist(), windows.tolist()) for i in range(s, s + n)]
    want = [a + i for a, x in zip(at.tolist(), texts) for i in range(len(x) - 49)]
    assert covered == want
    by = {}
    for s, n, m in zip(start.tolist(), windows.tolist(), mark.tolist()):
        for i in range(s, s + n):
            assert by.setdefault(data[i : i + 50].tobytes(), m) == m


def test_interleaving_sorts_and_marks_repeats():
    r = np.random.default_rng(6)
    text = r.choice(np.frombuffer(b"aab", np.uint8), 600)
    text[300:380] = text[:80]
    start = np.arange(551)
    order, first = suffix_dedup.interleaved(text, start, 50)
    words = [text[i : i + 50].tobytes() for i in order.tolist()]
    assert words == sorted(words) and sorted(order.tolist()) == start.tolist()
    assert first.tolist() == [i == 0 or words[i] != words[i - 1] for i in range(len(words))]
