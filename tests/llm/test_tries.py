"""Importance resampling and the conversation trie against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import importance, prefix_trie

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_runs(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in plain_runs(t)[1])
    t = Counter(bucket(f) for x in target for f in plain_runs(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000.0) / ((s[b] + 1.0) * (big_t + 10000.0))))
    out = []
    for d, text in docs:
        n, runs = plain_runs(text)
        weight = sum(gain(bucket(f)) for f in runs)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, n, len(runs), weight, score, None])
    able = sorted((x for x in out if x[4] is not None and x[1] >= 20), key=lambda x: (-x[4], x[0]))
    for r, x in enumerate(able[: 5 * len(able) // 100]):
        x[5] = r + 1
    return out


@pytest.mark.parametrize("piece", [1 << 18, 40])
def test_pieces_do_not_change_the_runs(monkeypatch, piece):
    monkeypatch.setattr(importance, "PIECE_BYTES", piece)
    split, r = importance.splitter(), random.Random(piece)
    for _ in range(200):
        text = "".join(r.choice(["Ab", "é", "ÉX9", " ", "\n", "-", "_", "\x7f", "中", "z"]) for _ in range(r.randint(0, 300)))
        n, runs = plain_runs(text)
        got = importance.run_buckets(split, text.encode())
        assert got[0] == n and sorted(got[1].tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in runs)


def test_resample_equals_brute_force(spark, sf, documents):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain_resample([(r.doc_id, r.text) for r in documents.collect()], [r.text for r in target.collect()])
    assert sorted(map(tuple, importance.resample(documents, target).collect())) == sorted(map(tuple, want), key=lambda x: x[0])


def test_resample_of_odd_and_no_rows(spark, odd_documents, no_documents):
    docs = odd_documents.union(odd_documents.withColumn("doc_id", F.col("doc_id") + 100))
    target = spark.createDataFrame([("one two three",), (None,), ("",)], "text string")
    want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], ["one two three"])
    got = importance.resample(docs, target)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want)))
    assert importance.resample(docs, target.limit(0)).count() == docs.count()
    assert importance.resample(no_documents, target).count() == 0


def test_draw_breaks_ties_by_doc_id(spark, monkeypatch):
    monkeypatch.setattr(importance, "MIN_WORDS", 1)
    docs = spark.createDataFrame([(i, "a b") for i in range(60)], "doc_id long, text string")
    flat = importance.resample(docs, docs.select("text"), percent=50, min_words=1)
    rows = sorted(flat.collect(), key=lambda r: (-r.score, r.doc_id))
    assert [r["rank"] for r in rows] == [*range(1, 31), *[None] * 30]


def plain_trie(rows):
    """Nodes by their definition; rows are (conv_id, turn, role, text), no two of one turn alike."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in built.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves = sum(sums[k][0] for k in kids[p]) or 1
        sums[p] = leaves, (len(members[p]) - 1) * words + sum(sums[k][1] for k in kids[p])
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), parent, len(cs), len(kids[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(df):
    return sorted((tuple(r) for r in prefix_trie.trie_nodes(df).collect()), key=str)


DDL = "conv_id long, turn long, role string, text string"


def random_conversations(seed, n, deep=0):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(3 * n), n):
        say = "abc" if r.random() < 0.7 else "a"
        length = r.choice([1, 1, 2, 3, 4, 6, deep or 5])
        rows += [(c, t if t or r.random() < 0.5 else None, r.choice([None, "u"]) if say != "a" else "u", " ".join(r.choice(say) * r.randint(0, 2) for _ in range(2)) if say != "a" else "a") for t in range(length)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard, group", [(200_000, 256), (12, 2), (30, 3), (5, 2)])
def test_trie_equals_brute_force_however_it_is_dealt(spark, monkeypatch, shard, group):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard)
    monkeypatch.setattr(prefix_trie, "GROUP", group)
    rows = random_conversations(shard, 90, deep=70)
    assert nodes(spark.createDataFrame(rows, DDL)) == plain_trie(rows)


def test_trie_of_equal_conversations_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 20)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    rows = [(c, t, "u", f"x{t}") for c in range(100) for t in range(2)] + [(1000, 0, None, None)]
    assert nodes(spark.createDataFrame(rows, DDL)) == plain_trie(rows)


def test_trie_of_given_tables_odd_rows_and_none(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    assert nodes(conv) == plain_trie([tuple(r) for r in conv.select("conv_id", "turn", "role", "text").collect()])
    odd = [(None, 0, "u", "x"), (20, None, None, None), (20, 3, "u", ""), (21, 1, "u", "w " * 50_000), (23, 1, "", None), (1, 1, "u", "no first"), (2, 0, "u", "b")]
    df = spark.createDataFrame(odd, DDL).withColumns({c: F.lit("x") for c in ("key", "path", "words", "depth", "family", "h")})
    assert nodes(df) == plain_trie(odd)
    assert nodes(df.limit(0)) == []
    ties = [(c, 1, "u", x) for c in (20, 21, 22) for x in ("a", "a", "b", "c")]
    assert nodes(spark.createDataFrame(ties, DDL)) == nodes(spark.createDataFrame(ties[::-1], DDL))


def test_long_rows_are_put_in_order_panel_by_panel(monkeypatch):
    monkeypatch.setattr(prefix_trie, "PANEL", 3)
    r = np.random.default_rng(3)
    length = r.integers(0, 14, 300)
    path = r.integers(0, 2, (int(length.sum()), 2))
    conv = r.permutation(300)
    at = np.concatenate([[0], np.cumsum(length)])
    rows = [path[at[i] : at[i + 1]].tolist() for i in range(300)]
    want = sorted(range(300), key=lambda i: (rows[i], conv[i]))
    assert prefix_trie.sorted_order(path, length, conv).tolist() == want
    in_order = prefix_trie.Rows(np.concatenate([path[at[i] : at[i + 1]] for i in want]), length[want], {})
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert prefix_trie.shared_turns(in_order).tolist() == [-1] + [common(rows[a], rows[b]) for a, b in zip(want, want[1:])]
