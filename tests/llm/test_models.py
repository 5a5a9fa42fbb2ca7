"""Mixing, language ID, quality, toxicity, top-k: brute force, held-out accuracy, odd rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import langid, mix, quality, queries, topk, toxicity


def test_poisson_inverse_equals_plain_inversion(spark):
    rows = [(m, u) for m in (0.0, 0.2, 1.0, 3.5, 16.0) for u in (1e-9, 0.1, 0.5, 0.9, 0.999999)]
    got = {(r.m, r.u): r.k for r in spark.createDataFrame(rows, "m double, u double").withColumn("k", mix.poisson_inverse(F.col("m"), F.col("u"))).collect()}
    for m, u in rows:
        k, p = 0, math.exp(-m)
        cdf = p
        while cdf < u:
            k += 1
            p *= m / k
            cdf += p
        assert got[m, u] == k


@pytest.mark.parametrize("rate", [0.0, 3.5, 16.0, 50.0, 500.0])
def test_poisson_count_has_the_variance_of_its_mean(spark, rate):
    n = 4000
    k = mix.poisson_count(F.lit(rate), F.lit(7), F.col("id"))
    mean, variance, least = spark.range(n).select(k.alias("k")).agg(F.avg("k"), F.var_samp("k"), F.min("k")).first()
    assert abs(mean - rate) <= 4 * math.sqrt(rate / n) and abs(variance - rate) <= 0.12 * rate
    assert least < rate - 2.5 * math.sqrt(rate) or rate < 10


def test_mix_of_a_rare_source_is_poisson(spark):
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "rare").otherwise("hot").alias("source"))
    mixed = mix.mix_sources(df, {"rare": 1, "hot": 1}).where("source = 'rare'").groupBy("doc_id").count()
    mean, variance = mixed.agg(F.avg("count"), F.var_samp("count")).first()
    assert abs(mean - 50) < 1.5 and abs(variance - 50) < 12


def test_mix_moves_counts_to_targets(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "hot").otherwise(F.when(F.col("id") % 10 < 9, "mid")).alias("source"), F.lit("t").alias("text"))
    n = {r.source: r.n for r in mix.mix_sources(df, {"hot": 1, "mid": 1}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert set(n) == {"hot", "mid"} and all(abs(v - 20_000) < 700 for v in n.values())
    a, b = (mix.mix_sources(df.repartition(p), temperature=0.0).select("__order").collect() for p in (3, 8))
    assert a == b and a == sorted(a)
    assert mix.mix_sources(df.limit(0)).count() == 0


def test_mix_query_shuffles_whole_documents(spark, sf, documents):
    out = queries.op1_mix_sources(spark, sf)
    folder = {p.rsplit("/", 1)[0] for p in out.inputFiles()}
    written = spark.read.parquet(*folder)
    assert set(documents.columns) < set(written.columns) and written.count() == out.count()
    assert written.select(documents.columns).distinct().exceptAll(documents.distinct()).count() == 0
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys)


def test_mix_keeps_a_caller_s_columns(spark, odd_documents):
    names = {c: F.lit(f"mine {c}") for c in ("k", "key", "id", "of", "order", "copy", "row", "rate", "__k", "__rate", "__copy", "__order")}
    clashing = odd_documents.withColumns(names)
    out = mix.mix_sources(clashing)
    assert set(out.columns) == set(clashing.columns)
    plain = {(r.doc_id, r["__copy"], r["__order"]) for r in mix.mix_sources(odd_documents).collect()}
    rows = out.collect()
    assert {(r.doc_id, r["__copy"], r["__order"]) for r in rows} == plain and all(r["__k"] == "mine __k" and r["order"] == "mine order" for r in rows)


def test_mix_sql_follows_high_rates(spark):
    import duckdb

    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 9, "rare").when(F.col("id") % 50 == 0, None).otherwise("hot").alias("source"))
    out = mix.mix_sources(df)
    c = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    want = Counter((d, n) for d, _, n, _ in c.execute(mix.SQL).fetchall())
    assert out.where("__rate > 16").count() > 0 and Counter((r.doc_id, r["__copy"]) for r in out.select("doc_id", "__copy").collect()) == want


def test_language_of_held_out_documents(spark, odd_documents, no_documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right, least, most = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred")), F.min("score"), F.max("score")).first()
    assert n > 150 and right / n > 0.97 and 0 <= least and most <= 1
    rows = langid.predictions(odd_documents).collect()
    assert len(rows) == odd_documents.count() and {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 10)} == {"und"}
    assert langid.predictions(no_documents).count() == 0
    kept = langid.keep_identified(odd_documents)
    assert kept.columns == odd_documents.columns and {0, 1, 2, 10}.isdisjoint({r.doc_id for r in kept.collect()})


def plain_grams(text):
    """N-grams of a text, most frequent first, from Python strings."""
    grams = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        word = f" {''.join(filter(str.isalpha, word))} "
        grams.update(word[i : i + n] for n in (1, 2, 3) for i in range(len(word) - n + 1) if word.strip() and word[i : i + n] != " ")
    return grams


def plain_order(grams, most):
    return sorted(grams, key=lambda g: (-grams[g], langid.gram_hash(g)))[:most]


def test_languages_equal_a_plain_scorer(spark, documents):
    rows = [(r.doc_id, r.text, r.lang) for r in documents.collect()]
    learned = defaultdict(Counter)
    for doc, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(doc).encode()) % 5:
            learned[lang] += plain_grams(text)
    profiles = {lang: {g: i for i, g in enumerate(plain_order(c, 400))} for lang, c in sorted(learned.items())}
    want = {}
    for doc, text, _ in rows:
        top = plain_order(plain_grams(text), 300)
        cost = {lang: sum(abs(p[g] - i) if g in p else 400 for i, g in enumerate(top)) for lang, p in profiles.items()}
        lang = min(cost, key=lambda x: (cost[x], x)) if top else "und"
        want[doc] = (not zlib.crc32(str(doc).encode()) % 5, lang, round(1 - cost[lang] / (400 * len(top)), 9) if top else 0.0)
    got = {r.doc_id: (r.held_out, r.lang_pred, round(r.score, 9)) for r in langid.predictions(documents).collect()}
    assert got == want and len(profiles) > 2


def test_many_languages_are_all_learned(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i * 7919 % 100_000:05d}")
    rows = [(1000 * i + j, " ".join(word(20 * i + k) for k in range(20)), f"l{i}") for i in range(600) for j in range(2)]
    profiles = langid.learn_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(profiles) == 600
    found = langid.Profiles(list(profiles.values()))
    names = list(profiles)
    assert sum(names[found.nearest(t.encode())[0]] == lang for _, t, lang in rows) > 0.95 * len(rows)


def test_language_of_a_row_does_not_depend_on_its_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profiles = langid.learn_profiles(docs, ~langid.held_out(F.col("doc_id"), 5, 0))
    a = langid.identify(docs, profiles).orderBy("doc_id").collect()
    assert a == langid.identify(docs.withColumn("lang", F.lit("xx")), profiles).orderBy("doc_id").collect()


def plain_stats(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            again.update(range(i, i + 5))
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def plain_kept(docs):
    """Verdicts by quantiles of sorted lists, which a sketch of few rows equals."""
    groups, measured = defaultdict(list), []
    for r in docs:
        n, chars, symbols, dup, again = plain_stats(r.text)
        lines = sum(1 for x in (r.text or "").encode().split(b"\n") if x.split())
        failed = n < 10 or 100 * again > 20 * n
        m = (chars / max(n, 1), symbols / max(n, 1), dup / max(lines, 1), again / max(n, 1))
        measured.append((str(r.doc_id), n, failed, (r.lang, r.source), m))
        if not failed:
            groups[r.lang, r.source].append(m)
    at = lambda values, q: sorted(values)[max(math.ceil(q * len(values) - 1e-9), 1) - 1]

    def reach(values, tail, times):
        mid = at(values, 0.5)
        if tail is not None:
            return mid, times * (at(values, tail) - mid) or None, times * (mid - at(values, 1 - tail)) or None
        q = [at(values, 0.5 + i / 200) for i in range(101)]
        wide = [(lo - mid) + (hi - lo) / 2 for lo, hi in zip(q, q[1:]) if hi > lo and hi - lo >= 6 * (lo - mid)]
        return mid, wide[-1] if wide else None, None

    every, out = [m for g in groups.values() for m in g], []
    for doc, n, failed, group, m in measured:
        ok = not failed
        for i, (tail, times, low) in enumerate([(0.8, 6, True), (None, 0, False), (0.99, 2, False), (0.99, 2, False)]) if ok else ():
            own = len(groups[group]) / (len(groups[group]) + 50)
            parts = zip(reach([x[i] for x in groups[group]], tail, times), reach([x[i] for x in every], tail, times))
            mid, up, down = (None if g is None and a is None else own * (a if g is None else g) + (1 - own) * (g if a is None else a) for g, a in parts)
            ok = ok and (up is None or m[i] <= mid + up) and (not low or down is None or m[i] >= mid - down)
        out.append((doc, n, ok))
    return sorted(out)


def test_sketches_decide_every_rule(spark):
    """No fence is a fixed one: each rule's move with its group, and half of all rows' spread brings other fences."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    passed = quality.judge(docs).where("not base_failed").join(docs.select("doc_id", "lang", "source"), "doc_id").withColumn("n_lines", F.lit(1))
    rs = quality.rules()
    measures = passed.select("lang", "source", *[r.measure.alias(f"m_{r.name}") for r in rs]).persist()
    limits = quality.fences(measures, rs).toPandas().sort_values(["lang", "source"])
    narrow = quality.fences(measures.select("lang", "source", *[(F.col(f"m_{r.name}") / 2).alias(f"m_{r.name}") for r in rs]), rs).toPandas().sort_values(["lang", "source"])
    assert len(limits) > 50
    for r in rs:
        hi = limits[f"hi_{r.name}"]
        assert hi.notna().mean() > 0.95 and hi.nunique() > 10
        half = narrow[f"hi_{r.name}"].to_numpy() / hi.to_numpy()  # a floor would not follow the measure; sketches of many rows are drawn anew
        assert np.mean(np.abs(half - 0.5) < 0.1) > 0.95
    assert limits.lo_word_length.nunique() > 50


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_quality_statistics_equal_brute_force(documents, odd_documents, no_documents, which):
    df = documents if which == "sf" else odd_documents
    want = sorted((str(r.doc_id), *plain_stats(r.text)) for r in df.collect())
    rows = quality.judge(df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    want = plain_kept(df.collect())
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in rows) == want and (which == "odd" or any(not k for _, n, k in want if n >= 10))
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.judge(no_documents).count() == 0


def test_quality_keeps_good_and_drops_bad(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_thresholds_follow_the_group(spark):
    words = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(120)]
    rows = [(i, t, "en", "plain") for i, t in enumerate(words)] + [(500 + i, t.replace(" ", " | "), "en", "tables") for i, t in enumerate(words)] + [(999, words[0].replace(" ", " | "), "en", "plain")]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept[500] and kept[0] and not kept[999]


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({"idiot": 4.0, "scum*": 3.0})
    weigh = lambda text: sum(g.matched(text))
    assert weigh("You are an idiot") == 5 > weigh("What an idiot") == 4 > weigh("Not an idiot") == 2
    assert weigh("Tom said what an idiot") == weigh("Tom said, what an idiot") == weigh('Tom said: "what an idiot"') == 3
    assert weigh("He said, what an idiot") == 3 and weigh("He said you are an idiot") == 3.75 and weigh("Tom said so. What an idiot") == 4
    assert weigh("not one of you, an idiot came") == 4 and weigh("never ever has there been an idiot") == 4
    assert g.matched("A scumbag. Nothing here.") == [3.0] and g.matched("") == [] and weigh("kill") == 0 < weigh("kill you") < weigh("I will kill you")
    assert weigh("They left, kill it") == 0 and weigh("an idiot, you fool") == 4


def every_path(machines, read):
    """The best weight over all paths of the transducers one after the other, uncomposed."""
    def walk(m, symbols):
        paths = [(s, ()) for s in m.starts]
        for x in symbols:
            paths = [(to, (*out, (written, f))) for s, out in paths for to, written, f in m.arcs.get((s, x), ())]
        return [out for s, out in paths if s in m.finals]

    best = 0.0
    for choice in itertools.product(*read):
        live = [([x for x, _ in choice], [w for _, w in choice])]
        for m in machines:
            live = [([y for y, _ in out], [w * f for w, (_, f) in zip(ws, out)]) for xs, ws in live for out in walk(m, xs)]
        best = max([best, *(sum(ws) for _, ws in live)])
    return best


def test_composition_equals_all_paths():
    r, machine = random.Random(3), toxicity.Grammar({}).machine
    for _ in range(150):
        read = [[(x, r.choice([0.0, 1.0, 2.5])) for x in r.sample(["term", "threat", "target", "not", "said", "modal", ",", "other"], r.choice([1, 1, 2]))] for _ in range(r.randint(0, 7))]
        assert abs(machine.best(read) - every_path(toxicity.transducers(), read)) < 1e-9


def test_scores_equal_a_plain_scorer(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    lexicon, curve = {"idiot": 4.0, "the": 0.5, "stup*": 3.0, "la": 1.0}, [0.9, 0.4, -2.0]
    grammar = toxicity.Grammar(lexicon)
    for r in toxicity.score(documents, lexicon, curve).join(documents.select("doc_id", "text"), "doc_id").collect():
        found = []
        for sentence in re.split(r"[.!?;\n|]+", (r.text or "").lower()):
            for clause in [sentence] if len(sentence) < 60 else []:
                read = [grammar.symbols(w)[1] for w in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*|[,:]", clause)]
                assert math.prod(map(len, read)) > 16 or abs(grammar.machine.best(read) - every_path(toxicity.transducers(), read)) < 1e-9
            found.append(grammar.sentence(sentence))
        found = [x for x in found if x > 0]
        z = curve[0] * math.log1p(sum(found)) + curve[1] * math.log1p(max(found, default=0.0)) + curve[2]
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9
    assert labels.count() > 0


def test_toxicity_of_held_out_documents(spark, odd_documents, no_documents):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.predictions(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "score", "predicted").collect()
    tp, fp = sum(r.toxic and r.predicted for r in rows), sum(r.predicted and not r.toxic for r in rows)
    assert tp / sum(r.toxic for r in rows) > 0.9 and fp <= 0.05 * tp and all(0 <= r.score <= 1 for r in rows)
    got = toxicity.predictions(odd_documents, labels).collect()
    assert len(got) == odd_documents.count() and all(r.score is not None for r in got)
    assert toxicity.predictions(no_documents, labels.limit(0)).count() == 0
    assert all(r.predicted == 0 for r in toxicity.predictions(odd_documents, labels.limit(0)).collect())


def brute_topk(rows, k=10):
    v = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v.setdefault(i, [math.floor(1024 * float(x)) for x in e])
    out = set()
    for q in v:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)}
    return out


@pytest.mark.parametrize("shard_rows", [16_384, 70])
def test_topk_equals_brute_force(spark, sf, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute_topk([(r.vec_id, r.embedding) for r in df.collect()])
    assert {tuple(r) for r in topk.top_k(df, lambda c: c % 100 == 0).collect()} == want


def test_topk_leaves_out_far_leaves(spark, monkeypatch):
    """Clusters far apart: a query's copies follow the leaves that may hold a better score, not all."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    r = np.random.default_rng(5)
    middle = r.normal(size=(16, 8)) * 4
    rows = [(i, [float(x) for x in middle[i % 16] + r.normal(size=8) * 0.01]) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(x) for x in topk.top_k(df, lambda c: c % 100 == 0).collect()} == brute_topk(rows)
    x = np.array([[math.floor(1024 * v) for v in e] for _, e in rows], np.float64)
    routes = topk.Routes(x, 32)
    leaf = routes.leaves(x)
    radii = np.array([np.sqrt(((x[leaf == i] - c) ** 2).sum(1)).max(initial=0) for i, c in enumerate(routes.centres)])
    q = x[::100]
    bounds = topk.bound(np.array(routes.centres), radii, q, np.sqrt((q * q).sum(1)))
    tenth = np.sort(q @ x.T, axis=1)[:, -11]
    assert len(routes.centres) > 12 and (bounds >= tenth[:, None]).sum(1).mean() < len(routes.centres) / 3
    assert all((bounds[i, leaf[j]] >= q[i] @ x[j]) for i in range(len(q)) for j in range(0, 1600, 7))


def test_topk_odd_vectors(spark):
    same = [1.0, 0.5]
    rows = [(100 * i if i < 3 else i, same) for i in range(30)] + [(300, None), (301, [None, 1.0]), (302, [float("nan"), 1.0]), (303, [float("inf"), 1.0]), (304, []), (400, [1.0]), (500, [3e38, 3e38]), (501, [-3e38, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = {tuple(r) for r in topk.top_k(df, lambda c: c % 100 == 0).collect()}
    hold = lambda s: max(min(s, topk.LONG[1]), topk.LONG[0])
    assert {(q, c, s) for q, _, c, s in got if q < 300} == {(q, c, hold(s)) for q, _, c, s in brute_topk(rows) if q < 300}
    assert topk.top_k(df.limit(0), lambda c: c % 100 == 0).count() == 0
