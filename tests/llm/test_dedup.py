"""Line dedup, n-gram join and substring dedup against brute force."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
import xxhash

from lectern.llm import line_dedup, ngram_join, substring
from lectern.llm.components import connected_components
from lectern.llm.line_dedup import edit_distance, edit_similar, normalised_lines, words_bound


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets, links = {d: shingle_set(t) for d, t in rows if d is not None}, Sets()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        links.find(a)
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                links.join(a, b)
    return {d: (len(sets[d]), links.find(d)) for d in ids}


def near_copies(seed=3):
    """A base with copies, near copies with one to six edits, and documents that share a passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    rows, passage = [], " ".join(word() for _ in range(40))
    for base in range(6):
        words = [word() for _ in range(r.choice([12, 60, 150]))]
        for copy in range(25):
            w = list(words)
            for _ in range(copy % 7):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows) * 3, " ".join(w)))
    for _ in range(30):
        rows.append((len(rows) * 3, passage + " " + " ".join(word() for _ in range(r.randint(1, 60)))))
    return rows


def test_components_reach_the_smallest_id(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("which", ["made", "sf"])
def test_ngram_components_equal_brute_force(spark, documents, which):
    df = documents if which == "sf" else spark.createDataFrame(near_copies(), "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert got == brute_components(rows)


def test_overlaps_are_summed_over_blocks_of_columns(spark, monkeypatch):
    r = random.Random(6)
    sets = {i: sorted(r.sample(range(60), r.randint(1, 40))) for i in range(40)} | {40 + i: list(range(50 - i)) for i in range(12)}
    pairs = [(a, b) for a in sets for b in sets if a < b]
    rows = [(i, len(s), block, [x for x in s if x % 8 == block]) for i, s in sets.items() for block in range(8)]
    want = {(a, b) for a, b in pairs if 100 * len(x := set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b])) and x}
    frames = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "id long, n long, block int, columns array<long>")
    for rounds in ((0, 8), (0, 2, 8), (0, 1, 2, 5, 8)):
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        assert {tuple(x) for x in ngram_join.accumulated(*frames, 80, 100).collect()} == want and want


def test_rows_of_one_doc_id_go_each_by_its_own_text(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(3, a, "p"), (5, a, "q"), (5, b, "r"), (5, b, "r"), (None, a, "s"), (7, None, "t")]
    left = ngram_join.keep_one_per_component(spark.createDataFrame(rows, "doc_id long, text string, t string"))
    assert sorted(map(str, left.collect())) == sorted(map(str, spark.createDataFrame([rows[i] for i in (0, 2, 3, 4, 5)], "doc_id long, text string, t string").collect()))


def test_ngram_odd_and_no_documents(odd_documents, no_documents):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(odd_documents).collect()]
    assert len(got) == odd_documents.count()
    assert {(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 8, 3), (4, 8, 3), (5, 8, 3), (8, 1, 8)} <= set(got)
    assert {c for d, _, c in got if d in (6, 7)} == {6} and {c for d, _, c in got if d is None} == {None}
    assert ngram_join.jaccard_components(no_documents).count() == 0
    kept = ngram_join.keep_one_per_component(odd_documents)
    assert kept.columns == odd_documents.columns and {4, 5, 7}.isdisjoint({r.doc_id for r in kept.collect()})


def fingerprint(line):
    """(SimHash, blocks) of a normalised line, from its word pairs alone."""
    return tuple(x[0].tolist() for x in (f(*line_dedup.pair_hashes([line.split()])) for f in (line_dedup.simhashes, line_dedup.blocks)))


def brute_lines(rows, similarity=0.8):
    """Lines to take out by all pairs of distinct normalised lines that agree in a block of the fingerprint."""
    at = defaultdict(list)
    for doc, text in rows:
        for no, words in enumerate(normalised_lines(text.encode() if text else None)):
            if words and doc is not None:
                at[b" ".join(words)].append((doc, no))
    keys = sorted(at)
    prints, links = [fingerprint(k) for k in keys], Sets()
    for i, a in enumerate(keys):
        links.find(a)
        for j in range(i):
            (x, xs), (y, ys) = prints[i], prints[j]
            most = line_dedup.NEAR_BITS + line_dedup.SHORT_BITS / max(len(a.decode()), len(keys[j].decode()))
            if any(p == q for p, q in zip(xs, ys)) and (x ^ y).bit_count() <= most and edit_similar(a.decode(), keys[j].decode(), similarity):
                links.join(a, keys[j])
    groups = defaultdict(set)
    for k in keys:
        groups[links.find(k)] |= set(at[k])
    return {p for g in groups.values() for p in g if p != min(g)}


@pytest.mark.parametrize("which", ["made", "sf"])
def test_repeated_lines_equal_brute_force(spark, documents, which, monkeypatch):
    monkeypatch.setattr(line_dedup, "LONG_LIST", 1 << 30)
    if which == "sf":
        rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").limit(60).collect()]
    else:
        made = near_copies(5)
        rows = [(d, "\n".join([t, made[(i * 7) % len(made)][1], "ok", "--"])) for i, (d, t) in enumerate(made[:120])]
    got = {(r.doc_id, n) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() for n in r.lines}
    assert got == brute_lines(rows) and got


@pytest.mark.parametrize("segment", [1 << 20, 64])
def test_lines_taken_apart_at_once_are_those_of_each_text(monkeypatch, segment):
    whole = line_dedup.Lines([b"these words span several segments of the text " * 9])
    monkeypatch.setattr(line_dedup, "_SEGMENT", segment)
    monkeypatch.setattr(line_dedup, "_held", {})
    assert line_dedup.Lines([b"these words span several segments of the text " * 9]).words.tolist() == whole.words.tolist()
    r = random.Random(12)
    parts = ["a", "Bc", "été", "ÀÉ", "İ", "\u0130x", "--", "...", " ", "\t", "\n", "\n\n", "\r\n", "\x00", "\x85", "日本", "x" * 300, "9,5"]
    for n in (0, 1, 3, 40):
        texts = [None if r.random() < 0.1 else "".join(r.choice(parts) for _ in range(r.randint(0, 30))).encode() for _ in range(n)] + [b"", b"\xff\xfe ok", None]
        got = line_dedup.Lines(texts)
        want = [(i, no, b" ".join(w)) for i, t in enumerate(texts) for no, w in enumerate(normalised_lines(t)) if w]
        assert [(int(t), int(no), got[i]) for i, (t, no) in enumerate(zip(got.text, got.no))] == want
        assert got.chars.tolist() == [len(x.decode("utf-8", "replace")) for _, _, x in want] and got.sizes.tolist() == [len(x.split()) for _, _, x in want]
        assert got.keys().view(np.uint64).tolist() == [xxhash.xxh64_intdigest(x) for _, _, x in want]
        words = [w for _, _, x in want for w in x.split()]
        assert len({(w, int(h)) for w, h in zip(words, got.words)}) == len(set(words)) == len(set(got.words.tolist()))


def test_fingerprints_of_many_lines_are_those_of_each(monkeypatch):
    r = random.Random(2)
    lines = [" ".join(r.choice("abcdefgh") for _ in range(r.choice([1, 2, 9, 400]))).encode() for _ in range(60)]
    want = [fingerprint(x) for x in lines]
    plain = [sum((2 * sum((h >> (8 * (i // 8) + 7 - i % 8)) & 1 for h in hs) > len(hs)) << (8 * (i // 8) + 7 - i % 8) for i in range(64)) for hs in (line_dedup.pair_hashes([x.split()])[0].tolist() for x in lines)]
    assert plain == [w[0] for w in want]
    monkeypatch.setattr(line_dedup, "_STEP", 37)
    h = line_dedup.pair_hashes([x.split() for x in lines])
    assert list(zip(line_dedup.simhashes(*h).tolist(), line_dedup.blocks(*h).tolist())) == want


def test_recall_over_all_near_lines():
    """At least 0.9 of all pairs of edit similarity 0.8 and more among the lines of a table are candidates, short ones too."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    keys = sorted({b" ".join(w).decode() for t in texts for w in normalised_lines((t or "").encode()) if w}, key=len)
    keys = [k for k in keys if len(k) <= 130]
    lengths = np.array([len(k) for k in keys])
    grams = np.zeros((len(keys), 256), np.int16)
    for i, k in enumerate(keys):
        np.add.at(grams[i], [zlib.crc32(k[n : n + 3].encode()) % 256 for n in range(len(k) - 2)], 1)
    near = found = 0
    for i, k in enumerate(keys):
        to = int(np.searchsorted(lengths, lengths[i] / 0.8 + 1e-9, "right"))
        # an edit changes three runs of three characters at most, so this loses no near pair
        some = np.flatnonzero(np.abs(grams[i + 1 : to] - grams[i]).sum(1) <= 6 * np.floor(lengths[i + 1 : to] * 0.2 + 1e-9)) + i + 1
        for j in some.tolist():
            if edit_similar(k, keys[j]):
                (x, xs), (y, ys) = fingerprint(k.encode()), fingerprint(keys[j].encode())
                near += 1
                found += any(p == q for p, q in zip(xs, ys)) and (x ^ y).bit_count() <= line_dedup.NEAR_BITS + line_dedup.SHORT_BITS / len(keys[j])
    assert near > 30 and found >= 0.9 * near, (found, near)


def test_rows_of_one_doc_id_keep_their_own_lines(spark):
    only, shared = "a precious line found nowhere else at all", "this line is in the other row as well"
    rows = [(1, "zero\n" + shared), (5, shared + "\nsecond"), (5, only + "\n" + shared), (6, only[:-1] + "x y z q r s t u v w"), (5, shared + "\nsecond")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text, r["__n_removed"]) for r in out.collect()) == sorted([(1, rows[0][1], 0), (5, "second", 1), (5, only, 1), (6, rows[3][1], 0), (5, "second", 1)])


def test_long_lists_are_split(spark, monkeypatch):
    made = near_copies(5)
    df = spark.createDataFrame([(d, t) for d, t in made], "doc_id long, text string")
    got = sorted(map(str, line_dedup.repeated_lines(df).collect()))
    monkeypatch.setattr(line_dedup, "LONG_LIST", 1 << 30)
    want = sorted(map(str, line_dedup.repeated_lines(df).collect()))
    assert len(want) >= len(got) >= 0.95 * len(want) and want


def template_lines(seed=4):
    """Lists far over the length of a cell: lines that share most words, and lines that share a passage, near or not."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    lines = []
    for length in (5, 6, 8):
        base = [word() for _ in range(length)]
        for _ in range(40):
            near = list(base)
            near[r.randrange(length)] = word()
            lines.append(" ".join(near))
    passage = " ".join(word() for _ in range(30))
    lines += [" ".join([word() for _ in range(r.randint(0, 9))] + [passage] + [word() for _ in range(r.randint(0, 12))]) for _ in range(90)]
    return list(enumerate(lines))


@pytest.mark.parametrize("cell", [None, 5])
def test_long_lists_lose_no_link(spark, monkeypatch, cell):
    """With the length of lists that the query has, and cells so small that every list is dealt."""
    rows = template_lines()
    if cell:
        monkeypatch.setattr(line_dedup, "LONG_LIST", cell)
    got = {(r.doc_id, n) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() for n in r.lines}
    assert got == brute_lines(rows) and got


def test_links_of_a_crowd_are_a_forest():
    """Lines all near each other give no row for each pair."""
    base = [f"word{i}" for i in range(40)]
    lines = [" ".join([*base, "end", f"n{i:03}"]) for i in range(90)]
    h, starts = line_dedup.pair_hashes([[w.encode() for w in x.split()] for x in lines])
    sims, cells = line_dedup.simhashes(h, starts).view(np.int64), line_dedup.blocks(h, starts).view(np.int64)
    block = Counter(cells[:, 0].tolist()).most_common(1)[0][0]
    lines, sims, cells = [x for x, c in zip(lines, cells) if c[0] == block], sims[cells[:, 0] == block], cells[cells[:, 0] == block]
    rows = [{"far": False, "id": i, "component": i, "sim": int(sims[i]), "chars": len(x), **{f"b{t}": int(c) for t, c in enumerate(cells[i])}, "line": x} for i, x in enumerate(lines)]
    kinds = [("far", pa.bool_()), ("id", pa.int64()), ("component", pa.int64()), ("sim", pa.int64()), ("chars", pa.int32()), *((f"b{t}", pa.int64()) for t in range(line_dedup.BLOCKS)), ("line", pa.string())]
    work = pa.RecordBatch.from_arrays([pa.array([block]), pa.array([0]), pa.array([0]), pa.array([rows], pa.list_(pa.struct(kinds)))], names=["g", "lo", "hi", "rows"])
    links = [(r["a"], r["b"]) for b in line_dedup._links(0.8, iter([work])) for r in b.to_pylist()]
    sets = Sets()
    for a, b in links:
        sets.join(a, b)
    assert len({sets.find(i) for i in range(len(lines))}) == 1 and len(links) == len(lines) - 1 > 30


@pytest.mark.parametrize("sorted_,crowd", [(1 << 17, 1000), (400, 5)])
def test_packed_cells_give_the_shared_blocks(monkeypatch, sorted_, crowd):
    """Lines of one key are one, whichever task has them; no part gets a crowd as a whole."""
    monkeypatch.setattr(line_dedup, "_SORTED", sorted_)
    monkeypatch.setattr(line_dedup, "_CROWD", crowd)
    r, names = random.Random(10), [f"b{i}" for i in range(line_dedup.BLOCKS)]
    cells = {r.getrandbits(63) * r.choice([1, -1]): [-7 if t == 0 and r.random() < 0.7 else r.randint(-400, 400) << 54 | t for t in range(len(names))] for _ in range(300)}
    keys = [k for k in cells for _ in range(r.choice([1, 1, 2, 40]))]
    r.shuffle(keys)
    packed, parts = defaultdict(list), 4
    for task in (keys[:100], keys[100:]):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*((k, *cells[k]) for k in task[i : i + 10]))], names=["key", *names]) for i in range(0, len(task), 10)]
        for b in line_dedup._cells(parts, iter(batches)):
            for row in b.to_pylist():
                packed[row["part"]].append(row)
    schema = pa.schema([("part", pa.int32()), ("sure", pa.bool_()), ("g", pa.binary()), ("ids", pa.binary())])
    got = [(x["g"], x["id"]) for part, rs in packed.items() for b in line_dedup._shared((pa.scalar(part),), iter([pa.RecordBatch.from_pylist(rs, schema)])) for x in b.to_pylist()]
    lists = defaultdict(set)
    for k, gs in cells.items():
        for g in gs:
            lists[g].add(k)
    assert set(got) == {(g, k) for g, ks in lists.items() if len(ks) > 1 for k in ks}
    assert len(got) == len(set(got)) or crowd == 5
    if crowd == 5:
        told = [x for rs in packed.values() for row in rs if not row["sure"] for x in np.frombuffer(row["g"], np.int64).tolist()]
        assert 2 <= told.count(-7) < len(lists[-7]) / 2


def test_blocks_travel_packed(monkeypatch):
    """Both passes over the texts give the blocks of each line as packed values, not as a column of each block."""
    monkeypatch.setattr(line_dedup, "_PORTION", 400)
    texts = [(t + "\n--\n" + t[::-1]).encode() for _, t in near_copies(5)[:40]] + [None, b"", b"--"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([7] * len(texts), pa.int32()), pa.array(texts, pa.binary())], names=["doc_id", "t", "text"])
    lines = pa.Table.from_batches(line_dedup._fingerprints(iter([batch])))
    every = line_dedup.Lines(texts)
    want = dict(zip(every.keys().tolist(), line_dedup.blocks(*every.pair_hashes()).view(np.int64).tolist()))
    assert lines["key"].to_pylist() == every.keys().tolist() and 1 < len(lines) - lines["cells"].null_count < len(texts)
    some = lines.filter(pa.compute.is_valid(lines["cells"])).select(["cells"]).to_batches()
    got = [(x["key"], [x[f"b{i}"] for i in range(line_dedup.BLOCKS)]) for b in line_dedup._portions_cells(iter(some)) for x in b.to_pylist()]
    assert [k for k, _ in got] == lines["key"].to_pylist() and dict(got) == want
    bits = type("Bits", (), {"value": np.full(line_dedup.FILTER_BITS // 64, -1)})
    found = pa.Table.from_batches(line_dedup._line_texts(bits, iter([batch]))).combine_chunks()
    cells = found["cells"].chunk(0).slice(3)
    assert line_dedup._blocks_of({"cells": cells}).tolist() == [want[k] for k in found["key"].to_pylist()[3:]]


def test_bounded_distances_look_at_a_band_alone():
    """A bound of a hundredth of a long line asks for a small part of its cells."""
    r, seconds = random.Random(11), []
    x = "".join(r.choice("abcdefgh ") for _ in range(30_000))
    y = "".join(r.choice("abcdefgh ") if r.random() < 0.003 else c for c in x)
    for most in (None, 300):
        began = time.process_time()
        seconds.append((edit_distance(x, y, most), time.process_time() - began))
    (want, whole), (got, band) = seconds
    assert got == want and 0 < got <= 300 and band < whole / 3


def test_bounded_distances_of_any_shape():
    r = random.Random(12)
    for _ in range(400):
        letters = r.choice(["ab", "abcdefgh ", "éü日本"])
        x = [r.choice(letters) for _ in range(r.choice([1, 40, 64, 65, 300]))]
        y = list(x)
        for _ in range(r.randint(0, max(1, len(x) // r.choice([2, 5, 20])))):
            at = r.randrange(len(y) + 1)
            y[at : at + r.randint(0, 3)] = [r.choice(letters)] * r.randint(0, 3)
        x, y = "".join(x), "".join(y) or "z"
        d = plain_distance(x, y)
        assert edit_distance(x, y) == d
        for most in (0, 1, 7, len(x) // 5, d - 1, d, d + 1, 1000):
            assert most < 0 or edit_distance(x, y, most) == (d if d <= most else None)


def test_texts_are_joined_unsorted(spark, documents):
    """The last join needs no order of the texts."""
    plan = line_dedup.dedup_lines(documents.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [row" in plan and "Sort [row" not in plan


def test_distances_together_are_those_of_each_pair():
    r, xs, ys = random.Random(9), [], []
    for _ in range(1500):
        letters = r.choice(["ab", "abcdefgh ", "éü日本語x y", "a\U0001f600"])
        x = [r.choice(letters) for _ in range(r.randint(1, r.choice([1, 3, 60, 64, 65, 130, 400])))]
        y = list(x)
        for _ in range(r.randint(0, max(1, len(x) // 3))):
            at = r.randrange(len(y) + 1)
            y[at : at + r.randint(0, 1)] = [r.choice(letters)] * r.randint(0, 1)
        xs.append("".join(x))
        ys.append("".join(y))
    for similarity in (0.6, 0.8, 0.95):
        want = [edit_similar(x, y, similarity) for x, y in zip(xs, ys)]
        assert line_dedup.similar(xs, ys, similarity).tolist() == want and 100 < sum(want) < 1400
        assert line_dedup.similar(xs, ys, similarity, line_dedup.SCRIPT_WORDS).tolist() == want


def test_most_near_lines_go(spark):
    """Recall by edit similarity alone, no SimHash in the reference: the loss by length and change."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    rows, kind = [], {}
    for length in (10, 20, 50, 100):
        for changed in sorted({1, length // 10}):
            for _ in range(60):
                words = [word() for _ in range(length)]
                near = list(words)
                for at in r.sample(range(length), changed):
                    near[at] = word()
                if edit_similar(" ".join(words), " ".join(near)):
                    kind[len(rows) + 1] = (length, changed)
                    rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(near))]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    gone = {x.doc_id for x in out.where("__n_removed > 0").collect()}
    assert gone <= set(kind)
    of, found = Counter(kind.values()), Counter(kind[d] for d in gone)
    assert all(found[k] >= 0.9 * n for k, n in of.items()), (of, found)


def test_lines_odd_and_no_documents(odd_documents, no_documents):
    out = line_dedup.dedup_lines(odd_documents)
    assert out.columns == [*odd_documents.columns, "__n_removed"]
    got = defaultdict(set)
    for r in out.collect():
        got[r.doc_id].add((r.text, r["__n_removed"]))
    assert got[0] == {(None, 0)} and got[1] == {("", 0)} and got[9] == {("été où çà", 1)} and got[11] == {("line one here is the same\n\nlast", 1)}
    assert got[4] == {("", 1)} and len(got[8]) == 1
    assert line_dedup.dedup_lines(no_documents).count() == 0


def test_anchored_bounds_are_no_less_than_the_distance():
    r, close = random.Random(6), 0
    for n in (3, 12, 60):
        for _ in range(60):
            a = [r.choice("abcdefghijklmnop") * r.randint(1, 4) for _ in range(n)]
            b = [w for w in a if r.random() < 0.9] or ["x"]
            if r.random() < 0.5:
                b.insert(r.randrange(len(b)), "new")
            real, bound = plain_distance(" ".join(a), " ".join(b)), line_dedup.anchored_bound(a, b)
            assert bound >= real
            close += bound <= 0.2 * len(" ".join(a))
    assert close > 30


def test_pairs_of_no_hope_are_left_out():
    """Pairs go as soon as no path can end in time; those that stay are still told apart."""
    r = random.Random(5)
    xs, ys = [], []
    for i in range(200):
        x = [r.choice("abcdefgh ") for _ in range(r.randint(300, 420))]
        y = [r.choice("abcdefgh ") if r.random() < (0.1, 0.24, 0.9)[i % 3] else c for c in x]
        xs.append(np.array([ord(c) for c in x], np.uint32))
        ys.append(np.array([ord(c) for c in y], np.uint32))
    most = np.array([int(len(x) * 0.2) for x in xs])
    want = [edit_distance("".join(map(chr, x)), "".join(map(chr, y))) <= m for x, y, m in zip(xs, ys, most)]
    assert line_dedup._within(xs, ys, most).tolist() == want and 60 < sum(want) < 150


def plain_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


def test_edit_similarity():
    r = random.Random(1)
    for _ in range(500):
        a = " ".join(r.choice(["a", "bc", "def", "été"]) for _ in range(r.randint(1, 9)))
        b = " ".join(w if r.random() < 0.8 else r.choice(["x", ""]) for w in a.split(" "))
        most = int(max(len(a), len(b)) * 0.2 + 1e-9)
        assert not b or edit_distance(a, b) == plain_distance(a, b)
        assert edit_similar(a, b) == (plain_distance(a, b) <= most)
        bound = words_bound(a.split(" "), b.split(" "), 20)
        assert bound is None or bound >= plain_distance(a, b)
        for most in (1, 3, 9):
            assert not b or edit_distance(a * 5, b * 5, most) == (plain_distance(a * 5, b * 5) if plain_distance(a * 5, b * 5) <= most else None)
    assert words_bound(["a", "b"], ["b", "c"], 2) == 4 and words_bound(["a", "b"], ["b", "c"], 1) is None and words_bound("one two six".split(), "one ten six".split(), 2) == 4


def brute_cut(rows, k=35):
    seen = Counter()
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for _, w in split:
        seen.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for d, w in split:
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("which", ["made", "sf"])
def test_repeated_windows_equal_brute_force(spark, documents, which):
    df = documents if which == "sf" else spark.createDataFrame([(d, t + " " + t if d % 5 == 0 else t) for d, t in near_copies(9)], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(substring.remove_repeats(df)).collect()}
    assert got == brute_cut(rows)


def plain_rows(rows, k=35):
    """As brute_cut, by row: each row is a document of its own."""
    cut = brute_cut([(i, t) for i, (_, t) in enumerate(rows)], k)
    return sorted((str(rows[i][0]), *v) for i, v in cut.items())


@pytest.mark.parametrize("window", [9, 17, 18, 70, 140])
def test_windows_of_other_lengths(spark, window):
    assert substring.levels(35) == [9, 18, 35] and substring.levels(140) == [9, 18, 35, 70, 140]
    made = [(d, f"{t} x{d} {t}" if d % 5 == 0 else t) for d, t in near_copies(9)]
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(substring.remove_repeats(spark.createDataFrame(made, "doc_id long, text string"), window)).collect()]
    assert sorted(got) == plain_rows(made, window) and (window > 70 or any(r[2] for r in got))


def test_a_hot_window_is_split(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{passage} end{i}") for i in range(1500)] + [(9000 + i, " ".join(f"u{i}x{j}" for j in range(50))) for i in range(20)]
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 40 for i in range(1500)} | {9000 + i: 0 for i in range(20)}


def test_substring_odd_and_no_documents(spark, odd_documents, no_documents):
    a, b = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 60), ("b", 45)))
    twice = odd_documents.select("doc_id", "text").union(spark.createDataFrame([(5000, a), (5000, b), (5000, "short"), (5001, "x " + a), (5002, a[:-4]), (None, b), (5003, b), (5003, b)], "doc_id long, text string"))
    for df in (odd_documents, twice):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(substring.remove_repeats(df)).collect()]
        assert sorted(got) == plain_rows(rows)
    assert substring.remove_repeats(no_documents).count() == 0
