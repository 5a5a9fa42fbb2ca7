"""Segmentation against all ways to cut a run."""

import math
import random
import re
from itertools import combinations

import pytest

from lectern.operators import reviews, segmentation


def all_cuts(text, counts, longest):
    total = sum(counts.values()) or 1
    alone = round(math.log(total) * 1e6)
    best = None
    for k in range(len(text)):
        for cut in combinations(range(1, len(text)), k):
            ends = [0, *cut, len(text)]
            words = [text[a:b] for a, b in zip(ends, ends[1:])]
            if all(len(w) <= longest and (len(w) == 1 or w in counts) for w in words):
                cost = sum(round((math.log(total) - math.log(counts[w])) * 1e6) if w in counts else alone for w in words)
                key = (cost, len(words), [-len(w) for w in words])
                best = min(best, (key, words)) if best else (key, words)
    return best[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_best_path_equals_all_cuts(spark, seed):
    r = random.Random(seed)
    letters = "好电影看的😀"
    word = lambda k: "".join(r.choice(letters) for _ in range(k))
    counts = {word(r.randint(1, 4)): r.choice([1, 2, 2, 5, 40]) for _ in range(25)}
    runs = list({word(r.randint(1, 10)) for _ in range(60)})
    d = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {x.run: x.words for x in segmentation.best_paths(spark.createDataFrame([(x,) for x in runs + runs[:5] + [""]], "run string"), d, 3).collect()}
    assert got == {x: all_cuts(x, {w: n for w, n in counts.items()}, 3) for x in runs}


def test_reviews_are_cut_into_words(spark):
    names = spark.createDataFrame([("流浪地球",), ("地球",), ("刘慈欣：流浪地球",), ("流浪地球 A",)], "t string")
    d = segmentation.word_dictionary(names, "t")
    assert {x.word: x.n for x in d.collect()} == {"流浪地球": 3, "地球": 1, "刘慈欣": 1}
    rows = [(1, "我看流浪地球2很好, the film is great"), (2, None), (3, "地球刘慈欣 地球"), (4, "")]
    got = {x.id: x.tokens for x in reviews.cut_reviews(spark.createDataFrame(rows, "id int, text string"), "id", d).collect()}
    assert got == {1: ["流浪地球", "film", "great"], 2: [], 3: ["地球", "刘慈欣", "地球"], 4: []}
    none = d.limit(0)
    assert {x.id: x.tokens for x in reviews.cut_reviews(spark.createDataFrame(rows[2:3], "id int, text string"), "id", none).collect()} == {3: []}


def test_reviews_of_many_words_are_no_rows_of_words(spark, monkeypatch):
    monkeypatch.setattr(segmentation, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(segmentation, "MEMO_PIECES", 5)
    r = random.Random(3)
    counts = {"好电影": 30, "电影": 40, "好看": 9, "看的": 2, "影看": 5, "的": 3, "abc": 7}
    run = lambda: "".join(r.choice("好电影看的") for _ in range(r.randint(1, 7)))
    text = lambda: r.choice([" ", ",", "\n", "; "]).join(r.choice([run(), "The", "x", run() + "FILM" + run()]) for _ in range(r.randint(0, 60)))
    texts = [(k, text()) for k in range(80)] + [(None, "电影好看"), (81, None), (7, "电影 影看 The"), (7, "电影 影看 The"), (82, "É电影\x85好看　")]
    d = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = reviews.cut_reviews(spark.createDataFrame(texts, "id int, text string"), "id", d, stop_words=["the"])
    assert got.columns == ["id", "text", "tokens"]

    def places(t):
        out = []
        for p, part in enumerate(re.split(r"[ \t\n\x0b\f\r,;.\-]+", t.lower())):
            out += [(p, q, all_cuts(x, counts, 8) if "一" <= x[0] <= "鿿" else [x]) for q, x in enumerate(re.findall("[一-鿿]+|[^一-鿿]+", part)) if len(x) > 1]
        return out

    shared = {}
    for k, t in texts:
        shared.setdefault(k, []).extend(places(t or "") if k is not None else [])
    want = [(k, t, [w for _, _, words in sorted(shared[k]) for w in words if len(w) > 1 and w != "the"]) for k, t in texts]
    assert sorted(((x.id, x.text, x.tokens) for x in got.collect()), key=str) == sorted(want, key=str)
    single = reviews.cut_reviews(spark.createDataFrame(texts[:80], "id int, text string"), "id", d)
    assert "posexplode" not in single._jdf.queryExecution().optimizedPlan().toString()


def test_words_asked_are_all_that_are_known(spark):
    words = ["好", "电影", "好电影", "影好电影看的", "😀", "a" * 8]
    bits = segmentation._word_bitmap(spark.createDataFrame([(w,) for w in words], "word string"))
    runs = {"看好电影好电影看的好", "影", "😀😀", "a" * 9}
    assert set(segmentation._words_asked(runs, bits, 8)) == set(words)
    assert segmentation._words_asked(set(), bits, 8) == []
