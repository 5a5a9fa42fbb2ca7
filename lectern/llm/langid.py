"""Language identification by rank-order profiles.

A profile is a list of the most frequent letter n-grams (1 to 3 letters, words
padded by a space), most frequent first. A document is given the language whose
profile is nearest by out-of-place distance: each of the document's n-grams
costs the difference of its two ranks, or PROFILE if the language lacks it.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import mixed, only, portions, text_rows

#: N-grams in a language's and in a document's profile.
PROFILE, DOC_PROFILE = 400, 300
#: Documents per language that profiles are learned from, at most: those of least hash.
TRAIN_DOCS = 400
UNKNOWN = "und"

#: Odd multipliers that make a gram's letters one number.
_KEYS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

_words = re.compile(r"[^\W\d_]+").findall


def _spread(x: np.ndarray) -> np.ndarray:
    return mixed(x).view(np.int64)


def gram_hash(gram: str) -> int:
    """The number that a gram is known by, a hash of 64 bits; of equally frequent grams the smaller one comes first."""
    c = np.frombuffer(gram.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return int(_spread((c * np.array(_KEYS[: len(c)])).sum(keepdims=True))[0])


def gram_counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of a whole text, lower-cased; none if it has no letter.

    Distinct words stand in a row, a space before each and after the last, so
    that grams of all of them are taken at once; a gram counts as often as its word.
    """
    words = Counter(_words((text or b"").decode("utf-8", "replace").lower()))
    if not all(map(str.isalpha, words)):
        alike: Counter = Counter()
        for w, n in words.items():
            if w := "".join(filter(str.isalpha, w)):
                alike[w] += n
        words = alike
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    weight = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(w) + 1 for w in words])
    space = c == 32
    one = c[:-1] * _KEYS[0]
    two = one + c[1:] * _KEYS[1]
    three = two[:-1] + c[2:] * _KEYS[2]
    letter, inner = ~space[:-1], ~space[1:-1]  # a gram is no space alone, and spans no two words
    grams = _spread(np.concatenate([one[letter], two, three[inner]]))
    weight = np.concatenate([weight[letter], weight, weight[:-1][inner]])
    ids, at = np.unique(grams, return_inverse=True)
    return ids, np.bincount(at, weight).astype(np.int64)


def ranked(ids: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, ties to the smaller hash."""
    return ids[np.lexsort((ids, -n))[:most]]


def _count(batches):
    for b in portions(batches):
        total: dict[str, Counter] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            ids, n = gram_counts(text)
            total.setdefault(lang, Counter()).update(dict(zip(ids.tolist(), n.tolist())))
        rows = [(lang, g, n) for lang, c in total.items() for g, n in c.items()]
        cols = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()))], names=["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, may_learn: Column) -> dict[str, np.ndarray]:
    """lang -> its ranked n-grams, from the whole texts of at most TRAIN_DOCS documents per language.

    The documents are those of least hash(doc_id) among the rows that
    ``may_learn`` allows and whose lang and text are not null. The driver gets
    PROFILE numbers for each value of lang, whatever the number of documents.
    Rows of a language are cut by a threshold of the hash before they are ranked,
    so a frequent language is no more work for a task than a rare one.
    """
    spark = docs.sparkSession
    able = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    h = F.xxhash64("doc_id")
    # twice the share that gives TRAIN_DOCS: fewer than these are as good as impossible
    known = [(r.lang, int(-(1 << 63) + min(1.0, 2 * TRAIN_DOCS / r.n) * ((1 << 64) - 1025))) for r in able.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    limits = spark.createDataFrame(known, "lang string, most long")
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = able.select("doc_id", "lang", h.alias("h")).join(F.broadcast(limits), "lang").where("h <= most")
    ids = ids.withColumn("r", F.row_number().over(first)).where(F.col("r") <= TRAIN_DOCS).select("doc_id", "lang").distinct()
    sample = text_rows(able.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi"), "lang")  # TRAIN_DOCS for each lang at most
    counts = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("r", F.row_number().over(top)).where(F.col("r") <= PROFILE).orderBy("lang", "r").collect()
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.int64) for k, v in sorted(out.items())}


class Profiles:
    """N-grams of all profiles, in order, each with the languages that have it and its rank there."""

    def __init__(self, profiles: list[np.ndarray]):
        self.languages = len(profiles)
        grams = np.concatenate([np.zeros(0, np.int64), *profiles])
        of = np.repeat(np.arange(len(profiles)), [len(p) for p in profiles])
        rank = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(p)) for p in profiles]])
        order = np.argsort(grams, kind="stable")
        self.grams, self.starts = np.unique(grams[order], return_index=True)
        self.counts = np.diff(np.append(self.starts, len(grams)))
        self.of, self.rank = of[order], rank[order]

    def nearest(self, text: bytes | None) -> tuple[int, float]:
        """(number of the nearest profile, score from 0 to 1), or (-1, 0)."""
        ids, n = gram_counts(text)
        if not len(ids) or not len(self.grams):
            return -1, 0.0
        top = ranked(ids, n, DOC_PROFILE)
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        place = np.flatnonzero(self.grams[at] == top)
        at = at[place]
        counts = self.counts[at]
        # every entry of the n-grams found, one after the other
        entry = np.repeat(self.starts[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        saved = PROFILE - np.abs(self.rank[entry] - np.repeat(place, counts))
        cost = PROFILE * len(top) - np.bincount(self.of[entry], saved, minlength=self.languages).astype(np.int64)
        best = int(cost.argmin())
        return best, float(1 - cost[best] / (PROFILE * len(top)))


def _identify(langs: list[str], held, batches):
    only("profiles")
    profiles = Profiles(held.value)
    for b in portions(batches):
        found = [profiles.nearest(t) for t in b.column("text").to_pylist()]
        lang = [langs[i] if i >= 0 else UNKNOWN for i, _ in found]
        cols = [b.column(c) for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*cols, pa.array(lang, pa.string()), pa.array([s for _, s in found], pa.float64())],
            names=[*(c for c in b.schema.names if c != "text"), "lang_pred", "score"],
        )


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) of each row; ``und`` and 0 for a text that is null or has no letter, or without profiles.

    The score is 1 less the distance's share of the largest possible one. Only
    the text is an input, and the whole of it, however long. Rows are independent:
    repeats and null doc_ids pass; other columns are not read; an empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(list(profiles.values()))
    run = partial(_identify, list(profiles), held)
    return text_rows(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def predictions(docs: DataFrame) -> DataFrame:
    out = held_out(F.col("doc_id"), 5, 0)
    found = identify(docs, learn_profiles(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


#: A text this far from every profile is no text of a known language.
LEAST_SCORE = 0.05


def _accept(held, batches):
    only("profiles")
    profiles = Profiles(held.value)
    for b in portions(batches):
        keep = [i >= 0 and s >= LEAST_SCORE for i, s in (profiles.nearest((t or "").encode()) for t in b.column("text").to_pylist())]
        yield b.filter(pa.array(keep, pa.bool_()))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows, all columns, whose text is of a known language: not ``und``, and of LEAST_SCORE or more."""
    profiles = learn_profiles(docs, ~held_out(F.col("doc_id"), 5, 0))
    held = docs.sparkSession.sparkContext.broadcast(list(profiles.values()))
    return docs.mapInArrow(partial(_accept, held), docs.schema)
